"""Texts and tables for other programs."""
