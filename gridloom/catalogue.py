"""The engine's named queries and the DuckDB SQL that each must equal."""

from .queries import calibration, flows, heights, images, pixels, scalars, scenarios, statistics, surroundings

_parts = (pixels, scalars, statistics, surroundings, calibration, images, heights, flows, scenarios)
QUERIES: dict = {name: query for part in _parts for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _parts for name, sql in part.ORACLES.items()}
