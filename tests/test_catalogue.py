"""Queries against the SQL that each must equal.  Those that iterate over the whole grid take long and are run over
one of their kind."""

from __future__ import annotations

import pytest

from gridloom import catalogue

SLOW = {"patches_four", "fill_holes", "flood_reach", "water_body_kind", "flow_accumulation", "drainage_hand", "height_above_sources", "debris_runout", "target_assignment", "people_flow", "trace_path"}


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    wanted = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert tidy(found.columns, map(tuple, found.collect())) == tidy(columns, wanted.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
