"""Every catalog query against its DuckDB oracle at sf0.01 (the driver's gate)."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from changefold.plans.catalog import all_queries

SF = "/root/testdata/sf0.01"
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def _norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    own = set(all_queries())
    assert own <= set(entry.queries()) and set(entry.oracle_sql()) & own == own


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(exp)
    assert _rows(df.columns, got) == _rows(cols, exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "wiki", "window_start", "window_end", "edit_count", "bot_edits", "human_edits", "unique_editors", "bot_ratio"
    ]
