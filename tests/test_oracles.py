"""Registered queries against their DuckDB oracles on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from docquill.sources.tables import TABLES
from tests.conftest import SMOKE

NAMES = ["annotate_documents", "clean_text", "wrap_noisy", "path_filter", "rule_units", "identifier_parts",
         "shrink_pages", "apply_edits", "go_units", "ts_units"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = _rows(E.queries()[name](spark, SMOKE).toPandas())
    want = _rows(con.sql(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
