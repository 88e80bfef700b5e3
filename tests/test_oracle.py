"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from broadsheaf.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


#: Queries that SQL cannot express, with the test that holds them against plain loops.
BY_HAND = {
    "q_pair_metrics": "test_whole_texts.py::test_edits_late_in_a_text", "q_hat3": "test_whole_texts.py::test_edits_late_in_a_text", "q_skew_scores": "test_skew.py::test_queries_against_the_model",
    "q_skew_states": "test_skew.py::test_queries_against_the_model", "q_allocate_steps": "test_by_hand.py::test_allocate_steps", "q_stream_leases": "test_by_hand.py::test_leases", "q_rate_limit": "test_by_hand.py::test_rate_limit", "q_normalised": "test_by_hand.py::test_normalised",
    "q_snippets": "test_by_hand.py::test_snippets", "q_consensus": "test_readings.py::test_consensus_query", "q_confusions": "test_readings.py::test_consensus_query", "q_text_agreement": "test_readings.py::test_agreement_query",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(float(v)) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = sorted([plain(x) for x in r] for r in df.select(*sorted(df.columns)).collect())
    if name not in oracle_sql():
        assert name in BY_HAND, f"{name} has neither SQL nor a test by hand"
        module, test = BY_HAND[name].split("::")
        with open(os.path.join(os.path.dirname(__file__), module)) as f:
            assert f"def {test}(" in f.read()
        return
    want = duck.sql(oracle_sql()[name])
    columns = want.columns
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted([plain(r[i]) for i in order] for r in want.fetchall())
