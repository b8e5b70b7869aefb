"""A cross-section of the registered queries against their SQL on the smallest test tables."""

import math
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
WHOLE_PIPELINES = ["session_rollup", "user_robust_stats", "rolling_quartiles", "score_events", "macro_auc", "contract_violations",
                   "pseudonymize", "step_response", "audit_table", "detect_token_replay", "stream_features", "stream_transition_counts",
                   "sparse_transitions", "sparse_transition_rows", "sparse_class_ranking"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else (float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    return list(frame.columns), sorted((tuple(clean(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", WHOLE_PIPELINES)
def test_query_equals_sql(spark, db, name):
    got, want = rows(entry.queries()[name](spark, FOLDER).toPandas()), rows(db.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b)), (a, b)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
