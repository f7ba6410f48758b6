"""Every registered query outside llm against its SQL on the smallest data."""

import math
import os

import duckdb
import pytest

from gaugeline.plans import q_geometry, q_refusals, q_results, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
#: Those that differ in kind; the rest of the queries is the same code on other columns.
NAMES = ["reference_stats", "concern_severity", "threshold_fit", "repeatability_gates", "capture_gates", "severity_pivot", "worst_cv", "plane_glcm", "plane_components", "threshold_sweep", "hull_membership", "outcome_routing", "webp_header", "label_queue", "config_merge"]
NAMES += [*q_refusals.QUERIES, *q_results.QUERIES, *q_geometry.QUERIES]


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
