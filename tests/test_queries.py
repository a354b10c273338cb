"""Registered queries against their DuckDB oracles on the smallest tables,
plus plan-shape checks."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FAST = ["clean_listings", "dedupe_richest", "dedupe_priced", "alternatives", "dataset_stats", "top_categories",
        "parse_price", "price_text_rule", "offer_price", "repair_prices", "page_prefix", "features",
        "regression_metrics", "tfidf_vocab", "merge_responses", "listing_cards", "validate_requests"]


def norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 4)
    return v


def canon(df):
    cols = sorted(df.columns)
    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert canon(got) == canon(want)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["value", "n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_build_plans_stay_in_jvm(spark):
    q = E.queries()
    for name in ["clean_listings", "dedupe_richest", "alternatives"]:
        p = plan(q[name](spark, SMALL))
        assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_alternatives_limit_before_shuffle(spark):
    from pricewright.plans import build as B
    from pricewright.operators.alternatives import with_group_key, eligible, candidates
    u = with_group_key(B.unique(spark, SMALL)).filter(eligible())
    c = candidates(u)
    c.collect()
    p = c._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_scan_is_pruned(spark):
    from pricewright.plans import build as B
    p = B.cleaned(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey" in p and "l_commitdate" not in p
