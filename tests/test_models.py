"""Quantiles, lookups, text features, training, saving and scoring."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.operators import features as FE
from pricewright.operators.lookup import lookup_join
from pricewright.operators.ranks import quantiles
from pricewright.operators.tfidf import vocabulary, weights, with_terms
from pricewright.plans import registry as R
from pricewright.plans import score as S
from pricewright.plans import train as T
from pricewright.sources.listings import ORD_COLS
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- exact quantiles ---------------------------------------------------------------------------

def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000, numPartitions=8).select(((F.xxhash64("id") % 10**12) / 7.0).alias("v"))
    values = df.toPandas()
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    want = duckdb.sql(f"SELECT quantile_cont(v, {qs}) FROM values").fetchall()[0][0]
    assert quantiles(df, "v", qs).first().q == pytest.approx(want, rel=1e-12)


def test_quantiles_by_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 9])) for _ in range(3000)]
    rows += [("one", 7.0), ("none", None)]
    got = {r.g: list(r.q) for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v",
                                             [0.1, 0.5, 0.9], by=["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], [0.1, 0.5, 0.9]))
    assert set(got) == {"a", "b", None, "one"}
    assert list(quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q) == [None]


def test_no_percentile_in_one_task(spark):
    for name in ("trim_outliers", "price_stats", "regression_metrics", "bucket_metrics"):
        p = plan(R.REGISTRY[name](spark, SMALL))
        assert "percentile(" not in p and "SinglePartition, [" not in p


# ---- lookups ---------------------------------------------------------------------------------

@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_lookup_join(spark, broadcast_rows):
    rows = [("hot" if i % 3 else f"v{i % 50}", i) for i in range(2000)] + [(None, 2000), ("new", 2001)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(4)
    table = spark.createDataFrame([("hot", 1300, 1.5, 1)] + [(f"v{j}", 15, float(j), j) for j in range(50)],
                                  "value string, n long, x double, y int")
    out = lookup_join(df, table, "k", "value", "n", broadcast_rows)
    assert out.columns == ["k", "i", "x", "y"]
    want = {"hot": (1.5, 1), **{f"v{j}": (float(j), j) for j in range(50)}}
    assert sorted((r.i, r.x, r.y) for r in out.collect()) == sorted((i, *want.get(k, (None, None))) for k, i in rows)


def test_one_join_per_column(spark):
    p = plan(R.REGISTRY["features"](spark, SMALL))
    tree = p.split("Subquery")[0]
    assert sum(tree.count(f"{j}Join") for j in ("BroadcastHash", "SortMerge", "ShuffledHash")) <= 6


# ---- text features and models -------------------------------------------------------------------

@pytest.fixture(scope="module")
def frame(spark):
    enc, maps = R._ml_frame(spark, SMALL)
    return enc.cache(), maps


def test_vocabulary_counts(spark):
    texts = ["red lamp red lamp", "red tyre", "the lamp", "", "of the", "blue lamp red"]
    docs = with_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = {r.term: (r.df, r.tf, r["index"]) for r in vocabulary(docs).collect()}
    assert got == {"lamp": (3, 4, 0), "lamp red": (2, 2, 1), "red": (3, 4, 2)}


def test_text_reaches_the_model(spark, frame):
    df, _ = frame
    train = T.train_rows(df)
    model = T.fit(df, "forest")
    terms = [r.term for r in vocabulary(with_terms(train, "part_name")).orderBy("index").collect()]
    assert T.feature_names(model) == T.BASE_INPUTS + [f"tfidf:{t}" for t in terms] and len(terms) > 20
    assert model.stages[-1].numFeatures == len(T.BASE_INPUTS) + len(terms)
    assert R.REGISTRY["feature_count"](spark, SMALL).first().n_features == model.stages[-1].numFeatures
    # a word of test rows only is no feature: the vocabulary is fitted on the training rows
    odd = df.withColumn("part_name", F.when(F.col("split") == "test", "zzqq zzqq").otherwise(F.col("part_name")))
    assert not any("zzqq" in n for n in T.feature_names(T.feature_pipeline(odd)))


def test_vectors_equal_the_relational_weights(spark, frame):
    df = frame[0].limit(300).cache()
    vocab = vocabulary(with_terms(T.train_rows(df), "part_name"))
    want = {}
    for r in weights(with_terms(df, "part_name"), vocab, ORD_COLS).collect():
        want.setdefault(tuple(r[c] for c in ORD_COLS), {})[r["index"]] = r.weight
    prepared = T.feature_pipeline(df)
    for r in prepared.transform(df).select(*ORD_COLS, T.TEXT_VECTOR).collect():
        v = r[T.TEXT_VECTOR]
        assert dict(zip(v.indices.tolist(), v.values.tolist())) == pytest.approx(want.get(tuple(r[c] for c in ORD_COLS), {}))


def test_presets_compared_saved_and_served(spark, frame, tmp_path, monkeypatch):
    df, maps = frame
    fits = []
    monkeypatch.setattr(T, "estimator", lambda name, real=T.estimator: fits.append(name) or real(name))
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    models, metrics = T.train_models(df, presets=list(T.PRESETS))
    assert fits == list(T.PRESETS) and spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    rows = {r.model: r for r in metrics.collect()}
    from pricewright.plans.evaluate import regression_metrics, select_best
    best = select_best(metrics).first()["best"]
    base = regression_metrics(R._baseline(df, "scraped_category").filter("split = 'test'")).first()
    assert rows[best].r2 > base.r2 and rows[best].mae < base.mae

    path = str(tmp_path / "saved")
    from pricewright.operators.stats import price_stats
    T.save_model(models[best], maps, metrics, best, path, df, price_stats(df))
    loaded, _, meta = T.load_model(spark, path)
    m = meta.first()
    assert m.model_name == best and m.feature_count == loaded.stages[-1].numFeatures == len(m.feature_names)
    assert m.training_samples + m.test_samples == m.total_samples == df.count()
    assert m.price_stats.median == price_stats(df).first().median and set(m.metrics) == set(T.PRESETS)
    same = T.predict(loaded, df).select("predicted").toPandas()
    pd.testing.assert_frame_equal(same, T.predict(models[best], df).select("predicted").toPandas())

    facts = S.model_facts(meta)
    assert facts == {"model_name": best, "median_ae": round(rows[best].median_ae, 4)}
    scored, rejected = S.score_saved(S.example_parts(spark), path)
    out = scored.collect()
    assert len(out) == 5 and rejected.count() == 0 and all(r.predicted_price_pkr > 0 for r in out)
    default, _ = S.score(S.example_parts(spark), loaded, maps)
    for r, d in zip(sorted(out), sorted(default.collect())):
        assert r.predicted_price_pkr == d.predicted_price_pkr and r.model_name == best
        assert r.confidence_range_high != d.confidence_range_high
        assert abs(r.confidence_range_high - r.predicted_price_pkr - 1.5 * facts["median_ae"]) <= 1
    # the part name counts: it is the only thing that differs
    words = [n[6:] for n in m.feature_names if n.startswith("tfidf:")]
    base = S.example_parts(spark).limit(1)
    names = base.withColumn("part_name", F.explode(F.array(*[F.lit(w) for w in words if " " not in w][:40])))
    assert S.score_saved(names, path)[0].select("predicted_price_pkr").distinct().count() > 1


@pytest.mark.parametrize("name, size", [("fit_forest", {"numTrees": 500, "maxDepth": 25, "minInstancesPerNode": 2}),
                                        ("fit_gbt", {"maxIter": 800, "maxDepth": 15, "stepSize": 0.03,
                                                     "minInstancesPerNode": 3})])
def test_registered_fits_have_their_whole_size(spark, monkeypatch, name, size):
    made = []

    class Stopped(Exception):
        pass

    class Learner:
        def __init__(self, real):
            made.append({k: real.getOrDefault(k) for k in size})

        def fit(self, data):
            raise Stopped

    real = T.estimator
    monkeypatch.setattr(T, "estimator", lambda *a, **b: Learner(real(*a, **b)))
    rows = [("train" if i % 5 else "test", 10.0 + i, f"red lamp {i % 3}", *[float(i % 7)] * len(T.BASE_INPUTS)) for i in range(20)]
    frame = spark.createDataFrame(rows, ["split", "price_pkr", "part_name", *T.BASE_INPUTS])
    monkeypatch.setattr(R, "_ml_frame", lambda *a: (frame, None))
    with pytest.raises(Stopped):
        R.REGISTRY[name](spark, SMALL)
    assert made == [size]


def test_weights_are_shuffled_once_and_rows_of_one_id_are_one_document(spark):
    names = [(1, "red lamp red"), (1, "lamp shade"), (2, "blue lamp"), (None, "red shade"), (None, "red"), (3, "none of it"),
             (4, None), (5, "")]
    docs = with_terms(spark.createDataFrame(names, "id int, part_name string"), stop=[])
    vocab = spark.createDataFrame([("lamp", 0, 1.5), ("red", 1, 2.0), ("red lamp", 2, 3.0), ("shade", 3, 2.5)],
                                  "term string, index long, idf double")
    out = weights(docs, vocab, ["id"])
    want = {}
    for key, count in {1: {"lamp": 2, "red": 2, "red lamp": 1, "shade": 1}, 2: {"lamp": 1}, None: {"red": 2, "shade": 1}}.items():
        raw = {r.term: (r["index"], count[r.term] * r.idf) for r in vocab.collect() if r.term in count}
        norm = math.sqrt(sum(x * x for _, x in raw.values()))
        want |= {(key, t): (i, round(x / norm, 9)) for t, (i, x) in raw.items()}
    assert {(r.id, r.term): (r["index"], round(r.weight, 9)) for r in out.collect()} == want and out.count() == len(want)
    assert out.dtypes == [("id", "int"), ("term", "string"), ("index", "bigint"), ("weight", "double")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan.split("Initial Plan")[-1])) == 1, plan
