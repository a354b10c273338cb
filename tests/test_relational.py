"""Order-dependent rules against plain sequential restatements."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.operators.alternatives import build_alternatives
from pricewright.operators.clean import clean_listings, drop_dead
from pricewright.operators.dedupe import dedupe_priced, dedupe_richest

COLS = "part_name string, part_type string, compatible_make string, compatible_model string, " \
       "part_brand string, price_pkr double, product_url string, pos long"


def frame(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return clean_listings(df.withColumn("ord", F.col("pos")).drop("pos"))


def test_dedupe_priced_fixture(spark):
    rows = [("a", "t", "m", "x", "b", 0.0, "u1", 0), ("b", "t", "m", "x", "b", 500.0, "U1 ", 1),
            ("c", "t", "m", "x", "b", 700.0, "u1", 2), ("d", "t", "m", "x", "b", 0.0, "u2", 3)]
    out = dedupe_priced(frame(spark, rows)).orderBy("ord").collect()
    assert [(r.ord, r.part_name) for r in out] == [(0, "b"), (3, "d")]


def test_dedupe_richest_keeps_first_on_tie(spark):
    rows = [("a", "t", "", "x", "", 1.0, "u", 0), ("b", "t", "", "x", "", 1.0, "u", 1),
            ("c", "t", "m", "x", "br", 1.0, "u", 2)]
    out = dedupe_richest(frame(spark, rows)).collect()
    assert [(r.ord, r.part_name) for r in out] == [(0, "c")]


def brute_alternatives(rows):
    """The rule restated over lists: group members in input order, skip same URL, first 10."""
    groups = {}
    keyed = []
    for r in rows:
        t, m, mo = (r[1] or "").strip().lower(), (r[2] or "").strip().lower(), (r[3] or "").strip().lower()
        ok = t and m and m != "universal"
        keyed.append((r, (t, m, mo) if ok else None))
        if ok:
            groups.setdefault((t, m, mo), []).append(r)
    out = {}
    for r, k in keyed:
        out[r[7]] = [] if k is None else [a[7] for a in groups[k] if a[6] != r[6]][:10]
    return out


urls = st.sampled_from(["", " ", "u1", "u2", "u3", "u4", "u5"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["t", "T ", ""]), st.sampled_from(["m", "universal", ""]),
                          st.sampled_from(["x", "y"]), urls), min_size=1, max_size=30))
def test_alternatives_match_brute_force(spark, data):
    rows = [(f"n{i}", t, m, mo, "b", 1.0, u, i) for i, (t, m, mo, u) in enumerate(data)]
    df = spark.createDataFrame(rows, COLS).withColumn("ord", F.col("pos"))
    got = {r.pos: [a.part_name for a in r.alternatives]
           for r in build_alternatives(df).collect()}
    want = {k: [f"n{i}" for i in v] for k, v in brute_alternatives(rows).items()}
    assert got == want


def test_alternatives_cap_and_universal(spark):
    rows = [(f"n{i}", "t", "m", "x", "b", 1.0, f"u{i}", i) for i in range(12)]
    rows += [("z", "t", "Universal", "x", "b", 1.0, "uz", 99)]
    out = {r.pos: len(r.alternatives) for r in build_alternatives(
        spark.createDataFrame(rows, COLS).withColumn("ord", F.col("pos"))).collect()}
    assert out[99] == 0 and all(out[i] == 10 for i in range(12))


def test_hot_group_alternatives_bounded(spark):
    """One group holding every row: candidates stay bounded, result exact."""
    df = spark.range(20000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("part_name"),
                                   F.lit("t").alias("part_type"), F.lit("m").alias("compatible_make"),
                                   F.lit("x").alias("compatible_model"), F.lit("b").alias("part_brand"),
                                   F.lit(1.0).alias("price_pkr"),
                                   F.concat(F.lit("u"), F.col("id").cast("string")).alias("product_url"),
                                   F.col("id").alias("ord"))
    out = build_alternatives(df)
    r = out.filter("ord = 0").first()
    assert [a.part_name for a in r.alternatives] == [f"n{i}" for i in range(1, 11)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_drop_dead_nan(spark):
    df = spark.createDataFrame([("a", float("nan"), False), ("b", 0.0, True), ("c", 5.0, False)],
                               "part_name string, price_pkr double, available boolean")
    assert sorted(r.part_name for r in drop_dead(df).collect()) == ["b", "c"]


def test_rows_without_a_group_do_not_meet(spark):
    """A third of the rows has no group, all with the same blank columns; every task gets its share."""
    rows = spark.range(30_000, numPartitions=4).select(
        F.col("id").alias("ord"), F.lit("n").alias("part_name"), F.lit("b").alias("part_brand"),
        F.lit(1.0).alias("price_pkr"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("product_url"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("id") % 5000).cast("string"))).alias("part_type"),
        F.lit("m").alias("compatible_make"), F.lit("x").alias("compatible_model"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracker = spark.sparkContext.statusTracker()
        before = set(tracker.getJobIdsForGroup(None))
        out = build_alternatives(rows)
        assert set(tracker.getJobIdsForGroup(None)) == before       # planning runs nothing
        sizes = sorted(r.n for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.size("alternatives"))).collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert out.filter("part_type = '' AND size(alternatives) > 0").isEmpty()
        assert out.filter("part_type <> ''").agg(F.min(F.size("alternatives")), F.max(F.size("alternatives"))).first() == (3, 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
