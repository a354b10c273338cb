"""The composed repair pass, stage counts of a running build, and the stored first-seen order."""

import json

import pytest
from pyspark.sql import functions as F

from pricewright.operators import repair as RP
from pricewright.operators import stats as ST
from pricewright.operators.clean import PRICE_NOTE
from pricewright.plans import build as B
from pricewright.plans import registry as R
from pricewright.plans.build import StageCounts, build
from pricewright.session import ensure_checkpoint_dir
from pricewright.sources.files import numbered, read_raw_json, write_raw
from pricewright.sources.listings import ORD_COLS
from tests.conftest import SMALL

ITEM = "part_name string, product_url string, price_pkr double, price_original_pkr double, available boolean, " \
       "description string, compatible_make string, part_type string, ord long"
DETAIL = "product_url string, status int, price double, original_price double, available boolean, description string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [("fixed", "u1", 0.0, 0.0, True, "", "Toyota", "t", 0), ("gone", "u2", 0.0, 0.0, True, "", "Toyota", "t", 1),
            ("sold", "u3", 0.0, 0.0, True, "", "", "t", 2), ("open", "u4", 0.0, 0.0, True, "", "", "t", 3),
            ("priced", "u5", 9.0, 0.0, False, "", "Honda", "t", 4), ("no url", "", 0.0, 0.0, True, "", "Honda", "t", 5),
            ("again", "U1 ", 0.0, 0.0, True, "", "Toyota", "t", 6)]
    details = [("u1", 200, 50.0, 60.0, True, "text"), ("u2", 404, 0.0, 0.0, True, ""), ("u3", 200, 0.0, 0.0, False, ""),
               ("u4", 200, 0.0, 0.0, True, "")]
    more = {c: F.lit("") for c in ("scraped_category", "part_brand", "compatible_model")} | {
        "condition": F.lit("New"), "year_from": F.lit(None).cast("int"), "year_to": F.lit(None).cast("int")}
    return spark.createDataFrame(rows, ITEM).withColumns(more), spark.createDataFrame(details, DETAIL)


def test_repair_pass(spark, items):
    out = RP.repair_pass(*items)
    assert out.counts == {"total": 7, "visited": 5, "fixed": 1, "marked_out_of_stock": 1, "gone": 2, "still_zero": 5,
                          "dropped": 3, "kept": 4}
    assert out.counts["visited"] == RP.repair_counters(RP.repair_prices(*items)).first().visited
    rows = {r.part_name: r for r in out.rows.collect()}
    assert set(rows) == {"fixed", "open", "priced", "no url"}
    assert (rows["fixed"].price_pkr, rows["fixed"].price_original_pkr, rows["fixed"].description) == (50.0, 60.0, "text")
    assert {n for n, r in rows.items() if r.price_note == PRICE_NOTE} == {"open", "no url"}
    assert {r.part_name for r in out.final.collect()} == {"fixed", "open", "priced", "no url"}


def test_repair_pass_keeps_zero_and_enriches(spark, items):
    def client(prompts):
        return [json.dumps([{"compatible_make": "Suzuki", "part_type": "t"}] * 15) for _ in prompts]
    out = RP.repair_pass(*items, keep_zero=True, enrich_fn=client)
    assert out.counts["dropped"] == 0 and out.rows.count() == 7 and "price_note" not in out.rows.columns
    makes = {r.part_name: r.compatible_make for r in out.raw.collect()}
    assert makes["sold"] == makes["open"] == "Suzuki" and makes["fixed"] == "Toyota"


def test_repair_preview(spark, items):
    got = RP.repair_preview(items[0], ["ord"], n=4).collect()
    assert [(r.ord, r.part_name, r.remaining) for r in got] == [(0, "fixed", 2), (1, "gone", 2), (2, "sold", 2), (3, "open", 2)]
    assert [r.remaining for r in RP.repair_preview(items[0], ["ord"], n=50).collect()] == [0] * 6


def test_repair_reads_its_input_once(spark):
    plan = RP.repair_prices(B.cleaned(spark, SMALL).drop("alternatives"), R.detail_table(spark, SMALL)) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("Union") == 0
    assert sum("l_returnflag" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_stage_counts_come_with_the_build(spark, tmp_path):
    watch = StageCounts()
    out = build(B.raw(spark, SMALL), watch=watch)
    out.write.mode("overwrite").parquet(str(tmp_path / "built"))
    want = ST.stage_counts(B.raw(spark, SMALL)).first().asDict()
    assert watch.counts == want
    assert spark.read.parquet(str(tmp_path / "built")).count() == want["deduplicated"]


def test_order_survives_other_split_sizes(spark, tmp_path):
    names = [f"part {(i * 7919) % 5000:05d}" for i in range(5000)]
    for k in range(2):
        with open(tmp_path / f"raw-{k}.json", "w") as f:
            f.writelines(json.dumps({"part_name": n, "product_url": f"u{n}", "category_slug": f"c{len(n) % 3}-{int(n[-2:]) % 4}"})
                         + "\n" for n in names[k * 2500:(k + 1) * 2500])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = []
    try:
        for size in ("16k", "3k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_raw_json(spark, str(tmp_path / "raw-*.json"), multiline=False)
            orders.append([r.part_name for r in df.orderBy("ord").select("part_name").collect()])
            sink = str(tmp_path / f"sink-{size}")
            write_raw(df, sink)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
            back = read_raw_json(spark, f"{sink}/json", multiline=False)
            orders.append([r.part_name for r in back.orderBy("ord").select("part_name").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(o == names for o in orders)


def test_positions_go_on_after_a_rerun(spark, tmp_path):
    frame = lambda slug, *names: spark.createDataFrame(
        [(n, slug, i) for i, n in enumerate(names)], "part_name string, category_slug string, ord long")
    write_raw(frame("a", "a1", "a2"), str(tmp_path))
    write_raw(frame("b", "b1"), str(tmp_path))
    write_raw(frame("a", "a9"), str(tmp_path))
    got = read_raw_json(spark, f"{tmp_path}/json", multiline=False).orderBy("ord").select("part_name").collect()
    assert [r.part_name for r in got] == ["b1", "a9"]
    assert sorted(r.position for r in numbered(frame("x", *"abcdefg").repartition(4)).collect()) == list(range(7))


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = object()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_dedupe_moves_narrow_rows(spark):
    plan = B.unique(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "SortAggregate" in line:
            assert "description" not in line and "product_url" not in line
    from pricewright.operators.dedupe import dedupe_richest
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("product_url"),
        F.lit("n").alias("part_name"), (F.col("id") % 5).cast("double").alias("price_pkr"), F.col("id").alias("ord"))
    out = dedupe_richest(hot)
    assert out.count() == 40_001
    assert out.filter("product_url = 'same'").select("ord", "price_pkr").collect() == [(0, 3.0)]


def test_queries_cover_whole_texts(spark):
    assert set(R.REGISTRY["strip_fence"](spark, SMALL).columns) == {"conv_id", "turn", "text"}
    assert "tokens" in R.REGISTRY["tokens"](spark, SMALL).columns and ORD_COLS


def test_details_are_never_broadcast(spark):
    """Also where the planner takes them for small, as it does with well compressed files."""
    rows = spark.range(10).select(F.concat(F.lit("n"), "id").alias("part_name"), F.concat(F.lit("u"), "id").alias("product_url"),
                                  F.lit(0.0).alias("price_pkr"), F.lit(0.0).alias("price_original_pkr"),
                                  F.lit(True).alias("available"), F.lit("").alias("description"))
    details = spark.range(10).select(
        F.concat(F.lit("u"), "id").alias("product_url"), F.lit(200).alias("status"), F.lit(5.0).alias("price"),
        F.lit(0.0).alias("original_price"), F.lit(True).alias("available"), F.lit("").alias("description"))
    out = RP.repair_prices(rows, details)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("fixed").count() == 10


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from pricewright.session import ENGINE_CONF, tune
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit, None)
    try:
        spark.conf.unset(limit)
        B.cleaned(spark, SMALL)
        assert spark.conf.get(limit) == ENGINE_CONF[limit] == "8000"
        spark.conf.set(limit, "65535")              # the session's own wish
        assert tune(spark).conf.get(limit) == "65535"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def test_dedupe_makes_key_and_score_once(spark, monkeypatch):
    from pricewright.operators import dedupe as DD
    rows = spark.createDataFrame([(" U1", "a", 1.0, 0), ("u1 ", "b", 0.0, 1), ("", " N ", 0.0, 2), (None, "n", 2.0, 3),
                                  ("", " ", 3.0, 4), (None, None, 4.0, 5)],
                                 "product_url string, part_name string, price_pkr double, ord long")
    kept = DD.dedupe_richest(rows).orderBy("ord").select("ord", "part_name").collect()
    assert [tuple(r) for r in kept] == [(0, "a"), (2, "n")]
    assert DD.dedupe_priced(rows).count() == DD.dedupe_priced(rows, stored=True).count() == 2
    monkeypatch.setattr(DD, "materialize", lambda df: df)
    score = DD.richness_score(rows, exclude=("ord",))
    assert logical(DD._keyed(rows, False, "ord", score).select("_k1", "_k2", "_score", "_values")).count("lower(") <= 6


def test_steps_read_twice_are_stored_once(spark, monkeypatch):
    """Alternatives, batches and scoring read what the dedupe or the cleaning gives more than once."""
    from pricewright.plans import score as S
    for df in (B.final(spark, SMALL), R._batched(spark, SMALL)):
        assert "l_returnflag" not in logical(df)
    seen = []
    monkeypatch.setattr(R, "_saved_model", lambda *a: "nowhere")
    monkeypatch.setattr(S, "score_saved", lambda requests, path: (seen.append(requests) or requests.select(
        "*", *[F.lit(0.0).alias(c) for c in ("predicted_price_pkr", "confidence_range_low", "confidence_range_high")],
        F.lit("PKR").alias("currency"), F.lit("m").alias("model_name")), None))
    R.REGISTRY["score_requests"](spark, SMALL)
    assert "Join" not in logical(seen[0]) and seen[0].count() > 0


@pytest.mark.parametrize("v", ["", " ", "a", " a", "a ", "\ta", "a　", "é", "é b", "\x1ca b\x1f", "!", "~", "a\n b\n", "\x00", "\x7fa"])
def test_trim_needs_no_pattern(spark, v):
    from pricewright.functions import ws_trim
    df = spark.createDataFrame([(v,)], "s string").select(ws_trim("s").alias("t"))
    assert df.first().t == v.strip() and "RLIKE" not in logical(df)


def test_wide_rows_of_a_dedupe_meet_their_winners_unsorted(spark):
    """The winners go into a hash table when their measured partitions are small."""
    from pricewright.operators.dedupe import dedupe_richest
    from pricewright.session import tune
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before, cast = spark.conf.get(key), "spark.sql.autoBroadcastJoinThreshold"
    broadcast = spark.conf.get(cast)
    spark.conf.unset(key)
    try:
        assert tune(spark).conf.get(key) == "64MB"
        spark.conf.set(cast, "-1")
        rows = spark.range(400).select(F.struct("id").alias("ord"), (F.col("id") % 50).cast("string").alias("product_url"),
                                       F.lit("n").alias("part_name"))
        out = dedupe_richest(rows)
        assert out.count() == 50
        final = dedupe_richest(rows)
        final.collect()
        plan = final._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan.split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
        spark.conf.set(cast, broadcast)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from pricewright.session import FREED, materialize
    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(FREED, None)
    files = shuffle_files(spark)
    assert materialize(rows).count() == 100 and spark.conf.get(FREED, None) == before
    for _ in range(50):
        if shuffle_files(spark) <= files + 3:       # those of the count itself
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= files + 3


@pytest.mark.parametrize("rule", ["dedupe_richest", "dedupe_priced"])
def test_only_rows_that_may_win_are_moved(spark, monkeypatch, rule):
    """A wide row that is no winner is told by its bit before the join; no hash is stored beside it."""
    from pricewright.operators import dedupe as DD
    rows = spark.range(4000).select(F.struct("id").alias("ord"), (F.col("id") % 50).cast("string").alias("product_url"),
                                    F.lit("n").alias("part_name"), (F.col("id") + 1.0).alias("price_pkr"))
    stored, moved = [], []
    monkeypatch.setattr(DD, "materialize", lambda df, real=DD.materialize: stored.append(df.columns) or real(df))
    monkeypatch.setattr(DD, "_may_win", lambda *a, real=DD._may_win: moved.append(real(*a)) or moved[-1])
    out = getattr(DD, rule)(rows)
    assert sorted(r.ord.id for r in out.collect()) == list(range(50))
    assert not {"_k1", "_k2", "_values"} & set(stored[0])
    assert 50 <= moved[0].count() <= 1000 and moved[0].filter("ord.id < 50").count() == 50


def test_years_are_shuffled_not_dates(spark):
    p = logical(B.cleaned(spark, SMALL))
    assert "year(" in p.split("RepartitionByExpression")[1] and "l_shipdate" not in p.split("RepartitionByExpression")[0]


def test_rows_that_are_not_visited_pass_beside_the_join(spark):
    """A stored table is repaired as any other, but only the rows to be visited are joined."""
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else 0.0 if i % 4 == 1 else 5.0, "" if i % 10 == 0 else f"u{i % 60}",
                                   i % 3 > 0, "", 0.0) for i in range(300)] + [(300, None, None, None, None, None)],
                                 "ord int, price_pkr double, product_url string, available boolean, description string, "
                                 "price_original_pkr double").repartition(3)
    details = spark.createDataFrame([(f"u{i}", 404 if i % 7 == 0 else 200, float(i % 5), 9.0, i % 2 == 0, f"d{i}") for i in range(0, 55)]
                                    + [("u8", 200, 7.0, 8.0, True, "more")],
                                    "product_url string, status int, price double, original_price double, available boolean, description string")
    plain, beside = RP.repair_prices(rows, details), RP.repair_prices(rows, details, stored=True)
    assert plain.columns == beside.columns and plain.dtypes == beside.dtypes
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, beside.collect()))
    joined = logical(beside)
    assert "Union" in joined and "xxhash64" not in joined
