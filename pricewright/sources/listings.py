"""Test-data mapping: one shop listing per lineitem row.

Prices and years come out as strings on purpose so the cleaning operators
have work to do. The five ``ORD_COLS`` are unique per row and give every
listing a stable first-seen position (``ord``) that survives shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.prices import round2
from pricewright.session import tune

ORD_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, with_price_text: bool = False) -> DataFrame:
    """Raw listings mapped from lineitem + part + supplier + nation + orders.

    Join strategies are left to the planner: part, supplier and orders grow
    with the data, so they shuffle-join unless their measured size is under
    the broadcast threshold; nation is a fixed 25-row dimension. Line items are
    dealt by order first, which the join with orders needs anyhow. Of dates only the
    year is shuffled.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        *ORD_COLS, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.year("l_shipdate").alias("l_shipyear")).repartition("l_orderkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_orderyear"))

    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey)
         .join(supp, li.l_suppkey == supp.s_suppkey)
         .join(nation, supp.s_nationkey == nation.n_nationkey))

    word2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    cols = [
        *[F.col(c) for c in ORD_COLS],
        F.concat(F.lit(" "), F.col("p_name"), F.lit("  "), F.lower("p_type"), F.lit(" ")).alias("part_name"),
        F.when(F.col("l_discount") == 0.01, F.lit("unknown"))
         .otherwise(F.concat(F.col("p_type"), F.lit(" "), word2)).alias("part_type"),
        F.when(F.col("l_tax") == 0.08, F.lit("Unknown")).otherwise(F.col("p_brand")).alias("part_brand"),
        word2.alias("scraped_category"),
        F.when(F.col("l_returnflag") == "R", F.lit("Universal"))
         .when(F.col("l_discount") == 0, F.lit(""))
         .otherwise(F.concat(F.lit("Make "), (F.col("n_nationkey") % 5).cast("string"))).alias("compatible_make"),
        F.when(F.col("l_returnflag") == "R", F.lit("Universal"))
         .otherwise(F.concat(F.lit("Model "), (F.col("l_suppkey") % 2).cast("string"))).alias("compatible_model"),
        F.when(F.col("l_linestatus") == "O", F.col("o_orderyear").cast("string")).alias("year_from"),
        F.when(F.col("l_quantity") == 50, F.lit("2099"))
         .otherwise(F.col("l_shipyear").cast("string")).alias("year_to"),
        F.when(F.col("l_tax") == 0, F.lit("0"))
         .otherwise(F.col("l_extendedprice").cast("string")).alias("price_pkr"),
        F.when(F.col("l_discount") >= 0.05, round2(F.col("l_extendedprice") / (1 - F.col("l_discount"))))
         .otherwise(F.lit(0.0)).alias("price_original_pkr"),
        F.when(F.col("l_returnflag") == "A", F.lit("")).when(F.col("l_returnflag") == "N", F.lit("New"))
         .otherwise(F.lit("Used")).alias("condition"),
        (F.col("l_linestatus") == "O").alias("available"),
        F.concat(F.lit("Site"), (F.col("l_suppkey") % 3).cast("string")).alias("website"),
        F.when(F.col("l_quantity") == 1, F.lit(""))
         .otherwise(F.concat(F.lit("https://shop.example/shop/"), F.col("l_partkey").cast("string"),
                             F.lit("-"), (F.col("l_suppkey") % 4).cast("string"))).alias("product_url"),
        F.when(F.col("l_discount") == 0.02, F.concat(F.lit("About "), F.col("p_name")))
         .otherwise(F.lit("")).alias("description"),
    ]
    if with_price_text:
        cols += price_text_columns()
    return j.select(*cols).withColumn("ord", F.struct(*ORD_COLS))


def _fmt(c):
    return F.format_number(c, 2)


def price_text_columns():
    """Card price texts synthesised per row (four styles by line number):
    'Rs 1,700', 'Rs. 35,000', a 'through' range and a '-15%' badge, plus a
    del/ins sale pair for discounted rows."""
    p = F.col("l_extendedprice")
    hi = round2(p / (1 - F.col("l_discount")))
    pct = F.round(F.col("l_discount") * 100).cast("bigint").cast("string")
    style = F.col("l_linenumber") % 4
    text = (F.when(style == 0, F.concat(F.lit("Rs "), _fmt(p)))
            .when(style == 1, F.concat(F.lit("Rs. "), _fmt(p)))
            .when(style == 2, F.concat(F.lit("Rs "), _fmt(p), F.lit(" through Rs "), _fmt(hi)))
            .otherwise(F.concat(F.lit("Rs "), _fmt(p), F.lit(" -"), pct, F.lit("%"))))
    sale = F.col("l_discount") >= 0.05
    return [text.alias("price_text"),
            F.when(sale, F.concat(F.lit("Rs "), _fmt(hi))).alias("del_text"),
            F.when(sale, F.concat(F.lit("Rs "), _fmt(p))).alias("ins_text")]
