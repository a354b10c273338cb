"""Duplicate removal in two phases.

Both rules keep one row per key and place it at the key's first-seen
position. First the winners are chosen on narrow rows: a 128-bit hash of the
key, the score and the position, in an aggregate whose partial step collapses
a hot key before the shuffle. Then the winners are fetched whole by key and
position, which no two of them share, so the wide rows are moved at most once
and never sorted by a hot key. Rows that cannot be winners, told by a bitmap of
the winners, are not moved at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import finite_positive, truthy, ws_trim
from pricewright.session import materialize


def dedupe_key(url="product_url", name="part_name"):
    """lower-trimmed URL, else lower-trimmed name; "" means no key."""
    u = F.lower(ws_trim(F.coalesce(F.col(url), F.lit(""))))
    n = F.lower(ws_trim(F.coalesce(F.col(name), F.lit(""))))
    return F.when(u != "", u).otherwise(n)


def richness_score(df: DataFrame, exclude=("ord",)) -> F.Column:
    """Number of truthy fields of the row (quirk Q14)."""
    terms = [truthy(c, t).cast("int") for c, t in df.dtypes if c not in exclude and c != "alternatives"]
    return sum(terms[1:], terms[0])


_KEY = ["_k1", "_k2"]
_SCORE, _VALUES = "_score", "_values"


def _keyed(df: DataFrame, stored: bool, order_col: str, score=None) -> DataFrame:
    """Rows that have a key, with its hash, the hash of their values and the score. Both phases read
    them, so a derived frame is stored first, with its score; the hashes, which do not compress, are
    made on reading."""
    rows = df if score is None else df.withColumn(_SCORE, score)
    has_key = F.col("_key") != ""
    new = {"_k1": F.when(has_key, F.xxhash64("_key")), "_k2": F.when(has_key, F.xxhash64(F.lit("key"), "_key")),
           _VALUES: F.xxhash64(*[F.col(c) for c in df.columns if c != order_col])}
    return ((rows if stored else materialize(rows)).withColumn("_key", dedupe_key())    # a column first, so it is made once
            .withColumns(new).drop("_key").filter(F.col("_k1").isNotNull()))


BITS_A_WINNER = 8
MOST_BITS = 1 << 29         # 64 MB; with more winners more of the other rows pass
_CHUNK = [f"_bits{i}" for i in range(8)]


def _spot(bits: int, order_col: str) -> dict:
    """Where the bit of a row's key and position is: a chunk of eight words, the word and the bit in it."""
    at = F.pmod(F.xxhash64(*_KEY, order_col), F.lit(bits))
    return {"_chunk": F.floor(at / 512).cast("long"), "_word": F.floor(F.pmod(at, F.lit(512)) / 64).cast("int"),
            "_bit": F.pmod(at, F.lit(64)).cast("int")}


def _may_win(keyed: DataFrame, winners: DataFrame, order_col: str) -> DataFrame:
    """The rows whose bit is set among the bits of the winners, a stored table (key, position): all
    winners and a few others."""
    bits = max(512, min(winners.count() * BITS_A_WINNER, MOST_BITS))
    columns = keyed.columns
    spot = _spot(bits, order_col)
    word = lambda i: F.when(F.col("_word") == i, F.expr("shiftleft(1L, _bit)")).otherwise(F.lit(0).cast("long"))
    chunks = (winners.select(*[c.alias(k) for k, c in spot.items()]).repartition("_chunk")
              .groupBy("_chunk").agg(*[F.bit_or(word(i)).alias(c) for i, c in enumerate(_CHUNK)]))
    held = F.get(F.array(*_CHUNK), F.col("_word"))
    return (keyed.withColumns(spot).join(F.broadcast(chunks), "_chunk")
            .filter(F.getbit(held, F.col("_bit")) == 1).select(*columns))


def _fetch(keyed: DataFrame, winners: DataFrame, order_col: str) -> DataFrame:
    """The winners' rows, each at the position ``_first``. Of rows that share key and
    position one is taken, by the hash of their values."""
    cols = [c for c in keyed.columns if c not in (order_col, *_KEY, _SCORE, _VALUES)]
    won = materialize(winners.withColumnRenamed("_win", order_col))
    j = _may_win(keyed, won, order_col).join(won, [*_KEY, order_col])
    alike = Window.partitionBy(*_KEY, order_col).orderBy(_VALUES)
    return (j.withColumn("_alike", F.row_number().over(alike)).filter("_alike = 1")
            .select(F.col("_first").alias(order_col), *cols))


def dedupe_richest(df: DataFrame, order_col: str = "ord", stored: bool = False) -> DataFrame:
    """Keep the row with most truthy fields; ties go to the earliest. ``stored`` tells that ``df``
    is a table as it lies, which can be read twice."""
    keyed = _keyed(df, stored, order_col, richness_score(df, exclude=(order_col,)))
    best = (keyed.select(*_KEY, F.struct((-F.col(_SCORE)).alias("s"), F.col(order_col).alias("o")).alias("r"))
            .groupBy(*_KEY).agg(F.min("r").alias("r"), F.min("r.o").alias("_first")))
    return _fetch(keyed, best.select(*_KEY, F.col("r.o").alias("_win"), "_first"), order_col)


def dedupe_priced(df: DataFrame, order_col: str = "ord", stored: bool = False) -> DataFrame:
    """Keep the first row, except that a first row priced exactly 0 gives way
    to the first later row with a positive price."""
    keyed = _keyed(df, stored, order_col)
    o = F.col(order_col)
    best = (keyed.select(*_KEY, o.alias("o"), F.when(F.col("price_pkr") == 0, 1).otherwise(0).alias("zero"),
                         F.when(finite_positive("price_pkr"), o).alias("priced"))
            .groupBy(*_KEY).agg(F.min(F.struct("o", "zero")).alias("r"), F.min("priced").alias("priced")))
    swap = (F.col("r.zero") == 1) & F.col("priced").isNotNull()
    winners = best.select(*_KEY, F.when(swap, F.col("priced")).otherwise(F.col("r.o")).alias("_win"),
                          F.col("r.o").alias("_first"))
    return _fetch(keyed, winners, order_col)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate listing sources, duplicates kept, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
