"""Benchmark decontamination: test n-grams as a broadcast hash set, scanned by training windows.

Every text is normalised to words. The benchmark's windows of n words become a
hash set; a bitmap of their hashes goes to all tasks, where each document word
starts a window that is tested in place. Only windows whose bit is set leave the
row; a broadcast join with the set's SHA-256 digests verifies them. What is left
are true occurrences, merged into spans that can be cut out of the texts, or
whose documents can be dropped. All of it is DataFrame functions.

The set is dealt into segments of at most ``segment`` windows by hash, and the
documents are scanned once per segment, so what is broadcast at once is bounded
whatever the size of the benchmark.

Defined results: a null text has no words; items without words have no windows;
an item of fewer than n words is one window. A null item id counts as the empty
string, rows that share an id are one item. Repeated documents and null document
ids are kept, one result a row. Other columns of the inputs are ignored by
``contamination`` and carried through by ``decontaminate``. Without documents the
result is empty; without items every document is clean."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm._common import stage, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: The same classes before lower-casing, for cutting the original text.
RAW_BREAK, RAW_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
SEGMENT = 1 << 19           # windows a scan: 4 MB of bitmap, some 50 MB of digests
BITS_PER_WINDOW = 64
BROADCAST_PAIRS = 500_000   # (window, item) rows; beyond, the join with the items is left to the planner
ROW = "_pw_row"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that lambdas inside ``body`` do not compute it anew."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK + "+"), "")


def window(ws: Column, start: Column, size: int | Column) -> Column:
    return F.slice(ws, start + 1, size)


def digest(win: Column) -> Column:
    """Words hold no space, so the text of a window also tells its number of words."""
    return F.sha2(F.array_join(win, " "), 256)


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, hash, digest) of every window of every item."""
    ws = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                      words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0)))
    wins = ws.select("item_id", F.explode(let(F.col("ws"), lambda w: F.transform(
        starts, lambda i: window(w, i, n)))).alias("win"))
    return wins.select("item_id", F.size("win").alias("size"), F.xxhash64("win").alias("hash"),
                       digest(F.col("win")).alias("digest"))


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: an array of bits / 64 longs in which the bit of every hash is set."""
    cells = bits // 64
    at = F.pmod("hash", F.lit(bits))
    mask = F.expr(f"shiftleft(1L, cast(pmod(hash, {bits}) % 64 as int))")
    some = hashes.groupBy(F.floor(at / 64).alias("cell")).agg(F.bit_or(mask).alias("mask"))
    every = hashes.sparkSession.range(cells).withColumnRenamed("id", "cell").join(some, "cell", "left")
    rows = F.sort_array(F.collect_list(F.struct("cell", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return every.agg(F.transform(rows, lambda r: r.mask).alias("bitmap"))


def candidates(ws: Column, sizes: list[int], bits: Column, n_bits: int) -> Column:
    """Windows of a text whose bit is set: array of (start, size, digest)."""
    def of_size(w: Column, size: int) -> Column:
        def is_set(i: Column) -> Column:
            at = F.pmod(F.xxhash64(window(w, i, size)), F.lit(n_bits))
            return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(F.filter(starts, is_set), lambda i: F.struct(
            i.alias("start"), F.lit(size).alias("size"), digest(window(w, i, size)).alias("digest")))
    return let(ws, lambda w: F.concat(*[of_size(w, s) for s in sizes]))


NO_WINDOWS = "array<struct<start:int,size:int,digest:string>>"


def scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, segment: int) -> tuple[DataFrame, DataFrame]:
    """The documents (id, row, n_words) and all occurrences (row, start, end, digest)."""
    distinct = stage(windows.select("size", "hash", "digest").distinct(), "test-ngrams")
    segments = max(1, -(-distinct.count() // segment))
    if ROW not in docs.columns:
        docs = docs.select(id_col, text_col, F.monotonically_increasing_id().alias(ROW))
        if segments > 1:
            docs = stage(docs, "decontaminate-rows")
    base, found = None, []
    for k in range(segments):
        part = distinct.filter(F.pmod(F.shiftrightunsigned("hash", 40), F.lit(segments)) == k)
        sizes = sorted(r["size"] for r in part.select("size").distinct().collect())   # at most n values
        n_bits = max(1 << 10, 1 << (BITS_PER_WINDOW * part.count()).bit_length())
        rows = docs.select(id_col, ROW, words(F.col(text_col)).alias("ws"), bitmap(part, n_bits).scalar().alias("bits"))
        near = candidates(F.col("ws"), sizes, F.col("bits"), n_bits) if sizes else F.array().cast(NO_WINDOWS)
        near = stage(rows.select(id_col, ROW, F.size("ws").cast("long").alias("n_words"), near.alias("near")), "scanned")
        base = base or near.select(id_col, ROW, "n_words")
        found.append(near.select(ROW, F.explode("near").alias("c"))
                     .select(ROW, "c.start", (F.col("c.start") + F.col("c.size")).alias("end"), "c.digest")
                     .join(F.broadcast(part.select("digest")), "digest"))
    return base, stage(reduce(DataFrame.unionByName, found), "test-ngram-hits")


def merged(hits: DataFrame) -> DataFrame:
    """(row, start, end) of the maximal stretches of words that occurrences cover."""
    order = Window.partitionBy(ROW).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = hits.withColumn("opens", F.coalesce((F.col("start") > reach).cast("long"), F.lit(1).cast("long")))
    runs = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Per document: id, n_words, n_hit, spans (word numbers, end exclusive), items, n_items, contaminated."""
    windows = stage(item_windows(items, n, item_id, item_text), "test-windows")
    base, hits = scan(docs, windows, id_col, text_col, segment)
    spans = (merged(hits).groupBy(ROW)
             .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"),
                  F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    pairs = windows.select("digest", "item_id").distinct()
    if windows.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    found = (hits.select(ROW, "digest").distinct().join(pairs, "digest").select(ROW, "item_id").distinct()
             .groupBy(ROW).agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    out = base.join(stage(spans.join(found, ROW), "contaminated"), ROW, "left")
    return out.select(
        id_col, ROW, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text less the words of the spans and what stands before each of them up to the previous word."""
    pieces = F.regexp_extract_all(text, F.lit(f"({RAW_BREAK}*{RAW_WORD}+)"))
    tail = F.regexp_extract(text, f"({RAW_BREAK}*)$", 1)

    def cut(p: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.end))
        starts = F.concat(F.transform(spans, lambda s: s.start), F.array(F.size(p)))
        gaps = F.arrays_zip(ends.alias("after"), starts.alias("until"))
        return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(p, g["after"] + 1, g["until"] - g["after"]))), "")
    return F.concat(let(pieces, cut), tail)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, without test passages: ``remove="spans"`` cuts the hit
    words, ``remove="documents"`` drops the contaminated rows. Clean rows stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    rows = stage(without(docs, ROW).withColumn(ROW, F.monotonically_increasing_id()), "decontaminate-rows")
    hit = (contamination(rows, items, id_col=id_col, text_col=text_col, **options).filter("contaminated")
           .select(ROW, F.col("spans").alias("_pw_spans")))
    if remove == "documents":
        return rows.join(hit, ROW, "left_anti").select(*docs.columns)
    cut = F.when(F.col("_pw_spans").isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col("_pw_spans")))
    return rows.join(hit, ROW, "left").withColumn(text_col, cut).select(*docs.columns)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
item_win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(
               range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + 9], ' '))) AS win
             FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_win),
doc_win AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p,
              unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' '))) AS win
            FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, p, h.size, win FROM doc_win h
        WHERE EXISTS (SELECT 1 FROM item_win t WHERE t.win = h.win AND t.size = h.size)),
covered AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + size)) AS word_no FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item
                FROM hit JOIN item_win USING (win, size)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
