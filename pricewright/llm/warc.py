"""WARC archives: writing, reading back, and an index merged from sorted runs.

Writing: every page becomes one record. Of equal payloads of ``min_bytes`` or
more the page with the largest id is the response, the others are revisits that
refer to it and carry no payload. Spark's text writer puts the records into
files (its line separator is the blank lines that end a record), so any file
system works and a lost executor leaves no half-written archive behind.

Reading: each file is one run. Records are cut by their Content-Length, digests
are checked, and the run's captures are sorted by URL key, time and page.

Index: a range shuffle on the same key sends each task the slices of all runs
that fall into its range (a URL with very many captures is split by time), and
a loser tree merges the k slices. Ranges follow each other, so the captures of
a URL come in order of time over all archives.

Defined results: a null page has an empty payload. A null or odd URL is its own
key. Rows with a null page id are written and come back with null. Of rows that
share both payload and the largest id, one is the response. Extra columns are
ignored; an empty table gives an empty index."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import batches_of, shared_path, shuffle_width, stage, table

RECORDS_PER_FILE = 2000
EPOCH = 1_577_836_800      # capture time of page 0; each page is a second later
# What the archive format calls things.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
INDEX = ("url_key string, captured string, page_id long, archive string, record_offset long, record_length long, "
         "payload_bytes long, payload_digest string, record_type string, refers_to long")
ORDER = ["url_key", "captured", "page_id", "archive", "record_offset"]


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the top level down, then the path; other texts as they are."""
    u = F.lower(F.trim(F.coalesce(url, F.lit("-"))))
    host = F.regexp_extract(u, "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\\.)?([^/?#:]+)", 1)
    rest = F.regexp_extract(u, "^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"),
                   F.when(rest == "", "/").otherwise(rest))
    return F.when(host == "", u).otherwise(key)


def _header_safe(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("-")), "[\\x00-\\x20\\x7f]+", "%20")


def records(pages: DataFrame, row_key: Column, min_bytes: int = 0) -> DataFrame:
    """One column ``value``: the record of each page, without the closing blank lines."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), row_key.alias("row"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"),
                       base32_sha1(F.col("payload")).alias("digest"))
    # only payloads that occur more than once, a narrow table of known size
    first = (rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
             .agg(F.max(F.struct("page_id", "row")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("digest", "bytes", F.col("m.page_id").alias("keep"), F.col("m.row").alias("keep_row")))
    rows = rows.join(stage(first, "warc-copies"), ["digest", "bytes"], "left")
    revisit = F.col("keep_row").isNotNull() & (F.col("keep_row") != F.col("row"))
    head = F.when(revisit, F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\n")).otherwise(
        F.lit("WARC-Type: response\r\n"))
    refers = F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.coalesce(F.col("keep").cast("string"), F.lit("-")),
                                      F.lit("\r\n"))).otherwise("")
    second = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)) % (1 << 30))
    when = F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uid = F.md5(F.concat_ws("/", F.col("page_id").cast("string"), "url", "digest", F.col("row").cast("string")))
    uuid = F.concat_ws("-", F.substring(uid, 1, 8), F.substring(uid, 9, 4), F.substring(uid, 13, 4),
                       F.substring(uid, 17, 4), F.substring(uid, 21, 12))
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return rows.select(F.concat(
        F.lit(f"{VERSION}\r\n"), head, F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), _header_safe(F.col("url")), F.lit("\r\nX-Url-Key: "),
        _header_safe(url_key(F.col("url"))), F.lit("\r\nX-Page: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit("\r\n"), refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit(f"\r\n\r\n{HTTP_HEAD}"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    ).alias("value"))


def write_archives(pages: DataFrame, path: str, row_key: Column | None = None, min_bytes: int = 0,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages (page_id, url, html). ``row_key`` must tell rows apart and
    stay the same when rows are read again; without it the pages are staged first."""
    if row_key is None:
        pages = stage(pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("_row")), "pages")
        row_key = F.col("_row")
    (records(pages, row_key, min_bytes).write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", records_per_file).text(path))


# ---- reading

HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse_archive(data: bytes):
    """(header dict, block, offset, length) of each record."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 2
        first = data.index(b"\r\n", at) + 2
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = {k.decode(): v.decode() for k, v in HEADER.findall(data, first, head_end)}
        begin = head_end + 2
        end = begin + int(head["Content-Length"])
        yield head, data[begin:end], at, end + len(END) - at
        at = end + len(END)


def _run_of(name: str, data: bytes) -> list[tuple]:
    out = []
    for head, block, at, length in parse_archive(data):
        payload = block[block.index(b"\r\n\r\n") + 4:]
        digest, size, kind = head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"]), head["WARC-Type"]
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != size:
                raise ValueError(f"payload of the record at byte {at} of {name} is damaged")
        number = lambda k: int(head[k]) if head.get(k, "-") != "-" else None
        out.append((head["X-Url-Key"], head["WARC-Date"], number("X-Page"), name, at, length, size, digest, kind,
                    number("X-Refers-To-Page")))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[f.split(" ")[0] for f in INDEX.split(", ")])


def _read(batches):
    for b in batches:
        for i in range(b.num_rows):
            rows = _run_of(b["name"][i].as_py(), b["content"][i].as_py())
            if rows:
                yield _batch(rows)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives below a path, each archive's in order."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    with batches_of(spark, 1):       # one row is one whole archive
        return stage(files.mapInArrow(_read, INDEX), "warc-runs")


# ---- index

class LoserTree:
    """Merge of k sorted lists: inner nodes hold the loser of their match, so
    the next row costs one match per level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.tree = [-1] * self.k
        self.head = [self._key(i) for i in range(len(runs))] or [None]
        self.winner = self._play(1)

    def _key(self, i):
        return self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        x, y = self._play(2 * node), self._play(2 * node + 1)
        if self._less(y, x):
            x, y = y, x
        self.tree[node] = y
        return x

    def __iter__(self):
        while self.head[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self._key(w)
            node = (w + self.k) // 2
            while node:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def _merge(batches):
    """Rows come grouped by run; each run's slice is in order."""
    runs: dict[str, list] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(row[3], []).append(row)
    out = []
    for row in LoserTree(list(runs.values()), _order):
        out.append(row)
        if len(out) == 5000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in one order of url_key, captured, page_id over the partitions."""
    spark = runs.sparkSession
    return (runs.repartitionByRange(shuffle_width(spark), *[F.col(c) for c in ORDER])
            .sortWithinPartitions("archive", *ORDER).mapInArrow(_merge, INDEX))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", "_metadata.file_name", "_metadata.row_index")
    write_archives(pages, path, F.struct("file_name", "row_index"))
    out = merged_index(read_runs(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured",
                      "archive", "record_offset", "record_length")
