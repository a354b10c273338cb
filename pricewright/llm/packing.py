"""Mixture-controlled packing into sequences of a fixed number of tokens.

Each source has a queue of its documents' tokens. Deficit round-robin serves
the queues in units of ``quantum`` tokens: a source earns credit in proportion
to its share of all tokens, and the source whose next unit is due first is
served. Unit u of a queue of U units is due when the fraction (2u + 1) / 2U of
everything has been served, so credit a source has not used carries over from
window to window. Served tokens fill the sequences without gaps; only the last
one may be short. As the order of due times is known in closed form, a task
finds the place of any token of its documents from the queue totals alone, and
deficits carry across partitions without any state passed on.

Defined results: a null text is empty and still has its end token. A null
source is a queue of its own. Documents of one queue follow each other by
input partition. At most ``max_queues`` sources (those with most tokens) have
their own queue and all others share one, so what a task must know is bounded.
An empty table gives no pieces."""

from __future__ import annotations

import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import small_batches, stage, table
from pricewright.llm.bpe import byte_symbols

SEQ_LEN = 4096
QUANTUM = 256
END_ID = 2
MAX_QUEUES = 4096
CACHE_WORDS = 200_000
CACHE_CORES = 200_000
LONG_WORD = 64        # longer ones are not kept
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, source string")


def parted(core: str) -> bool:
    """Whether the core still ends in a letter or digit once it is normalised and in lower case."""
    return core[-1].isalnum() and (core.isascii() or normalize("NFC", core)[-1].lower()[-1].isalnum())


class Kept(dict):
    """The ids of words as ``make`` finds them. A word moves here when it is met for the second
    time; until then it waits among the latest, which are forgotten when they are too many. So the
    many words that occur once displace no frequent one. A full table that no longer helps, as so
    many words are made again, starts anew."""

    def __init__(self, make, size: int):
        super().__init__({"": b""})
        self.make, self.size = make, size
        self.latest: dict[str, bytes] = {}
        self.missed = 0

    def __missing__(self, w: str) -> bytes:
        ids = self.latest.pop(w, None)
        if ids is None:
            ids = self.make(w)
            if len(w) <= LONG_WORD:
                if len(self.latest) >= self.size // 2:
                    self.latest.clear()
                self.latest[w] = ids
            return ids
        if len(self) >= self.size:
            self.missed += 1
            if self.missed < self.size:
                self.latest[w] = ids
                return ids
            self.clear()
            self.missed, self[""] = 0, b""
        self[w] = ids
        return ids


class WordIds:
    """Token ids of texts by a vocabulary that drops white space and letter case.

    A text is split at blanks and line feeds; the ids of each distinct word are
    kept in a table of bounded size. A new word is the marks before it, its core
    and the marks behind it. The vocabulary's pattern takes a run of marks as one
    unit and parts it from a letter or digit, but not from the combining mark that
    some letters end in once they are normalised and in lower case, nor a lone
    apostrophe from letters behind it. Cores are kept too. A core of Latin letters
    alone is one unit of the pattern and goes straight to the library's model in
    lower case, as the library's own steps before it would hand it over, digits are
    units one by one; all others go through those steps."""

    def __init__(self, vocab: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(vocab)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tok.model
        # the model reads bytes as printable characters
        self.symbols = "".join(byte_symbols())
        self.digits = {c: self._core(c) for c in "0123456789"}
        self.known = Kept(self._word, CACHE_WORDS)
        self.cores = Kept(self._core, CACHE_CORES)

    def texts(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]

    def _word(self, w: str) -> bytes:
        core = w.rstrip(punctuation)
        if len(core) < len(w):
            if not core or not parted(core):
                return self._core(w)
            return self.known[core] + self.cores[w[len(core):]]
        core = w.lstrip(punctuation)
        if len(core) < len(w) and core[0].isalnum() and w[:len(w) - len(core)] != "'":
            return self.cores[w[:len(w) - len(core)]] + self._core(core)
        return self._core(w)

    def _core(self, w: str) -> bytes:
        if len(w) > 1 and w.isascii() and w.isdigit():
            return b"".join(map(self.digits.__getitem__, w))
        return array(self.code, self._encode(w)).tobytes()

    def _encode(self, w: str) -> list[int]:
        if w.isalpha():
            if w.isascii():
                return [t.id for t in self.model.tokenize(w.lower())]
            if max(w) < "\u0250" and "\u0130" not in w and (low := w.lower()).isalpha():
                return [t.id for t in self.model.tokenize(charmap_decode(low.encode(), "strict", self.symbols)[0])]
        return self.tok.encode(w, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        return self.texts([text])[0]


@lru_cache(maxsize=1)
def word_ids(vocab: str) -> WordIds:
    return WordIds(vocab)


def _tokens(vocab: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = word_ids(vocab)
        end = np.array([end_id], enc.dtype).tobytes()
        wide = enc.dtype.itemsize
        at: dict = {}
        for b in batches:
            ids, start, n = [], [], []
            blobs = enc.texts([t or "" for t in b["text"].to_pylist()])
            for blob, s in zip(blobs, b["source"].to_pylist()):
                blob += end
                m = len(blob) // wide
                ids.append(blob)
                start.append(at.get(s, 0))
                n.append(m)
                at[s] = at.get(s, 0) + m
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["source"], b["_part"], pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "before", "n", "ids"])
    return run


def served_before(queue: int, unit: np.ndarray, totals: list[int], quantum: int) -> np.ndarray:
    """Tokens served before unit ``unit`` of a queue; queues tie by number."""
    big = max(totals, default=0) // quantum + 2 > 1 << 30
    u = unit.astype(object if big else np.int64)
    mine = max(1, -(-totals[queue] // quantum))
    out = np.zeros(len(u), object if big else np.int64)
    for q, total in enumerate(totals):
        if q == queue:
            n = u
        else:
            units = -(-total // quantum)
            x = (2 * u + 1) * units - mine     # unit v of q is earlier if 2 v mine < x, or = x and q < queue
            n = x // (2 * mine) + 1 if q < queue else -(-x // (2 * mine))
            n = np.clip(n, 0, units)
        out = out + np.minimum(n * quantum, total)
    return out.astype(np.int64)


def _cut(totals: list[int], names: dict, seq_len: int, quantum: int, wide: str):
    """Pieces of each document: it is cut where its queue's units end unless
    the next unit follows directly, and where sequences end."""
    def pieces(queue: int, at: np.ndarray, n: np.ndarray):
        """(row, start, place, length) for documents of one queue."""
        units = (at + n - 1) // quantum - at // quantum + 1
        row = np.repeat(np.arange(len(at)), units)
        unit = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units) + (at // quantum)[row]
        lo = np.maximum(unit * quantum, at[row])
        size = np.minimum((unit + 1) * quantum, (at + n)[row]) - lo
        place = served_before(queue, unit, totals, quantum) + (lo - unit * quantum)
        new = np.ones(len(row), bool)
        new[1:] = (place[1:] != place[:-1] + size[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        row, start, place, size = row[first], (lo - at[row])[first], place[first], np.add.reduceat(size, first)
        # and at the ends of sequences
        parts = (place + size - 1) // seq_len - place // seq_len + 1
        r = np.repeat(np.arange(len(row)), parts)
        k = np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.maximum(place[r], (place[r] // seq_len + k) * seq_len)
        end = np.minimum((place + size)[r], (place[r] // seq_len + k + 1) * seq_len)
        return row[r], start[r] + begin - place[r], begin, end - begin

    def run(batches: Iterator[pa.RecordBatch]):
        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for b in batches:
            at, n = (b[c].to_numpy() for c in ("at", "n"))
            queue = np.array([names.get(s, len(totals) - 1) for s in b["source"].to_pylist()])
            found = []
            for q in np.unique(queue).tolist():
                own = np.flatnonzero(queue == q)
                row, *rest = pieces(q, at[own], n[own])
                found.append((own[row], *rest))
            if not found:
                continue
            row, start, place, size = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, row))
            row, start, place, size = row[order], start[order], place[order], size[order]
            blobs, crc, last, ids = b["ids"], [], -1, b""
            for r, s, m in zip(row.tolist(), (4 * start).tolist(), (4 * size).tolist()):
                if r != last:
                    last, ids = r, memoryview(np.frombuffer(blobs[r].as_buffer(), wide).astype("<u4").tobytes())
                crc.append(zlib.crc32(ids[s:s + m]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(take), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), b["n"].take(take),
                 pa.array(place // seq_len), pa.array(place % seq_len), b["source"].take(take)], names=fields)
    return run


def pack(docs: DataFrame, vocab: str, seq_len: int = SEQ_LEN, quantum: int = QUANTUM, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(source_col).cast("string").alias("source"), F.spark_partition_id().alias("_part"))
    toks = stage(rows.mapInArrow(
        _tokens(vocab, end_id), "doc_id long, source string, part int, before long, n long, ids binary"), "tokens")
    parts = toks.groupBy("source", "part").agg(F.sum("n").alias("in_part"))
    per_source = parts.groupBy("source").agg(F.sum("in_part").alias("total"))
    top = per_source.orderBy(F.desc("total"), F.asc_nulls_last("source")).limit(max_queues).collect()
    totals, names = [int(r.total) for r in top], {r.source: i for i, r in enumerate(top)}
    queue = None
    if len(top) == max_queues:
        rest = int(toks.agg(F.sum("n")).first()[0]) - sum(totals)
        if rest:
            totals.append(rest)
            queue = F.when(F.coalesce(F.col("source"), F.lit("\0")).isin([s if s is not None else "\0" for s in names]),
                           F.col("source")).otherwise(F.lit("\1"))
    # where each (source, input partition) begins in its queue: one narrow row each
    from pyspark.sql import Window
    key = (queue if queue is not None else F.col("source"))
    w = Window.partitionBy("_q").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    begins = stage(parts.withColumn("_q", key)
                   .withColumn("base", F.coalesce(F.sum("in_part").over(w), F.lit(0)))
                   .select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base"), "queue-begins")
    placed = (toks.join(begins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
              .select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), "n", "ids"))
    from tokenizers import Tokenizer
    wide = "<u2" if Tokenizer.from_file(vocab).get_vocab_size() <= 1 << 16 else "<u4"
    return placed.mapInArrow(_cut(totals, names, seq_len, quantum, wide), PIECES)


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
