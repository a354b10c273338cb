"""Periodic run detection by online dyadic square catching.

Words are appended to a ``SquareCatcher``. For every power of two B it keeps
catchers: the hashes of the completed aligned blocks of B words that may still
be repeated. A repetition of period q with 2B - 1 <= q <= 4B - 2 holds a whole
aligned block in its first period, and that block stands again q words later. So
each appended word is compared, as the end of the last B words, with the two
catchers of that distance, level by level; arrays take the words of one append
together. Catches of one period whose blocks touch are one repetition and grow
online; a catch inside a known run of a period that divides its own is no new
square. At the end every repetition is extended to its exact borders (less than
a block to either side) and checked word by word, so equal hashes of different
blocks cannot make or change a run.

The work is O(n log n) for n words and the catcher keeps O(n) numbers. Documents
of similar length share a catcher, parted by words that occur nowhere else.

Defined results: a null or empty text has no words and no runs. Rows are
independent: repeated rows and null ids get the same result as any other. Input
columns named ``runs`` or ``collapsed`` are replaced, all others are carried
through. An empty table gives an empty result. The registered query plants a
repetition by the document's id; a null id plants none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm._common import small_batches, table, without

LEAST = 12           # words in a run, at least
GROUP = 1 << 16      # words that share a catcher; a longer document has its own
STEP = 1 << 16       # words of one append
WORK = 1 << 21       # bytes of text whose words are held at once
ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiplications and three shifts."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined(q: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite the stretches [first, end) of one period q that touch."""
    order = np.lexsort((first, q))
    q, first, end = q[order], first[order], end[order]
    opens = np.ones(len(q), bool)
    opens[1:] = (q[1:] != q[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(opens)
    return q[at], first[at], end[np.append(at[1:], len(q)) - 1] if len(at) else end


class SquareCatcher:
    """Takes words as integers; ``longest`` bounds the length of a run to be found."""

    def __init__(self, longest: int, least: int = LEAST):
        self.least = least
        self.levels = max(1, (longest // 2 + 1).bit_length() - 1)
        self.words = np.empty(0, np.int64)
        self.catchers = [np.empty(0, np.uint64) for _ in range(self.levels)]
        self.retired = [0] * self.levels                  # blocks dropped from the front of the catchers
        self.tail = [np.zeros(1 << k, np.uint64) for k in range(self.levels)]
        none = np.empty(0, np.int64)
        self.growing = [(none, none, none) for _ in range(self.levels)]   # period, first and end of caught blocks
        self.ended: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Add words; returns the squares (start, end so far, period) that reach into them."""
        lo = len(self.words)
        self.words = np.append(self.words, np.asarray(words, np.int64))
        hi = len(self.words)
        at = np.arange(lo, hi)
        suffix = mix(self.words[lo:].view(np.uint64))     # of the last B words, at each place
        period, since = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        squares = []
        for k in range(self.levels):
            block = 1 << k
            gone = max(0, lo // block - 6)                # too far behind to be met again
            self.catchers[k] = np.append(self.catchers[k][max(0, gone - self.retired[k]):],
                                         suffix[-(lo + 1) % block::block])
            self.retired[k] = max(self.retired[k], gone)
            catches = [self._catch(k, at, suffix, older) for older in (0, 1)]
            start, q, place = (np.concatenate(c) for c in zip(*catches))
            inside = (period[place] > 0) & (q % np.maximum(period[place], 1) == 0) & (since[place] <= start)
            q, first, end = joined(*(np.concatenate(x) for x in zip(
                self.growing[k], (q[~inside], start[~inside], start[~inside] + block))))
            grows = end + q + 2 * block > hi
            self.growing[k] = q[grows], first[grows], end[grows]
            for s, e, r in self._runs_around(k, q, first, end):
                if e > lo:
                    squares.append((s, e, r))
                    here = slice(max(s - lo, 0), e - lo)
                    free = period[here] == 0
                    period[here][free], since[here][free] = r, s
            self._keep(self.ended, self._runs_around(k, q[~grows], first[~grows], end[~grows]))
            before = np.append(self.tail[k], suffix)
            self.tail[k] = before[-block:]
            suffix = mix(before[:hi - lo] * np.uint64(0x9E3779B97F4A7C15) + suffix)
        return squares

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of all maximal runs of the words so far, by start and period."""
        best = dict(self.ended)
        for k in range(self.levels):
            self._keep(best, self._runs_around(k, *self.growing[k]))
        return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))

    def _catch(self, k: int, at: np.ndarray, suffix: np.ndarray, older: int):
        """(start of the block, distance, place in the append) where the last words equal a catcher's block."""
        block = 1 << k
        number = ((at - (3 * block - 2)) >> k) - older
        first = int(np.searchsorted(number, 0))
        place = first + np.flatnonzero(self.catchers[k][number[first:] - self.retired[k]] == suffix[first:])
        start = number[place] << k
        return start, at[place] - block + 1 - start, place

    def _keep(self, best: dict, runs) -> None:
        for s, e, q in runs:
            if e - s >= self.least:
                best[s, e] = min(q, best.get((s, e), q))

    def _runs_around(self, k: int, q: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Caught blocks extended to whole runs of at least two periods."""
        block = 1 << k
        enough = (end - first) + 2 * (block - 1) >= np.maximum(q, self.least - q)
        for q, first, end in zip(*(x[enough].tolist() for x in (q, first, end))):
            run = self._borders(block, q, first, end)
            if run and run[1] - run[0] >= 2 * q:
                yield *run, q

    def _borders(self, block: int, q: int, first: int, end: int):
        """The run around the blocks; None where a block beside them was caught inside a run of
        a period that divides q, which is the one to report."""
        words, left = self.words, max(0, first - block)
        off = np.flatnonzero(words[left:first] != words[left + q:first + q])
        start = left + int(off[-1]) + 1 if len(off) else left
        right = min(end + block, len(words) - q)
        stop = np.flatnonzero(words[end:right] != words[end + q:right + q])
        stop = end + int(stop[0]) + q if len(stop) else right + q
        if (not len(off) and left > 0) or stop == end + block + q:
            return None
        if not np.array_equal(words[start:stop - q], words[start + q:stop]):
            raise RuntimeError("two different blocks of words have one 64-bit hash")
        return start, stop


def find_runs(texts: list[np.ndarray], least: int = LEAST, group: int = GROUP) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each sequence of non-negative word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting = sorted((i for i, t in enumerate(texts) if len(t) >= least), key=lambda i: len(texts[i]))
    while waiting:
        mine, total = [], 0
        while waiting and (not mine or total + len(texts[waiting[-1]]) <= group):
            total += len(texts[waiting[-1]])
            mine.append(waiting.pop())
        catcher = SquareCatcher(len(texts[mine[0]]), least)
        begins, at = [], 0
        for k, i in enumerate(mine):
            begins.append(at + 1)
            at += 1 + len(texts[i])
        line = np.concatenate([np.append(-1 - k, texts[i]) for k, i in enumerate(mine)] + [[-1 - len(mine)]])
        for lo in range(0, len(line), STEP):
            catcher.append(line[lo:lo + STEP])
        found = catcher.runs()
        where = np.searchsorted(begins, [s for s, _, _ in found], "right") - 1
        for (s, e, q), k in zip(found, where.tolist()):
            out[mine[k]].append((s - begins[k], e - s, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: each run keeps its first period only."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def _slices(batches):
    """The batches cut at WORK bytes of text, as the words of a slice are held as objects; a longer
    text is a slice of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + WORK, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _runs_of(batches):
    for b in _slices(batches):
        numbers: dict[bytes, int] = {}
        texts = [(t or b"").split() for t in b.column(0).cast(pa.binary()).to_pylist()]
        coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts]
        found = find_runs(coded)
        lists = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        text = pa.array([collapse(t, runs) for t, runs in zip(texts, found)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(lists, ARROW_RUN), text],
                                         names=b.schema.names[1:] + ["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``runs`` (start, length, period; in words, by start and period) and
    ``collapsed``, the text whose runs are cut to their first period, its words joined by one space."""
    small_batches(docs.sparkSession)
    rest = without(docs, "runs", "collapsed")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*rest.schema.fields, T.StructField("runs", T.ArrayType(run)),
                           T.StructField("collapsed", T.StringType())])
    return rest.select(F.col(text_col).cast("string").alias("_pw_text"), "*").mapInArrow(_runs_of, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """Every tenth document by crc32 of its id repeats words from a place on, by the contract of op13."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def again(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                                                      lambda i: F.get(ws, at(i))), " ")).otherwise("")
    ws = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return F.when(h % 10 == 0, F.transform(F.array(ws), again)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs).withColumn("best", F.array_max(F.transform(
        "runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("shorter")))))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
