"""Conversation structure repair with a generalised LR parser.

Roles must read ``(system? (user assistant)+)?``. The parser reads a conversation's
role initials through the LR table below and keeps a graph-structured stack: all
stacks that some choice of edits leads to, each with its cost and its audit, the
initials of the edits made. Per row it tries Delete, Keep and Rerole, with Inserts
before the latter two, and it merges stacks of equal top by the least (cost, audit).
At most four tops live at a time.

Equal rows are first counted and the first row of every (role, text) is found, both
by aggregates that combine before the shuffle. Then the rows, without their texts,
are dealt by ranges of (conversation, turn), so a long conversation lies in many
slices. A slice that may continue one before it is parsed from each of the four tops
a stack can have; joining the slices is then a walk over their entries and exits.
After a row has been read no audit is the beginning of another, so the least
(cost, audit) of parts is the least of the whole, and long audits are compared by
the rank of what came before. Last, the edits are replayed over the texts. Only that
walk and replay see one conversation in one task: both are streams, as is the
SHA-256 of the result, which has to be computed in order.

Defined results: a null role or text counts as one space. Null turns come first;
rows of one turn go by role, then by SHA-256 of their text, and equal rows follow
each other. A null conversation id is a conversation of its own. Other columns are
ignored. An empty table gives empty results; a conversation all of whose rows go is
empty, with an audit of deletes."""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm._common import shuffle_width, small_batches, stage, table

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}

# Dialog -> nothing | Opening Pairs;  Opening -> nothing | s;  Pairs -> Pair | Pairs Pair;  Pair -> u a
SHIFT = {(0, "s"): 7, (1, "u"): 2, (2, "a"): 4, (3, "u"): 2}
REDUCE_BEFORE = {(0, "u"): ("Opening", 0)}
REDUCE_AFTER = {4: ("Pair", 2), 5: ("Pairs", 1), 6: ("Pairs", 2), 7: ("Opening", 1)}
GOTO = {(0, "Opening"): 1, (1, "Pairs"): 3, (1, "Pair"): 5, (3, "Pair"): 6}
ACCEPT = {0, 3}
BOTTOM = (0, None)          # a stack is (state, stack below)
ROWS_OF_AUDIT = 512         # edits kept as one string before the tops are ranked anew


def _reduce(stack, rule):
    for _ in range(rule[1]):
        stack = stack[1]
    return GOTO[stack[0], rule[0]], stack


@cache
def shift(stack, symbol: str):
    """The stack after a symbol and all reductions, None where the table has no action."""
    while (stack[0], symbol) in REDUCE_BEFORE:
        stack = _reduce(stack, REDUCE_BEFORE[stack[0], symbol])
    if (stack[0], symbol) not in SHIFT:
        return None
    stack = SHIFT[stack[0], symbol], stack
    while stack[0] in REDUCE_AFTER:
        stack = _reduce(stack, REDUCE_AFTER[stack[0]])
    return stack


#: One stack for each top that can stand between two rows.
ENTRIES = {s[0]: s for s in (BOTTOM, shift(BOTTOM, "s"), shift(BOTTOM, "u"), shift(shift(BOTTOM, "u"), "a"))}


class Front:
    """The tops of the graph-structured stack: state -> (cost, rank, edits, stack, origin).

    ``rank`` orders the audits up to the last settling, ``origin`` is the top they belong to."""

    def __init__(self, stack=BOTTOM):
        self.tops = {stack[0]: (0, 0, "", stack, stack[0])}
        self.settled: list[dict] = []
        self.rows = 0

    @staticmethod
    def _offer(tops: dict, cost, rank, edits, stack, origin) -> bool:
        old = tops.get(stack[0])
        if old is None or (cost, rank, edits) < old[:3]:
            tops[stack[0]] = cost, rank, edits, stack, origin
            return True
        return False

    def inserted(self) -> dict:
        """The tops with all inserts that make one of them cheaper."""
        tops, again = dict(self.tops), list(self.tops)
        while again:
            cost, rank, edits, stack, origin = tops[again.pop()]
            for symbol in "ua":
                after = shift(stack, symbol)
                if after and self._offer(tops, cost + INSERT, rank, edits + "I", after, origin):
                    again.append(after[0])
        return tops

    def delete(self, rows: int) -> None:
        """An insert before a delete is never better than one after it, so none is tried."""
        self.tops = {s: (c + DELETE * rows, r, e + "D" * rows, k, o) for s, (c, r, e, k, o) in self.tops.items()}
        self._settle(rows)

    def read(self, initial: str, truncated: bool) -> None:
        new: dict = {}
        for cost, rank, edits, stack, origin in self.tops.values():
            self._offer(new, cost + DELETE, rank, edits + "D", stack, origin)
        for cost, rank, edits, stack, origin in self.inserted().values():
            cost += TRUNCATED * truncated
            for symbol, more, letter in ((initial, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                after = shift(stack, symbol)
                if after:
                    self._offer(new, cost + more, rank, edits + letter, after, origin)
        self.tops = new
        self._settle(1)

    def _settle(self, rows: int) -> None:
        self.rows += rows
        if self.rows >= ROWS_OF_AUDIT:
            self.rows = 0
            self.settled.append({s: (t[4], t[2]) for s, t in self.tops.items()})
            order = sorted(self.tops.values(), key=lambda t: t[1:3])
            self.tops = {t[3][0]: (t[0], i, "", t[3], t[3][0]) for i, t in enumerate(order)}

    def audit(self, top) -> str:
        parts, origin = [top[2]], top[4]
        for block in reversed(self.settled):
            origin, edits = block[origin]
            parts.append(edits)
        return "".join(reversed(parts))

    def exits(self) -> list[tuple[int, int, str]]:
        return [(s, t[0], self.audit(t)) for s, t in self.tops.items()]


def finish(tops: dict) -> tuple[int, str]:
    """The cheapest accepted (cost, audit) of tops {state: (cost, audit)}."""
    front = Front()
    ranked = sorted(tops, key=lambda s: tops[s][1])
    front.tops = {s: (tops[s][0], i, "", ENTRIES[s], s) for i, s in enumerate(ranked)}
    cost, _, edits, _, origin = min((t for s, t in front.inserted().items() if s in ACCEPT), key=lambda t: t[:3])
    return cost, tops[origin][1] + edits


# ---- rows of the conversations -------------------------------------------------------------------

def events(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Two kinds of rows: 0, the first row of a (role, text) with its text; 1, how often a row stands in a turn."""
    blank = F.btrim("text", F.lit(SPACE)) == ""
    norm = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    counted = (norm.select("conv", "turn", "role", digest, blank.alias("blank"))
               .groupBy("conv", "turn", "role", "digest", "blank").agg(F.count(F.lit(1)).alias("n")))
    complete = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1).isin(".", "!", "?")
    # null turns come first; two plain minima keep to hash aggregates, which a struct would not
    first = (norm.filter(~blank).groupBy("conv", "role", "text")
             .agg(F.max(F.col("turn").isNull()).alias("early"), F.min("turn").alias("least")))
    return (first.select("conv", F.when(~F.col("early"), F.col("least")).alias("turn"), "role", digest, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"),
                         F.lit(False).alias("blank"), complete.alias("complete"), "text")
            .unionByName(counted.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "n", "blank",
                                        F.lit(False).alias("complete"), F.lit(None).cast("string").alias("text"))))


KEY = ["conv", "turn", "role", "digest"]
NONE = object()


class Slice:
    """What a stretch of rows of one conversation says about it."""

    def __init__(self, conv, key, states):
        self.conv, self.key = conv, key
        self.fronts = {s: Front(ENTRIES[s]) for s in states}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial, n, blank, first, complete):
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        self.illegal += n - 1
        if first:
            self.truncated += not complete
            for f in self.fronts.values():
                f.read(initial, not complete)
            n -= 1
        self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
        if n:
            for f in self.fronts.values():
                f.delete(n)

    def row(self):
        paths = [{"entry": s, "exit": x, "cost": c, "audit": a} for s, f in self.fronts.items() for x, c, a in f.exits()]
        return (self.conv, *self.key, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low,
                self.high, self.first, self.last, paths)


def _types(conv, turn):
    """Fields of the slices for the given types of ids and turns."""
    path = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()),
                         T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    named = [("conv", conv), ("turn", turn), ("role", T.StringType()), ("digest", T.BinaryType()),
             *((c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")),
             ("low", turn), ("high", turn), ("first", T.StringType()), ("last", T.StringType()),
             ("paths", T.ArrayType(path))]
    return T.StructType([T.StructField(*f) for f in named])


def _batches(rows, schema, size=1000):
    """Tuples as record batches of a schema."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _tuples(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _slices(batches):
    """Rows in order of the key. The first conversation of a task may have begun in the task before."""
    now, pending = None, None
    for conv, turn, role, digest, kind, n, blank, complete in _tuples(batches):
        key = (turn, role, digest)
        if now is None or conv != now.conv:
            if now is not None:
                yield now.row()
            now = Slice(conv, key, ENTRIES if now is None else [0])
        if kind == 0:
            pending = conv, key, complete
        else:
            first = pending is not None and pending[:2] == (conv, key)
            now.add(turn, role[:1], n, blank, first, first and pending[2])
    if now is not None:
        yield now.row()


def _walk(slices):
    """Slices in order, joined to one row a conversation."""
    def done():
        gaps = high - low + 1 - turns if low is not None else 0
        return (conv, gaps, *counts, *finish({s: (c, "".join(a)) for s, (c, _, a) in tops.items()}))

    conv = NONE
    for s in slices:
        (this, _, _, _, blank, duplicate, truncated, illegal, n_turns, lowest, highest, first, last, paths) = s
        if this != conv or conv is NONE:
            if conv is not NONE:
                yield done()
            conv, counts, turns, low, high, before = this, [0, 0, 0, 0], 0, None, None, None
            tops = {0: (0, 0, [])}
        counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, illegal))]
        counts[3] += before is not None and before + first not in LEGAL
        before = last
        if lowest is not None:
            turns += n_turns - (high == lowest)
            low, high = lowest if low is None else low, highest
        new: dict = {}
        for p in paths:
            if p["entry"] in tops:
                cost, rank, parts = tops[p["entry"]]
                offer = cost + p["cost"], rank, p["audit"], parts
                if p["exit"] not in new or offer[:3] < new[p["exit"]][:3]:
                    new[p["exit"]] = offer
        order = sorted(new, key=lambda x: new[x][1:3])
        tops = {x: (new[x][0], i, [*new[x][3], new[x][2]]) for i, x in enumerate(order)}
    if conv is not NONE:
        yield done()


def _replay(batches):
    """The audit of a conversation, then its rows: the turns of the repaired conversation."""
    conv, edits, at, stack, position, pending = NONE, "", 0, BOTTOM, 0, None

    def inserts():
        nonlocal at, stack, position
        while at < len(edits) and edits[at] == "I":
            symbol = next(s for s in "ua" if shift(stack, s))
            stack, at, position = shift(stack, symbol), at + 1, position + 1
            yield conv, position, "I", None, NAMES[symbol], ""

    for this, turn, role, digest, kind, n, text, audit in _tuples(batches):
        if audit is not None:
            yield from inserts()
            conv, edits, at, stack, position, pending = this, audit, 0, BOTTOM, 0, None
        elif kind == 0:
            pending = (turn, role, digest), text
        else:
            if pending is not None and pending[0] == (turn, role, digest):
                n -= 1
                yield from inserts()
                edit, at = edits[at], at + 1
                if edit != "D":
                    position += 1
                    symbol = role[:1] if edit == "K" else next(s for s in "ua" if shift(stack, s))
                    stack = shift(stack, symbol)
                    yield conv, position, edit, turn, role if edit == "K" else NAMES[symbol], pending[1]
                pending = None
            at += n
    yield from inserts()


def _digests(batches):
    """Rows of a conversation in order: the SHA-256 of its role:text lines."""
    conv, sha = NONE, None
    for b in batches:
        for this, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv is NONE or this != conv:
                if sha is not None:
                    yield conv, sha.hexdigest()
                conv, sha = this, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
    if sha is not None:
        yield conv, sha.hexdigest()


def _in_arrow(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """mapInArrow with a function from tuples, or batches, to tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(work(batches), arrow), schema)


class Repair:
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation.
    ``turns``: conv_id, position, edit (K, R or I), turn, role, text of each row of the repaired ones."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text"):
        small_batches(rows.sparkSession)
        width = shuffle_width(rows.sparkSession)
        self.events = stage(events(rows, conv, turn, role, text), "turns")
        conv_type, turn_type = (self.events.schema[c].dataType for c in ("conv", "turn"))
        self.conv_type, self.turn_type = conv_type, turn_type
        narrow = self.events.drop("text").select(*KEY, "kind", "n", "blank", "complete")
        slices = stage(_in_arrow(narrow.repartitionByRange(width, *KEY).sortWithinPartitions(*KEY, "kind"), _slices,
                                 _types(conv_type, turn_type)), "slices")
        named = [("conv_id", conv_type), *((c, T.LongType()) for c in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType())]
        self.report = stage(_in_arrow(slices.repartition(width, "conv").sortWithinPartitions(*KEY),
                                      lambda batches: _walk(_tuples(batches)),
                                      T.StructType([T.StructField(*f) for f in named])), "repairs")

    @property
    def turns(self) -> DataFrame:
        """In order of position, a conversation's rows in one partition."""
        audits = self.report.select(F.col("conv_id").alias("conv"), F.lit(-1).alias("kind"), "audit")
        rows = (self.events.select(*KEY, "kind", "n", "text").unionByName(audits, allowMissingColumns=True)
                .repartition(shuffle_width(self.events.sparkSession), "conv")
                .sortWithinPartitions("conv", F.col("audit").isNull(), *KEY[1:], "kind"))
        named = [("conv_id", self.conv_type), ("position", T.LongType()), ("edit", T.StringType()),
                 ("turn", self.turn_type), ("role", T.StringType()), ("text", T.StringType())]
        return _in_arrow(rows, _replay, T.StructType([T.StructField(*f) for f in named]))

    @property
    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the conversations that keep a row."""
        return _in_arrow(self.turns, _digests, T.StructType([
            T.StructField("conv_id", self.conv_type), T.StructField("repaired_sha256", T.StringType())]))


def repair_conversations(rows: DataFrame, **columns) -> Repair:
    return Repair(rows, **columns)


# ---- the registered query ------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage by crc32 of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text: Column = F.when(code == 1, "").when(code == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.filter(code != 0)
            .select("conv_id", "turn", F.when(code == 4, "user").otherwise(part("role")).alias("role"),
                    text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_conversations(damaged(rows))
    ids = rows.select("conv_id").distinct()
    found, hashes = repair.report.withColumnRenamed("conv_id", "c"), repair.digests.withColumnRenamed("conv_id", "h")
    out = (ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
           .join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
