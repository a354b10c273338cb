"""Conversation repair against plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from pricewright.llm import conversation_repair as C

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(initial, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def steps(row):
    initial, fault = row
    yield 3, "D", None
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        yield more, "K", initial
        yield 2 + more, "R", "u"
        yield 2 + more, "R", "a"


def cheapest(rows, merge=True):
    """Least (cost, audit) by uniform-cost search; without ``merge`` no state is ever pruned."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if merge and (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        for symbol in "ua":
            if (state, symbol) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, symbol]))
        if i < len(rows):
            for more, letter, symbol in steps(rows[i]):
                after = state if symbol is None else NEXT.get((state, symbol))
                if after is not None:
                    heapq.heappush(heap, (cost + more, audit + letter, i + 1, after))


def repaired(rows, audit):
    out, state, i = [], "", 0
    for letter in audit:
        symbol = "u" if (state, "u") in NEXT else "a"
        if letter == "I":
            out.append(({"u": "user", "a": "assistant"}[symbol], ""))
        else:
            role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            if letter == "K":
                symbol = role[:1]
            else:
                role = {"u": "user", "a": "assistant"}[symbol]
            out.append((role, text))
        state = NEXT[state, symbol]
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def expected(rows):
    kept, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in kept if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [r[1:] for r in mine]
        f = faults(pairs)
        cost, audit = cheapest(f)
        text = "\n".join(f"{r}:{t}" for r, t in repaired(pairs, audit))
        count = [sum(x == k for _, x in f) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(f))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def random_faults(rng, n):
    return [(rng.choice("suauaux"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]


def parse(rows, cuts=(), settle=None):
    """As slices: the whole by one front, or fronts from every top joined by ``_walk``."""
    pieces, begin = [], 0
    for end in [*cuts, len(rows)]:
        s = C.Slice(1, (None, "", b""), [0] if begin == 0 else C.ENTRIES)
        for initial, fault in rows[begin:end]:
            s.add(None, initial, 1, fault == "blank", fault in (None, "truncated"), fault is None)
        if end > begin:
            pieces.append(s.row())
        begin = end
    return next(C._walk(iter(pieces)))[6:]


def test_table_accepts_the_grammar():
    for n in range(7):
        for s in itertools.product("sua", repeat=n):
            stack = C.BOTTOM
            for symbol in s:
                stack = stack and C.shift(stack, symbol)
            assert bool(stack and stack[0] in C.ACCEPT) == bool(re.fullmatch("(s?(ua)+)?", "".join(s)))
    assert set(C.ENTRIES) == {0, 1, 2, 3}


def test_edits_against_all_edits():
    rng = random.Random(12)
    for _ in range(150):
        rows = random_faults(rng, rng.randrange(1, 5))
        assert parse(rows) == cheapest(rows, merge=False) == cheapest(rows)


@pytest.mark.parametrize("letters", [1, 3, 512])
def test_slices_and_settling(monkeypatch, letters):
    monkeypatch.setattr(C, "ROWS_OF_AUDIT", letters)
    rng = random.Random(letters)
    for _ in range(150):
        rows = random_faults(rng, rng.randrange(1, 40))
        cuts = sorted(rng.randrange(1, len(rows) + 1) for _ in range(rng.randrange(4)))
        assert parse(rows, cuts) == cheapest(rows)


def test_long_conversation():
    rows = [("x", None)] * 20_000 + [("u", None)]
    cost, audit = parse(rows)
    assert (cost, len(audit)) == (2 * 20_000 + 2, 20_002)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Hello.", "What?", "cut off", "a\x85", " \t", "", "yes!", "é 😀 ok.", "Hello. \n"])
            out.append((conv, turn + (turn > 4), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"]), text))
    for turn in range(700):
        out.append((99, turn, "user" if turn % 2 == 0 else "assistant", f"word {turn}" + "." * (turn % 5 > 0) if turn % 7 else "Same."))
    out += [(None, None, None, None), (None, 3, "user", None), (None, None, "user", "Hi."), (50, None, "user", "Hi."),
            (50, None, "user", "Hi."), (50, None, "assistant", "x."), (51, 5, "system", "alone."), (52, 1, "user", "Q?"),
            (52, 1, "assistant", "A."), (52, 1, "assistant", "B."), (53, 2, "user", "y" * 20_000 + ".")]
    return out + [r for r in out if r[0] == 7]


def test_query(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, audit string, cost int")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows)


def test_turns_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = C.repair_conversations(df)
    audits = {r.conv_id: r.audit for r in repair.report.collect()}
    turns = repair.turns.collect()
    for conv, audit in audits.items():
        mine = [r for r in turns if r.conv_id == conv]
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert "".join(r.edit for r in mine) == audit.replace("D", "")
    empty = C.repair_conversations(df.limit(0))
    assert not empty.report.collect() and not empty.turns.collect() and not empty.digests.collect()


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    assert not C.op12_conversation_repair(spark, str(tmp_path)).collect()
