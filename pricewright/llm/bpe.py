"""Byte-level BPE as a streaming transducer, and the decoder for it.

Encoding splits a text into pieces by the vocabulary's pattern; no merge
crosses a piece, so the tokens of a finished piece are stable. A long piece is
read in blocks. From the merge list we compute how far back an extension can
change tokens (``lookahead``); tokens that end further back than that are
stable and are emitted, the rest stays in the buffer. A buffer thus never holds
more than the lookahead, one block and one token.

The bound: apply merges in rank order to a prefix with and without what follows
it. Both agree left of a front, at first the end of the prefix. The front moves
only if a merge (a, b) takes place in one of them with b right behind the
front, and then by the length of a. far[t] is the largest distance of the front
from the end at which t can stand behind it; one pass over the merges yields it.

Decoding maps ids to bytes and bytes to text through a state machine that
holds the bytes of at most one unfinished character.

Defined results: a null text is empty and has no tokens. Special token strings
in a text become their token, as the tokenizers library does by default
(``special=False`` reads them as text). Duplicate rows are encoded each."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm._common import small_batches, table

# Fixed value: the piece pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pieces of a text of ASCII characters only, for the faster engine.
ASCII_PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
BLOCK = 4096            # bytes added to the buffer of a long piece at a time
CACHE_PIECES = 1_000_000     # some 300 MB
NONE = 1 << 60          # rank of a pair that does not merge
LONG_PIECE = 48         # longer pieces are not kept
TEXT_PART = 1 << 20     # characters split into pieces at a time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    far: dict[bytes, int] = {}
    for a, b in merges:
        x, y = far.get(a, 0), len(a) + far.get(b, 0)
        far[a] = max(x, y)
        far[a + b] = max(far.get(a + b, 0), x, y)
    return max(far.values(), default=0)


class ByteToText:
    """UTF-8 state machine; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data) if last else self._whole(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _whole(data: bytes) -> int:
        """Where an unfinished character at the end begins."""
        n = len(data)
        for back in range(1, min(3, n) + 1):
            b = data[n - back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return n - back if need > back else n
            if b < 0x80:
                return n
        return n


class _Kept(dict):
    """Pieces met before; one that is missing is made, and kept if it is short."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple:
        out = self.make(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class Transducer:
    def __init__(self, vocab_path: str, special: bool = True):
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda s: bytes(back[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.first = [self.pairs.get(a << 20 | b, NONE) for a in self.single for b in self.single]
        self.lookahead = lookahead(merges)
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(PIECES)
        self.split_ascii = re.compile(ASCII_PIECES)
        self.gap = regex.compile(r"(?<=\p{L}) (?=\p{L})")
        found = sorted(self.special, key=len, reverse=True) if special else []
        self.specials = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.kept = _Kept(self._piece)

    # -- tokens of one piece
    def merge(self, data: bytes) -> list[int]:
        """Ids after all merges of a byte string, by rank, leftmost first among equals."""
        get, made, single, first = self.pairs.get, self.made, self.single, self.first
        ids = [single[b] for b in data]
        ranks = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        n = len(ranks)
        if n >= 64:
            return self._merge_long(ids, ranks)
        while n:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            t = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            n -= 1
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | t, NONE)
            if i < n:
                ranks[i] = get(t << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same with a heap of pairs, for byte strings of any length."""
        get, made, n = self.pairs.get, self.made, len(ids)
        nxt, prv, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)

        def offer(i):
            if i >= 0 and nxt[i] < n and (r := get(ids[i] << 20 | ids[nxt[i]], NONE)) != NONE:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or j >= n or get(ids[i] << 20 | ids[j], NONE) != r:
                continue
            ids[i] = made[r]
            dead[j] = 1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            offer(prv[i])
        return [t for t, d in zip(ids, dead) if not d]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Ids of one piece, emitted as they become stable."""
        at, buf = 0, b""
        while True:
            buf += data[at:at + max(BLOCK, self.lookahead)]
            at += max(BLOCK, self.lookahead)
            tokens = self.merge(buf)
            if at >= len(data):
                yield tokens
                return
            end, k, limit = 0, 0, len(buf) - self.lookahead
            while k < len(tokens) and end + len(self.bytes_of[tokens[k]]) <= limit:
                end += len(self.bytes_of[tokens[k]])
                k += 1
            yield tokens[:k]
            buf = buf[end:]

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """Ids joined by commas and their bytes."""
        data = piece.encode()
        ids = self.merge(data) if len(data) <= BLOCK else [i for part in self.stream(data) for i in part]
        return ",".join([self.text_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    # -- whole texts
    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts that end where a piece ends in any case."""
        at = 0
        while len(text) - at > TEXT_PART and (m := self.gap.search(text, at + TEXT_PART)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def pieces(self, text: str) -> Iterator[list[tuple]]:
        """(ids joined by commas, their bytes) of successive pieces."""
        at = 0
        marks = [(m.start(), m.end(), m.group()) for m in self.specials.finditer(text)] if self.specials else []
        for lo, hi, mark in [*marks, (len(text), len(text), None)]:
            for part in self._parts(text[at:lo] if at or lo < len(text) else text):
                split = self.split_ascii if part.isascii() else self.split
                yield list(map(self.kept.__getitem__, split.findall(part)))
            if mark is not None:
                yield [(str(self.special[mark]), mark.encode())]
            at = hi

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.pieces(text) for e in part if e[0] for i in e[0].split(",")]

    def decode(self, ids) -> str:
        state, out = ByteToText(), []
        for i in ids:
            out.append(state.feed(self.bytes_of.get(int(i), b"")))
        return "".join(out) + state.feed(b"", last=True)

    def digests(self, text: str) -> tuple[int, str, str]:
        n, first, state = 0, True, ByteToText()
        ids, shown = hashlib.sha256(), hashlib.sha256()
        for part in self.pieces(text):
            if part:
                joined = ",".join([e[0] for e in part])
                n += joined.count(",") + 1
                ids.update(joined.encode() if first else b"," + joined.encode())
                first = False
                shown.update(state.feed(b"".join([e[1] for e in part])).encode())
        shown.update(state.feed(b"", last=True).encode())
        return n, ids.hexdigest(), shown.hexdigest()


@lru_cache(maxsize=2)
def transducer(vocab_path: str, special: bool = True) -> Transducer:
    return Transducer(vocab_path, special)


def bpe_encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        t = transducer(vocab)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.encode(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.int32()))],
                names=[id_col, "ids"])
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; null ids give an empty text."""
    def run(batches):
        t = transducer(vocab)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())],
                names=[id_col, "text"])
    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, SHA-256 of the ids and of the text decoded from them, without keeping either."""
    small_batches(docs.sparkSession)

    def run(batches):
        t = transducer(vocab)
        for b in batches:
            got = [t.digests(x or "") for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
                 pa.array([g[2] for g in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
