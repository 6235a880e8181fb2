"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens as the pattern below does. Tier one: a minimal perfect hash over the vocabulary
resolves every pre-token that is itself a token (its slot's bytes are compared, so a stranger is never taken for
one). Tier two, for the misses: the merges run over a linked list of the bytes with a heap of mergeable pairs.
Each distinct miss is merged once per block of text and kept in a bounded memory.

Defined results: a null or empty text has no tokens; ids decode to exactly the UTF-8 bytes of the text; special
tokens are ordinary text; repeated rows and null ids stay as they are; other columns are carried along, but one that has the
name of a result is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_column, mix, span_names, tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The pattern that ``pretoken_starts`` follows, and the contractions that it cuts off, in its order.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK_BYTES = 1 << 18
#: Misses remembered in each of two generations.
KEPT_MISSES = 1 << 17
_DIRECT = np.uint64(1 << 62)
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK = range(5)


@functools.cache
def _char_classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space, and U+0020."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[32] = _BLANK
    return out


def pretoken_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Places where a pre-token starts, in the code points of several texts one after the other.

    A run of letters, of numbers or of other characters is a pre-token, with one U+0020 before it; the last
    character of longer white space is left to what follows; a contraction is a pre-token of its own.
    """
    n = len(points)
    kind = _char_classes()[points]
    white = kind >= _SPACE
    run = np.where(white, _SPACE, kind)
    head = np.zeros(n + 1, bool)
    head[doc_starts] = True
    head = head[:n]
    start = head.copy()
    start[1:] |= run[1:] != run[:-1]
    # white space before something else in the same text: its last character is cut off
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~head[1:]
    start |= last
    # ... and U+0020 goes with what follows
    glued = np.flatnonzero(last & (kind == _BLANK)) + 1
    start[glued] = False
    # contractions: a lone apostrophe that starts a pre-token, then the letters
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == _LETTER) & ~head[at + 1]]
    if len(at):
        p1 = points[at + 1]
        second = np.minimum(at + 2, n - 1)
        two = (at + 2 < n) & ~head[second]
        p2 = np.where(two, points[second], 0)
        length = np.zeros(len(at), np.int64)
        for text in reversed(CONTRACTIONS):
            hit = (p1 == ord(text[0])) & ((p2 == ord(text[1])) if len(text) > 1 else True)
            length[hit] = len(text)
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        after = at + 1 + length
        inside = after < n
        after = after[inside]
        start[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Token bytes by id, and a minimal perfect hash (hash, displace) from token bytes to id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([len(x) for x in self.tokens])
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(self.tokens) + bytes(8), np.uint8)
        self.longest = int(self.lengths.max())
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self._build()
        self.pairs: dict[int, int] = {}

    def _build(self) -> None:
        ids = np.array(sorted(self.ranks.values()))
        names = span_names(self.data, self.firsts[ids], self.firsts[ids + 1])
        self.n, self.n_buckets = len(ids), len(ids) // 4 + 1
        bucket = (names >> np.uint64(40)).astype(np.int64) % self.n_buckets
        self.shift = np.zeros(self.n_buckets, np.uint64)
        self.slot_id = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            rows = order[edges[b]: edges[b + 1]]
            if not len(rows):
                break
            if len(rows) == 1:  # the last free places are given directly
                slots = np.flatnonzero(self.slot_id < 0)[:1]
                self.shift[b] = _DIRECT + np.uint64(slots[0])
            else:
                d = np.uint64(0)
                while True:  # a stretch of displacements at once
                    tries = d + np.arange(256, dtype=np.uint64)
                    slots = np.stack([self._slots(np.full(256, x), tries) for x in names[rows]], axis=1)
                    ordered = np.sort(slots, axis=1)
                    good = (self.slot_id[slots] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if good.any():
                        break
                    d += np.uint64(256)
                k = int(np.argmax(good))
                self.shift[b], slots = tries[k], slots[k]
            self.slot_id[slots] = ids[rows]

    def _slots(self, names: np.ndarray, d: np.ndarray) -> np.ndarray:
        hashed = (mix(names, d) >> np.uint64(20)).astype(np.int64) % self.n
        return np.where(d >= _DIRECT, (d & (_DIRECT - np.uint64(1))).astype(np.int64), hashed)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Ids of the spans that are tokens, else -1."""
        out = self.slot_id[self._slots(names, self.shift[(names >> np.uint64(40)).astype(np.int64) % self.n_buckets])]
        size = ends - starts
        out = np.where(size == self.lengths[out], out, -1)
        live = np.flatnonzero(out >= 0)
        k = 0
        while len(live):
            same = data[starts[live] + k] == self.data[self.firsts[out[live]] + k]
            out[live[~same]] = -1
            k += 1
            live = live[same]
            live = live[size[live] > k]
        return out

    def merge(self, word: bytes) -> list[int]:
        """The tokens of a pre-token: its bytes in a linked list, the pair of lowest rank merged first, from a heap."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        known, rank = self.pairs.get, self._rank
        now = []  # rank of the pair that starts at each place, or -1
        for a, b in zip(ids, ids[1:], strict=False):
            r = known(a << 32 | b)
            now.append(rank(a, b) if r is None else r)
        now.append(-1)
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & mask, x >> bits
            if now[i] != r:
                continue  # one of the two was merged meanwhile
            j = right[i]
            k = right[i] = right[j]
            ids[i], ids[j], now[j] = r, -1, -1
            s = -1
            if k < n:
                left[k] = i
                s = known(r << 32 | ids[k])
                if s is None:
                    s = rank(r, ids[k])
                if s >= 0:
                    push(heap, s << bits | i)
            now[i] = s
            h = left[i]
            if h >= 0:
                s = known(ids[h] << 32 | r)
                if s is None:
                    s = rank(ids[h], r)
                now[h] = s
                if s >= 0:
                    push(heap, s << bits | h)
        return [x for x in ids if x >= 0]

    def _rank(self, a: int, b: int) -> int:
        found = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        if len(self.pairs) < KEPT_MISSES:
            self.pairs[a << 32 | b] = found
        return found


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


class Encoder:
    """Encodes blocks of texts; remembers the tokens of misses, packed, up to a bound."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def miss(self, word: bytes) -> bytes:
        """Packed tokens of a pre-token that isn't in ``memory``; of two generations the older one is dropped when the younger is full."""
        found = self.older.get(word)
        if found is None:
            found = array("I", self.words.merge(word)).tobytes()
        if len(word) < 64:
            if len(self.memory) >= KEPT_MISSES:
                self.older, self.memory = self.memory, {}
            self.memory[word] = found
        return found

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        starts = pretoken_starts(points, bounds[:-1])
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        raw = whole.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        s, e = place[starts], np.append(place[starts[1:]], len(data))
        ids = self.words.find(data, s, e, span_names(data, s, e))
        missing = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        merged: list[bytes] = []
        for i, j in zip(s[missing].tolist(), e[missing].tolist(), strict=True):
            word = raw[i:j]
            found = self.memory.get(word)
            merged.append(self.miss(word) if found is None else found)
        count[missing] = np.array([len(x) for x in merged], np.int64) // 4
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(ids, count)
        out[out < 0] = np.frombuffer(b"".join(merged), np.uint32)
        return out.astype("<u4"), first[np.searchsorted(starts, bounds)]


def _encode(path: str, text_col: str, out_col: str, packed: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = encoder(path)
        for batch in batches:
            _, offsets = byte_column(batch.column(text_col))
            for r0, r1 in blocks(offsets, BLOCK_BYTES):
                part = batch.slice(r0, r1 - r0)
                ids, ends = words.block([t or "" for t in part.column(text_col).to_pylist()])
                if packed:
                    raw = ids.tobytes()
                    lists = pa.array([raw[4 * i: 4 * j] for i, j in zip(ends.tolist(), ends.tolist()[1:], strict=False)], pa.binary())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out_col])
    return tidy(run)


def _decode(path: str, ids_col: str, out_col: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokens = vocabulary(path).tokens
        for batch in batches:
            column = batch.column(ids_col)
            if pa.types.is_binary(column.type):
                rows = (np.frombuffer(x.as_py(), "<u4").tolist() for x in column)
            else:
                rows = (x.as_py() or [] for x in column)
            out = pa.array([b"".join([tokens[i] for i in row]) for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])
    return tidy(run)


def default_path() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the rank files belong to another pattern than the one built here")
    return public_tokenizers.path(RANKS)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", path: str | None = None, packed: bool = False) -> DataFrame:
    """``df`` with the token ids of ``text_col``: an array of int, or packed as little-endian unsigned 32-bit integers."""
    df, kind = df.drop(out_col), "binary" if packed else "array<int>"
    return df.mapInArrow(_encode(path or default_path(), text_col, out_col, packed), f"{_schema(df)}, `{out_col}` {kind}")


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes of the ids of ``ids_col`` (an array, or packed) in ``out_col`` (binary)."""
    df = df.drop(out_col)
    return df.mapInArrow(_decode(path or default_path(), ids_col, out_col), f"{_schema(df)}, `{out_col}` binary")


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None, packed: bool = False) -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one Python process a task instead of two."""
    df, path, kind = df.drop(ids_col, out_col), path or default_path(), "binary" if packed else "array<int>"
    there, back = _encode(path, text_col, ids_col, packed), _decode(path, ids_col, out_col)
    return df.mapInArrow(lambda batches: back(there(batches)), f"{_schema(df)}, `{ids_col}` {kind}, `{out_col}` binary")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = round_trip(docs, packed=True)
    return out.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
