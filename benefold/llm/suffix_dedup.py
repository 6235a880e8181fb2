"""Exact removal of long byte strings that repeat anywhere in the corpus (suffix order by prefix doubling).

Positions are ranked by *names* of growing strings. The name of a 2h-byte string is made from the pair of names
of two h-byte strings at offset h (prefix doubling: 8, 16, 32, 40 bytes, then whole strings); Spark sorts and
counts (position, name) pairs at each length, a position whose name is unique leaves, and the others are named
again at a greater length, until a name is unique or the threshold is passed.

Ranking every byte position at every length would move some 100 bytes per byte of text, so positions are thinned
without losing any repeat: of each ``min_len``-byte window only its *anchor* is ranked, the place of its smallest
40-byte name. Equal windows have equal anchors at equal offsets, so a window can repeat only if its anchor's name
does. Rounds:

1. anchors (about one in 81 bytes) by their 40-byte names; unique ones leave with all their windows;
2. the span of all windows that share an anchor; a repeated span settles all of its windows at once;
3. of the rest, blocks of 16 neighbouring windows, by the part that all have (unique: none repeats) and by the
   span (repeated: all do);
4. of the rest, single windows of ``min_len`` bytes.

Every name is counted only within its class of equal anchor names, so two different strings are confused only if
two independent 64-bit names agree. No bucket, group or round is capped.

Defined results: a null text is empty; texts shorter than ``min_len`` keep every byte; rows are told apart by a
128-bit name of (id, text), so a repeated row is a copy of itself and all of its long strings go; a null id is a value as
any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_column, join_keys, mix, stored, tidy

GRAM = 40
BLOCK = 16
_AT_BITS = 24
_PIECE = 1 << 19

#: A row by the two halves of its name, an anchor's place in it, and its farthest and nearest window before that.
ROW = ["r1", "r2"]
REF = [*ROW, "at", "hi", "lo"]
_REF = "r1 long, r2 long, at int, hi int, lo int"


def _name(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the 40-byte strings that start at each place, by doubling: 8 (the bytes), 16, 32, then 32 and 8."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(n, np.uint64)
    for k in range(8):
        part = padded[k: k + (n - k + 7) // 8 * 8].view("<u8") if n > k else np.zeros(0, np.uint64)
        eight[k::8] = part[: len(eight[k::8])]
    name = mix(eight[:-8], eight[8:])
    name = mix(name[:-16], name[16:])
    return mix(name[: n - GRAM + 1], eight[32: n - 7][: n - GRAM + 1])


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int):
    """(anchor, its 40-byte name, first and last window) for the windows that start in the given ranges.

    starts, ends: for each document, its first window and the place after its last one.
    """
    names = _gram_names(data)
    low = np.uint64((1 << _AT_BITS) - 1)
    key = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    width, have = min_len - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: -(width - have)], key[width - have:])
    place = (key & low).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    inside = np.zeros(len(place) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.zeros(len(place), bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (new | edge))
    stop = np.zeros(len(place) + 1, bool)
    stop[1:-1] = new[1:] | edge[1:]
    stop[ends] = True
    after = np.flatnonzero(stop)
    last = after[np.searchsorted(after, first, "right")] - 1
    anchor = place[first]
    return anchor, names[anchor], first, last


def _scan(min_len: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = byte_column(batch.column("t"))
            r1, r2 = (batch.column(c).to_numpy() for c in ROW)
            for b0, b1 in blocks(offsets, 1 << 19):
                for base, starts, ends, rows, part in _pieces(data, offsets, b0, b1, min_len):
                    if not len(starts):
                        continue
                    anchor, gram, first, last = _anchors(part, starts, ends, min_len)
                    row = rows[np.searchsorted(starts, first, "right") - 1]
                    raw = part.tobytes()
                    span = [_name(raw[p:q]) for p, q in zip(first.tolist(), (last + min_len).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r1[row]), pa.array(r2[row]), pa.array(anchor + base - offsets[row], pa.int32()),
                        pa.array(anchor - first, pa.int32()), pa.array(anchor - last, pa.int32()),
                        pa.array(gram.view(np.int64)), pa.array(span, pa.int64()),
                    ], names=[*REF, "gram", "span"])
    return tidy(run)


def _pieces(data, offsets, r0, r1, min_len):
    """Documents r0 to r1 at once, or one very long document piece by piece (windows stay whole)."""
    o = offsets[r0: r1 + 1]
    if o[-1] - o[0] <= _PIECE + min_len or r1 - r0 > 1:
        keep = np.flatnonzero(np.diff(o) >= min_len)
        yield o[0], o[:-1][keep] - o[0], o[1:][keep] - o[0] - min_len + 1, r0 + keep, data[o[0]: o[-1]]
        return
    for s in range(int(o[0]), int(o[1]) - min_len + 1, _PIECE):
        e = min(s + _PIECE, int(o[1]) - min_len + 1)
        yield s, np.array([0]), np.array([e - s]), np.array([r0]), data[s: e + min_len - 1]


def _snippets(min_len: int):
    """For each unsettled anchor the bytes of its windows; docs come with their list of anchors."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {k: [] for k in (*REF, "gram", "need", "bytes")}
            for r1, r2, text, todo in zip(*(batch.column(c).to_pylist() for c in (*ROW, "t", "todo")), strict=True):
                for x in todo:
                    for k, v in (("r1", r1), ("r2", r2), ("at", x["at"]), ("hi", x["hi"]), ("lo", x["lo"]), ("gram", x["gram"]), ("need", x["need"])):
                        out[k].append(v)
                    out["bytes"].append(text[x["at"] - x["hi"]: x["at"] - x["lo"] + min_len])
            yield pa.RecordBatch.from_arrays([
                *(pa.array(out[k], pa.int64()) for k in ROW), *(pa.array(out[k], pa.int32()) for k in ("at", "hi", "lo")),
                pa.array(out["gram"], pa.int64()), pa.array(out["need"], pa.bool_()), pa.array(out["bytes"], pa.binary()),
            ], names=list(out))
    return tidy(run)


def _block_names(min_len: int):
    """Blocks of 16 windows at equal distances before the anchor: name of what all have, and of their span."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, common, span = [], [], []
            for i, (hi, lo, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "bytes")), strict=True)):
                for j in range(lo // BLOCK, hi // BLOCK + 1):
                    a, b = min(hi, j * BLOCK + BLOCK - 1), max(lo, j * BLOCK)  # farthest and nearest window
                    common.append(_name(raw[hi - j * BLOCK if hi >= j * BLOCK else 0: hi - j * BLOCK - BLOCK + 1 + min_len]))
                    span.append(_name(raw[hi - a: hi - b + min_len]))
                    rows.append((i, j, a, b))
            at = np.array(rows, np.int64).reshape(-1, 4)
            take = pa.array(at[:, 0])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(take) for c in (*REF, "gram", "need")),
                *(pa.array(at[:, k], pa.int32()) for k in (1, 2, 3)),
                pa.array(common, pa.int64()), pa.array(span, pa.int64()),
            ], names=[*REF, "gram", "need", "block", "far", "near", "common", "span"])
    return tidy(run)


def _window_names(min_len: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, names = [], []
            for i, (hi, raw, todo) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hi", "bytes", "todo")), strict=True)):
                for x in todo:
                    for d in range(x["near"], x["far"] + 1):
                        rows.append((i, d, x["need"]))
                        names.append(_name(raw[hi - d: hi - d + min_len]))
            at = np.array(rows, np.int64).reshape(-1, 3)
            take = pa.array(at[:, 0])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(take) for c in (*ROW, "at", "gram")),
                pa.array(at[:, 2] > 0), pa.array(at[:, 1], pa.int32()), pa.array(names, pa.int64()),
            ], names=[*ROW, "at", "gram", "need", "back", "name"])
    return tidy(run)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys that occur on more than one row (counted map-side first)."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)


def repeated_spans(texts: DataFrame, min_len: int = 200) -> DataFrame:
    """texts: (r1 long, r2 long, t binary). Windows that also start elsewhere, as (r1, r2, first, last) ranges."""
    if min_len < 2 * GRAM:
        raise ValueError(f"min_len must be {2 * GRAM} at least")
    anchors = stored(texts.mapInArrow(_scan(min_len), f"{_REF}, gram long, span long"))
    # round 1: names of 40 bytes
    some = stored(join_keys(anchors, _repeated(anchors, "gram"), ["gram"]))
    # round 2: whole spans; of the settled ones a witness each stays in play for the anchors that aren't settled
    spans = some.groupBy("gram", "span").agg(F.count("*").alias("_n"), F.min(F.struct(*REF)).alias("w")).where("_n > 1")
    some = stored(join_keys(some, spans.select("gram", "span", F.lit(True).alias("all")), ["gram", "span"], "left"))
    rest = some.where("all is null")
    seen = spans.join(rest.select("gram").distinct(), "gram", "left_semi").select("w.*", "gram", F.lit(False).alias("need"))
    # round 3: blocks of windows
    todo = rest.select(*REF, "gram", F.lit(True).alias("need")).union(seen)
    todo = todo.groupBy(*ROW).agg(F.collect_set(F.struct("at", "hi", "lo", "gram", "need")).alias("todo"))  # as sets: a repeated row's are there once
    docs = texts.join(todo, ROW).select(*ROW, "t", "todo")
    parts = stored(docs.mapInArrow(_snippets(min_len), f"{_REF}, gram long, need boolean, bytes binary"))
    named = parts.mapInArrow(_block_names(min_len), f"{_REF}, gram long, need boolean, block int, far int, near int, common long, span long")
    named = stored(join_keys(named, _repeated(named, "gram", "block", "common"), ["gram", "block", "common"]))
    kind = ["gram", "far", "near", "span"]
    whole = _repeated(named, *kind).withColumn("all", F.lit(True))
    named = stored(join_keys(named, whole, kind, "left"))
    # round 4: single windows
    kind = ["gram", "block", "common"]
    rest = named.where("need and all is null")
    seen = named.where("not (need and all is null)").groupBy(*kind, "far", "near", "span").agg(F.min(F.struct(*REF)).alias("w"))
    seen = seen.join(rest.select(*kind).distinct(), kind, "left_semi").select("w.*", "far", "near", F.lit(False).alias("need"))
    todo = rest.select(*REF, "far", "near", "need").union(seen)
    todo = todo.groupBy(*REF).agg(F.collect_set(F.struct("far", "near", "need")).alias("todo"))
    single = parts.drop("need").join(todo, REF).select(*REF, "gram", "bytes", "todo")
    single = stored(single.mapInArrow(_window_names(min_len), "r1 long, r2 long, at int, gram long, need boolean, back int, name long"))
    twice = join_keys(single.where("need"), _repeated(single, "gram", "back", "name"), ["gram", "back", "name"])
    cols = lambda far, near: [*ROW, (F.col("at") - far).alias("first"), (F.col("at") - near).alias("last")]
    return (
        some.where("all").select(*cols(F.col("hi"), F.col("lo")))
        .union(named.where("need and all").select(*cols(F.col("far"), F.col("near"))))
        .union(twice.select(*cols(F.col("back"), F.col("back"))))
    )


def _cut(min_len: int, as_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spans, kept = [], []
            for text, todo in zip(*(batch.column(c).to_pylist() for c in ("t", "windows")), strict=True):
                out: list[list[int]] = []
                for x in sorted((x["first"], x["last"] + min_len) for x in todo or ()):
                    if out and x[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x[1])
                    else:
                        out.append([*x])
                at, left = 0, []
                for a, b in out:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join([*left, text[at:]]))
                spans.append([{"first": a, "stop": b} for a, b in out])
            names = [n for n in batch.schema.names if n not in ("windows", *(["t"] if as_text else []))]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
            kept = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spans, kind), kept], names=[*names, "spans", "kept"])
    return tidy(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, t: the text's bytes, rest: the columns ``carry``, spans: removed runs as byte ranges, kept: the other bytes) for every row.

    With ``as_text`` there is no t, and kept is UTF-8 text; of a character that was cut through nothing stays.
    """
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), rest.alias("rest"))
    first = F.xxhash64("t").bitwiseXOR(F.coalesce("id", F.lit(0))).bitwiseXOR(F.col("id").isNull().cast("long"))
    rows = rows.select("id", first.alias("r1"), F.xxhash64(F.lit(1), "t", F.lit(2)).alias("r2"), "t", "rest")
    windows = repeated_spans(rows.select(*ROW, "t"), min_len).groupBy(*ROW).agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    both = rows.join(windows, ROW, "left").select("id", "t", "rest", "windows")
    kind = both.schema["rest"].dataType.simpleString()
    t, kept = ("", "string") if as_text else ("t binary, ", "binary")
    return both.mapInArrow(_cut(min_len, as_text), f"id long, {t}rest {kind}, spans array<struct<first: int, stop: int>>, kept {kept}")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.octet_length("t").cast("long").alias("n_bytes"),
        (F.octet_length("t") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
