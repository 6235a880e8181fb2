"""Near-duplicate documents by ProbMinHash over weighted five-word shingles, banding and verification.

A shingle of weight w (its count in the document) is a Poisson process of rate w: its arrivals hit random
registers, and a register keeps the shingle that arrives first. The generation of arrivals stops as soon as a
shingle's next one comes later than the document's fullest register. Two documents agree in a register with
probability J_P, the probability Jaccard similarity of their weights.

A document in which some shingle is more frequent than another gets a second signature, with all weights one: two of these
agree in a register with the Jaccard similarity of the shingle sets. Where all weights are equal both are the same, so
all signatures share their buckets, and pairs are found by either similarity.

Signatures are cut into bands; documents that agree in a whole band share a bucket. In each bucket every document
is verified against one centre (the document that meets most others), so a bucket of n costs n pairs. Documents
of a bucket that are then still in another component than most of its members (the odd ones) are verified against all of
its members outside their own component, and give one link for each component they belong to: no
link between documents that meet in a bucket is lost. For that, tiles of the odd ones meet tiles of all members: a member is sent
once for each ``TILE`` odd members of its bucket, so that large groups of copies with few odd members don't make squares of rows.

Verified similarity: the larger of J_P and the Jaccard similarity of the shingle sets, ``threshold`` or more.

Defined results: words are separated by white space and lower-cased; a document of one to four words is one
shingle; documents without words (null or empty too) link with nothing; equal word sequences are one class, whatever their ids;
every row has its own result, by its text: a component is named by its smallest id, and the row of that id (of several with other texts
the one whose word sequence has the smallest hash) is kept, with all its repetitions; rows without id link with nothing and are kept;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import blocks, byte_column, join_keys, mix, span_names, stored, tidy
from .graph import components

BANDS, ROWS = 28, 7
#: Members of a bucket that are compared in one task, squared.
TILE = 256
_ONE = np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WHITE = "\t\n\x0b\x0c\r "


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5):
    """(document, shingle name, count) of all rows, sorted by document and name; documents that have words."""
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = ~space[heads]
    s = np.flatnonzero(start)
    stop = np.append(space, True)
    stop[offsets[1:]] = True
    at = np.flatnonzero(stop)
    e = at[np.searchsorted(at, s, "right")]
    words = span_names(data, s, e)
    doc = np.searchsorted(offsets, s, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    name = words.copy()
    for k in range(1, n):  # the name of words i to i+k within the document
        name[:-k] = np.where(doc[:-k] == doc[k:], mix(name[:-k], words[k:]), name[:-k])
    last = first[doc] + np.maximum(count[doc] - n, 0)
    keep = np.arange(len(doc)) <= last
    doc, name = doc[keep], name[keep]
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    return doc[at], name[at], np.diff(np.append(at, len(doc)))


def prob_minhash(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, n_docs x m: in each register the shingle of the first arrival (0: the document has none)."""
    time = np.full(n_docs * m, np.inf)
    best = np.zeros(n_docs * m, np.uint64)
    clock = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        draw = mix(name, np.uint64(step))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = doc * m + (mix(draw, _ONE) >> np.uint64(33)).astype(np.int64) % m
        np.minimum.at(time, register, clock)
        won = time[register] == clock
        best[register[won]] = name[won]
        limit = time.reshape(n_docs, m).max(axis=1)
        alive = clock < limit[doc]
        doc, name, weight, clock = doc[alive], name[alive], weight[alive], clock[alive]
    return best.reshape(n_docs, m)


def _kind(text: bytes) -> bytes:
    """Name of a word sequence."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key, sig[:, b * rows + r])
        keys[:, b] = key
    return keys


def signed_bands(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, documents x 2 bands: by weights and as a set; whether the weights are uneven)."""
    by_weight = _bands(prob_minhash(doc, name, weight, n_docs, bands * rows), bands, rows)
    first = np.searchsorted(doc, np.arange(n_docs))
    uneven = np.maximum.reduceat(weight, first) > np.minimum.reduceat(weight, first)
    as_set = by_weight.copy()
    if uneven.any():
        mine, own = uneven[doc], np.cumsum(uneven) - 1
        as_set[uneven] = _bands(prob_minhash(own[doc[mine]], name[mine], np.ones(int(mine.sum())), int(uneven.sum()), bands * rows), bands, rows)
    return np.concatenate([by_weight, as_set], axis=1), uneven


def _sign(bands: int, rows: int, words: int):
    """Every row with the name of its word sequence and its bands, 2 x ``bands`` if its weights are uneven; neither without words or id."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = byte_column(batch.column("t"))
            known = np.asarray(batch.column("id").is_valid())
            for r0, r1 in blocks(offsets, 1 << 19):
                part, o = data[offsets[r0]: offsets[r1]], offsets[r0: r1 + 1] - offsets[r0]
                doc, name, weight = shingles(part, o, words)
                there = np.unique(doc)
                kinds: list[bytes | None] = [None] * (r1 - r0)
                values, size = np.zeros(0, np.uint64), np.zeros(r1 - r0, np.int64)
                if len(there):
                    keys, uneven = signed_bands(np.searchsorted(there, doc), name, weight, len(there), bands, rows)
                    asked = known[r0 + there]
                    values = keys[np.repeat([[True, False]], bands, axis=1) & asked[:, None] | (uneven & asked)[:, None]]
                    size[there] = bands * (asked + (uneven & asked).astype(int))
                    raw = part.tobytes()
                    for i in there[asked].tolist():
                        kinds[i] = _kind(raw[o[i]: o[i + 1]])
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(r0, r1 - r0), pa.array(kinds, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64))),
                ], names=["id", "kind", "bands"])
    return tidy(run)


def _shingle_lists(words: int):
    """Shingles and counts of the texts that are the asked word sequence."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = byte_column(batch.column("t"))
            for r0, r1 in blocks(offsets, 1 << 19):
                part, o = data[offsets[r0]: offsets[r1]], offsets[r0: r1 + 1] - offsets[r0]
                doc, name, weight = shingles(part, o, words)
                ends = pa.array(np.searchsorted(doc, np.arange(r1 - r0 + 1)), pa.int32())
                raw, asked = part.tobytes(), batch.column("kind").slice(r0, r1 - r0).to_pylist()
                right = pa.array([_kind(raw[x:y]) == k for x, y, k in zip(o.tolist(), o.tolist()[1:], asked, strict=False)], pa.bool_())
                yield pa.RecordBatch.from_arrays([
                    batch.column("kind").slice(r0, r1 - r0), batch.column("bands").slice(r0, r1 - r0),
                    pa.ListArray.from_arrays(ends, pa.array(name.view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(weight, pa.int32())),
                ], names=["kind", "bands", "sh", "w"]).filter(right)
    return tidy(run)


def similarity(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the probability Jaccard and the set Jaccard similarity of two weighted sets (names ascending as unsigned)."""
    sa, sb = sa.view(np.uint64), sb.view(np.uint64)
    at = np.searchsorted(sb, sa)
    at[at == len(sb)] = 0
    ia = np.flatnonzero(sb[at] == sa)
    if not len(ia):
        return 0.0
    ib = at[ia]
    n = len(sa) + len(sb) - len(ia)
    plain = len(ia) / n
    if len(ia) == n and (wa[ia] * wb.sum() == wb[ib] * wa.sum()).all():
        return 1.0
    if (wa == wa[0]).all() and (wb == wb[0]).all():
        return plain
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    a, b = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    above = only_a + np.cumsum(a[::-1])[::-1]  # sum of a where the ratio a/b is as large, with what only A has
    below = only_b + np.concatenate([[0.0], np.cumsum(b)[:-1]])
    return max(plain, float((1.0 / (above / a + below / b)).sum()))


def _verify(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = []
            for c in ("sa", "wa", "sb", "wb"):
                x = batch.column(c)
                cols.append((x.offsets.to_numpy(), x.values.to_numpy()))
            good, value = [], []
            for i in range(batch.num_rows):
                v = similarity(*(x[o[i]: o[i + 1]] for o, x in cols))
                if v >= threshold:
                    good.append(i)
                    value.append(v)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(value, pa.float64())], names=["a", "b", "similarity"])
    return tidy(run)


def _odd_links(threshold: float, n_bands: int):
    """Links of a tile's odd members to members of other components: one for each member and component."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        key = key[0]
        kinds, root, as_odd, own, odd = (rows[c].to_numpy() for c in ("kind", "root", "as_odd", "own", "odd"))
        sh, w = rows["sh"].tolist(), rows["w"].tolist()
        first = np.stack([x[:n_bands] for x in rows["bands"]])
        last = np.stack([x[-n_bands:] for x in rows["bands"]])  # the same where weights are even
        band = int(np.flatnonzero((first[0] == key) | (last[0] == key))[0])
        at = np.flatnonzero(~as_odd)
        found = []
        for i in np.flatnonzero(as_odd).tolist():
            a, b = first[i, :band], last[i, :band]
            met = ((first[at, :band] == a) | (first[at, :band] == b) | (last[at, :band] == a) | (last[at, :band] == b)).any(axis=1)
            linked = set()
            for j in at[(root[at] != root[i]) & ~met].tolist():  # a pair is looked at in the band where it meets first
                if odd[j] and kinds[j] <= kinds[i]:
                    continue  # and of two odd ones by the smaller
                if root[j] not in linked and similarity(sh[i], w[i], sh[j], w[j]) >= threshold:
                    linked.add(root[j])
                    found.append((kinds[i], kinds[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)
    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(id, kind, component, kept) for every row: the name of its word sequence, the smallest id of its class, and whether the row stands for the class."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("t"))
    signed = stored(texts.mapInArrow(_sign(bands, rows, words), "id long, kind binary, bands array<long>"))
    reps = signed.where("kind is not null").groupBy("kind").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    reps = stored(reps)
    keys = reps.select("kind", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meet = stored(join_keys(keys, shared, ["key"]))
    score = meet.groupBy("kind").agg(F.sum("n").alias("score"))
    meet = stored(meet.join(score, "kind").select("key", "kind", "score"))
    centre = meet.groupBy("key").agg(F.max_by("kind", F.struct("score", "kind")).alias("centre"))
    pairs = join_keys(meet, centre, ["key"]).where("kind <> centre").select(F.greatest("kind", "centre").alias("a"), F.least("kind", "centre").alias("b"))

    wanted = reps.join(meet.select("kind").distinct(), "kind", "left_semi")
    lists = texts.join(wanted, "id").mapInArrow(_shingle_lists(words), "kind binary, bands array<long>, sh array<long>, w array<int>")
    lists = stored(lists.dropDuplicates(["kind"]))  # an id may have several rows of one word sequence

    def verified(found: DataFrame) -> DataFrame:
        found = found.distinct()
        found = found.join(lists.select(F.col("kind").alias("b"), F.col("sh").alias("sb"), F.col("w").alias("wb")), "b")
        found = found.join(lists.select(F.col("kind").alias("a"), F.col("sh").alias("sa"), F.col("w").alias("wa")), "a")
        return found.mapInArrow(_verify(threshold), "a binary, b binary, similarity double")

    links = stored(verified(pairs))
    root = components(links)
    placed = meet.join(root.withColumnRenamed("node", "kind"), "kind", "left").select("key", "kind", F.coalesce("root", "kind").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    most = most.where("parts > 1").select("key", F.col("x.root").alias("most"), F.ceil((F.col("n") - F.col("x.n")) / TILE).cast("int").alias("odd_tiles"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    split = stored(join_keys(placed, most, ["key"]).select("key", "kind", "root", (F.col("root") != F.col("most")).alias("odd"), "odd_tiles", "tiles"))
    dealt = lambda n: F.pmod(F.xxhash64("kind", F.lit(3)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_odd = split.where("odd").select("key", "kind", "root", "odd", F.lit(True).alias("as_odd"), dealt(F.col("odd_tiles")).alias("tile"), upto("tiles").alias("own"))
    as_any = split.select("key", "kind", "root", "odd", F.lit(False).alias("as_odd"), dealt(F.col("tiles")).alias("own"), upto("odd_tiles").alias("tile"))
    tiles = as_odd.unionByName(as_any).join(lists, "kind")
    more = stored(tiles.groupBy("key", "tile", "own").applyInPandas(_odd_links(threshold, bands), "a binary, b binary"))
    root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))

    placed = stored(reps.select("kind", "id").join(root.withColumnRenamed("node", "kind"), "kind", "left").select("kind", "id", F.coalesce("root", "kind").alias("root")))
    named = placed.groupBy("root").agg(F.min(F.struct("id", "kind")).alias("x"))
    named = join_keys(placed, named, ["root"]).select("kind", F.col("x.id").alias("component"), F.col("x.kind").alias("keeper"))
    known = join_keys(signed.select("id", "kind"), named, ["kind"], "left")
    kept = F.coalesce((F.col("component") == F.col("id")) & (F.col("keeper") == F.col("kind")), F.lit(True))
    return known.select("id", "kind", F.coalesce("component", "id").alias("component"), kept.alias("kept"))


def _keepers(batches: Iterator) -> Iterator:
    """Rows that stand for their class, with the name of their word sequence; rows without words or without id, with null."""
    import pyarrow as pa

    for batch in batches:
        kinds, right = [], []
        for i, t, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "kinds")), strict=True):
            kind = _kind(t.encode()) if i is not None and t.strip(_WHITE) else None
            kinds.append(kind)
            right.append(kind is None or kind in (asked or ()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kinds, pa.binary()), batch.column("row")], names=["id", "kind", "row"]).filter(pa.array(right, pa.bool_()))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class in :func:`near_duplicates`, one of each; rows without words or without id all stay.

    Of rows with one id and one word sequence the smallest stays (in order of the columns, which have to be orderable), so reruns agree.
    """
    known = near_duplicates(docs, id_col, text_col, threshold)
    kept = known.where("kept and kind is not null").groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("t"), F.struct("*").alias("row"))
    rows = join_keys(rows, kept, ["id"], "left").select("id", "t", "kinds", "row")
    schema = StructType([StructField("id", LongType()), StructField("kind", BinaryType()), rows.schema["row"]])
    rows = rows.mapInArrow(tidy(_keepers), schema)
    one = rows.groupBy("id", "kind", F.when(F.col("kind").isNull(), F.col("row")).alias("other")).agg(F.min("row").alias("row"), F.count("*").alias("n"))
    times = F.when(F.col("kind").isNull(), F.col("n")).otherwise(1)
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"), "kept")
