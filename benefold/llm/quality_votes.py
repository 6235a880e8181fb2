"""Text quality by votes of the nearest labelled documents in a latent-semantic space.

A text is read as a bag of hashed terms: its words in lower case, their shapes (capitals, other letters, digits and signs, no more than two of a kind
in a row), pairs of shapes, and words and pairs of words that follow themselves. Term weights are logarithms of counts times inverse document frequencies, which
cover all documents; words and shapes weigh the same. The latent space is spanned by the strongest axes of the labelled sample's weights. Every document's
vector meets all labelled vectors (a stated number, broadcast) in blocks of exact cosine products; the labels of the nearest ones vote, weighted by
similarity and by how many labelled rows each stands for.

The labelled sample is bounded: ``SAMPLE`` rows of each label at most (smallest hashes of the id, then of the text), equal texts once; rows held out are
never in it. Counts, frequencies and scores cover all rows and whole texts: long ones are read in pieces of ``PIECE`` bytes.

Defined results: null and empty texts, and texts without terms that the space knows, get the share of label 1 among the labelled rows; without labels every score is 0.5;
a null id is not held out; null labels are no labels; labels, language, source and id are no inputs of a score; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_column, give_back, mix, span_names, stored, tidy

#: Labelled rows of each label that the voters are taken from, at most.
SAMPLE = 3000
#: Hash buckets of words and of shapes (each), axes of the space, neighbours that vote.
BUCKETS, AXES, NEIGHBOURS = 1024, 96, 15
#: Bytes of text that are read at once.
PIECE = 1 << 20
#: Documents whose products with all labelled vectors are held at once.
BLOCK = 256

# Kinds of bytes: 0 white space, 1 capitals, 2 other letters, 3 digits; others are kinds of their own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR, _AGAIN = np.uint64(0x51ED27), np.uint64(0xA6A19)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term of the texts between ``offsets``; the rows of words and of shapes follow each other."""
    kind = _KIND[data]
    solid = kind != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = span_names(_LOWER[data], starts, stops)
    shown = solid.copy()
    shown[2:] &= ~((kind[2:] == kind[1:-1]) & (kind[1:-1] == kind[:-2])) | begins[2:] | begins[1:-1]
    place = np.concatenate([[0], np.cumsum(shown)])
    shapes = span_names(kind[shown], place[starts], place[stops])
    near = row[1:] == row[:-1]
    pairs = mix(mix(shapes[:-1], shapes[1:]), _PAIR)[near]
    again = near & (words[1:] == words[:-1])
    twice = (row[2:] == row[:-2]) & (words[2:] == words[:-2])
    names = [shapes, pairs, np.full(again.sum(), _AGAIN), np.full(twice.sum(), mix(np.array([_AGAIN]), _PAIR)[0])]
    rows = [row, row[1:][near], row[1:][again], row[2:][twice]]
    bucket = lambda x: (mix(x, _PAIR) >> np.uint64(32)).astype(np.int64) % BUCKETS
    return np.concatenate([row, *rows]), np.concatenate([bucket(words), *(BUCKETS + bucket(x) for x in names)])


def counts(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, count) of blocks of an Arrow string column; each row's terms are in one block, and a term of it once."""
    data, offsets = byte_column(col)
    for a, b in blocks(offsets, PIECE):
        begin, end = int(offsets[a]), int(offsets[b])
        cells: list[tuple[np.ndarray, np.ndarray]] = []
        if b - a > 1 or end - begin <= PIECE:
            row, bucket = _terms(data[begin:end], offsets[a: b + 1] - begin)
            cells.append(np.unique(row * 2 * BUCKETS + bucket, return_counts=True))
        else:
            while begin < end:  # one long text: pieces end after a word where there is one
                stop = min(end, begin + PIECE)
                if stop < end:
                    gap = np.flatnonzero(_KIND[data[begin:stop]] == 0)
                    stop = begin + int(gap[-1]) + 1 if len(gap) else stop
                row, bucket = _terms(data[begin:stop], np.array([0, stop - begin]))
                cells.append(np.unique(bucket, return_counts=True))
                begin = stop
        keys, place = np.unique(np.concatenate([k for k, _ in cells]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in cells]), len(keys))
        yield a, b - a, keys // (2 * BUCKETS), keys % (2 * BUCKETS), n


def _frequencies(batches: Iterator) -> Iterator:
    import pyarrow as pa

    seen, rows = np.zeros(2 * BUCKETS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, _, bucket, _ in counts(batch.column(0)):
            seen += np.bincount(bucket, minlength=2 * BUCKETS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([rows, *seen[at].tolist()], pa.int64())})


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the buckets, from all rows of (text)."""
    out = texts.mapInArrow(tidy(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = {r["bucket"]: r["n"] for r in out.collect()}  # one row a bucket
    seen = np.array([n.get(k, 0) for k in range(2 * BUCKETS)], float)
    return np.log((1.0 + n.get(-1, 0)) / (1.0 + seen)) + 0.05


class Space(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def weigh(rows: int, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights of some texts, dense; words and shapes have length one each."""
    x = np.zeros((rows, 2 * BUCKETS), np.float32)
    x[row, bucket] = (1 + np.log(n)) * idf[bucket]
    for half in (x[:, :BUCKETS], x[:, BUCKETS:]):
        half /= np.maximum(np.sqrt((half * half).sum(1, keepdims=True)), 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of the bounded sample, and how many labelled rows there are of each label; neither has rows held out."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (held != 0)).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).cast("int").alias("_label"))
    total = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    few = [rows.where(f"_label = {k}").orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    few = F.broadcast(few[0].union(few[1]).groupBy("_id").agg(F.max("_label").alias("_label")))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text <> ''").join(few, "_id")
    found = found.groupBy(F.xxhash64("_text").alias("h"), F.md5("_text").alias("m")).agg(F.max("_label").alias("label"), F.min("_id").alias("_id"), F.first("_text").alias("text"))
    few = [found.where(f"label = {k}").orderBy(F.xxhash64("_id"), "_id", "h", "m").limit(sample).select("text", "label") for k in (0, 1)]  # an id may have many texts
    return few[0].union(few[1]), total


def _weigh_all(idf: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            labels = np.array(batch.column(1).to_pylist())
            for a, rows, row, bucket, n in counts(batch.column(0)):
                x = weigh(rows, row, bucket, n, idf).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"label": pa.array(labels[a: a + rows], pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, axes: int = AXES) -> Space:
    """The space and its voters, from all documents' frequencies and the bounded sample of labelled rows."""
    idf = document_frequencies(docs.select(F.col(text_col).cast("string").alias("text")))
    rows, total = labelled(docs, labels, id_col, text_col, label_col, sample)
    cells = stored(rows).mapInArrow(tidy(_weigh_all(idf)), "label int, x binary").orderBy("label", "x").collect()  # twice ``sample`` rows at most
    x = np.array([np.frombuffer(r["x"], np.float16) for r in cells], np.float32).reshape(-1, 2 * BUCKETS)
    y = np.array([r["label"] for r in cells], np.int64)
    _, vectors = np.linalg.eigh((x.T @ x).astype(float))
    basis = vectors[:, ::-1][:, :axes].astype(np.float32)
    stands_for = np.array([total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    n = sum(total.values())
    return Space(idf, basis, unit(x @ basis), y, stands_for[y] if len(y) else np.zeros(0), total.get(1, 0) / n if n else 0.5)


def vote(x: np.ndarray, space: Space, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of term weights ``x``: of each row, the share of label 1 among its nearest voters, by similarity times what they stand for."""
    out = np.full(len(x), space.prior)
    if not len(space.voters):
        return out
    k = min(neighbours, len(space.voters))
    for a in range(0, len(x), BLOCK):
        likeness = unit(x[a: a + BLOCK] @ space.axes) @ space.voters.T
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(likeness, near, 1).astype(float), 0.0) * space.weights[near]
        total = w.sum(1)
        known = total > 0
        out[a: a + BLOCK][known] = np.clip((w * space.labels[near]).sum(1)[known] / total[known], 0, 1)
    return out


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for a, rows, row, bucket, n in counts(batch.column(1)):
                for b in range(0, rows, BLOCK):
                    lo, hi = np.searchsorted(row, [b, b + BLOCK])
                    found[a + b: a + min(rows, b + BLOCK)] = vote(weigh(min(BLOCK, rows - b), row[lo:hi] - b, bucket[lo:hi], n[lo:hi], model.idf), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, score double")


def op11(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
