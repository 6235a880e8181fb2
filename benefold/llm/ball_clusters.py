"""Centroid clustering of integer vectors by ball-tree filtering.

Each partition's vectors are packed, as they come, into metric trees of ``TREE`` vectors at most; a ball stores its centre, radius, count and exact
integer sum. The trees are written once to the shared folder, and every round reads them with the current centroids (a stated number
of vectors). At a ball the triangle inequality rules out centroids: one whose distance to the centre less the radius is above the least
distance plus the radius isn't nearest to any vector inside. A ball with one centroid left goes to it whole, by count and sum; others are
opened, and at the leaves the distances to the centroids left are exact integers. Float roots are used for ruling out only, with a
margin; so all results are those of comparing every vector with every centroid.

A task hands on one count and sum for each centroid; sums are decimals beyond it. No vector is exchanged or sent to the driver but the first centroids.

Defined results: vectors that are null, have not ``dims`` components, or hold a null or non-finite component are left out, and so are those with a
component of 2**20 or more in size, whose distances may not fit a long; a null id is clustered but starts no centroid; rows that repeat an id are
clustered each; fewer vectors than centroids give fewer centroids; no vectors, no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stored, tidy

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a tree and of a leaf, at most.
TREE, LEAF = 1024, 32
#: Components of this size or more are left out.
MOST = 2.0**20
TREES = "ids binary, has_id binary, vectors binary, first binary, last binary, centres binary, sums binary, radii binary"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, q): floor(scale * x) of the vectors that are kept."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.size("v") == dims)
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < MOST), F.lit(False))))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("int")).alias("q"))


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, last) of a ball tree: node k holds the vectors order[first[k]:last[k]]; nodes are in breadth-first order, the root first.

    A ball is cut at the median of the component that spreads most. A node's children are the two nodes that cut its range.
    """
    order, ranges, at = np.arange(len(vectors)), [(0, len(vectors))], 0
    while at < len(ranges):
        a, b = ranges[at]
        at += 1
        if b - a <= leaf:
            continue
        part = vectors[order[a:b]]
        spread = part.max(0).astype(np.int64) - part.min(0)
        if not spread.any():
            continue  # all equal
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], mid, kind="introselect")]
        ranges += [(a, a + mid), (a + mid, b)]
    first, last = np.array(ranges, np.int64).T
    return order, first, last


def _tree(ids: np.ndarray, has_id: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    order, first, last = build(vectors)
    v = vectors[order].astype(np.int64)
    sums = np.zeros((len(v) + 1, v.shape[1]), np.int64)
    np.cumsum(v, axis=0, out=sums[1:])
    sums = sums[last] - sums[first]
    centres = np.round(sums / (last - first)[:, None]).astype(np.int64)
    radii = np.array([((v[a:b] - c) ** 2).sum(1).max() for a, b, c in zip(first, last, centres, strict=True)], np.int64)
    parts = ids[order], has_id[order], vectors[order].astype(np.int32), first, last, centres, sums, radii
    return dict(zip((f.split()[0] for f in TREES.split(", ")), (x.tobytes() for x in parts), strict=True))


def _pack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(n: int) -> pa.RecordBatch:
        ids, has, v = (np.concatenate(x) for x in zip(*held, strict=True))
        held[:] = [(ids[n:], has[n:], v[n:])] if len(ids) > n else []
        tree = _tree(ids[:n], has[:n], v[:n])
        return pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in tree.items()})

    for batch in batches:
        ids, q = batch.column(0), batch.column(1)
        if len(ids):
            v = q.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.int32)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), v))
        while sum(len(x[0]) for x in held) >= TREE:
            yield emit(TREE)
    if held:
        yield emit(TREE)


def trees(rows: DataFrame) -> DataFrame:
    """One row for each metric tree of the vectors of (id, q), stored."""
    return stored(rows.select("id", "q").mapInArrow(tidy(_pack), TREES), **{"parquet.block.size": str(8 << 20)})


class Tree:
    def __init__(self, row: dict[str, bytes], dims: int):
        self.ids, self.has_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims)
        self.first, self.last, self.radii = (np.frombuffer(row[k], np.int64) for k in ("first", "last", "radii"))
        self.centres, self.sums = (np.frombuffer(row[k], np.int64).reshape(-1, dims) for k in ("centres", "sums"))

    def filter(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, int | None, np.ndarray | None]]:
        """(node, first, last, centroid, None) of whole balls and (node, first, last, None, centroids left) of leaves to be opened, which cut the tree's vectors."""
        apart = np.sqrt(distances(self.centres, centroids).astype(float))
        radius = np.sqrt(self.radii.astype(float))[:, None]
        margin = 1e-9 * (apart + radius) + 1e-9
        nearest = (apart + radius + margin).min(1, keepdims=True)
        left = apart - radius - margin <= nearest  # some vector of the ball may be nearest to it
        children = {}
        at = 1
        for k in range(len(self.first)):
            if at < len(self.first) and self.first[at] == self.first[k] and at > k and self.last[at] < self.last[k]:
                children[k] = at
                at += 2
        open_nodes = [(0, left[0])]
        while open_nodes:
            k, candidates = open_nodes.pop()
            candidates = candidates & left[k]
            if candidates.sum() == 1:
                yield k, self.first[k], self.last[k], int(candidates.argmax()), None
            elif k in children:
                open_nodes += [(children[k], candidates), (children[k] + 1, candidates)]
            else:
                yield k, self.first[k], self.last[k], None, np.flatnonzero(candidates)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors and centroids; by float products where these are exact."""
    dims = vectors.shape[1]
    size = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * dims * size * size < 2**53:
        a, b = vectors.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = vectors.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def _trees(batches: Iterator, dims: int) -> Iterator[Tree]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Tree({name: batch.column(name)[k].as_py() for name in batch.schema.names}, dims)


def _settle(tree: Tree, centroids: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums) by centroid, and the centroid of each vector if ``whole``, of a tree."""
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), tree.vectors.shape[1]), np.int64)
    of = np.zeros(len(tree.vectors) if whole else 0, np.int64)
    for k, a, b, one, left in tree.filter(centroids):
        if one is not None:
            counts[one] += b - a
            sums[one] += tree.sums[k]
            if whole:
                of[a:b] = one
            continue
        best = left[distances(tree.vectors[a:b], centroids[left]).argmin(1)]  # ties: the smaller number
        if whole:
            of[a:b] = best
        counts += np.bincount(best, minlength=len(centroids))
        np.add.at(sums, best, tree.vectors[a:b])
    return counts, sums, of


def _round(centroids: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        totals: list[tuple[np.ndarray, np.ndarray]] = []
        for tree in _trees(batches, centroids.shape[1]):
            n, s, _ = _settle(tree, centroids, False)
            counts += n
            sums += s
            if counts.sum() > 2**30:  # sums of components below 2**26 stay in a long
                totals.append((counts, sums))
                counts, sums = np.zeros_like(counts), np.zeros_like(sums)
        for counts, sums in [*totals, (counts, sums)]:
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(seen, pa.int32()), "n": pa.array(counts[seen]), "s": pa.array(sums[seen].tolist(), pa.list_(pa.int64()))})

    return run


def _final(centroids: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for tree in _trees(batches, centroids.shape[1]):
            _, _, of = _settle(tree, centroids, True)
            away = ((tree.vectors - centroids[of]) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict({"id": pa.array(tree.ids, mask=~tree.has_id), "cluster": pa.array(of, pa.int32()), "distance": pa.array(away, pa.int64())})

    return run


def start(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed:id``; rows of one id by their components."""
    first = rows.where("id IS NOT NULL").select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")).orderBy("h", "q").limit(clusters)
    return np.array([r["q"] for r in first.collect()], np.int64)  # ``clusters`` rows


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of (id, q)."""
    spark = rows.sparkSession
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], out)
    packed = trees(rows)
    for _ in range(rounds):
        part = packed.mapInArrow(tidy(_round(centroids)), "cluster int, n long, s array<long>")
        sums = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(centroids.shape[1])]
        for r in part.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *sums).collect():  # one row a centroid
            centroids[r["cluster"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(centroids.shape[1])]
    done = stored(packed.mapInArrow(tidy(_final(centroids)), "id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.col("cluster")
    return done.select(
        "id", "cluster", "distance", F.lit([inertia.get(k, 0) for k in range(len(names))]).cast("array<bigint>")[of].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.lit(names)[of].alias("centroid_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return cluster(quantized(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def sql() -> str:
    """DuckDB text: every vector against every centroid, round by round."""
    away = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(v, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS q FROM e
  WHERE len(v) = {DIMS} AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q AS c FROM q WHERE vec_id IS NOT NULL ORDER BY k LIMIT {CLUSTERS})"""
    for r in range(ROUNDS + 1):
        text += f",\na{r} AS MATERIALIZED (SELECT i, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT i, k, {away} AS d FROM q, c{r}) GROUP BY i)"
        if r < ROUNDS:
            text += f""",
s{r} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range(1, {DIMS} + 1)) AS j FROM a{r} JOIN q USING (i)) GROUP BY k, j),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))"""
    last = ROUNDS
    return text + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN q USING (i) JOIN c{last} USING (k)"""
