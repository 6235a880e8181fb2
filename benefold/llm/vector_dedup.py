"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class with a count. In each pass a vector gets several random hashes (widths of a random
projection); the vectors of a label are ordered lexicographically by the concatenated hashes, and neighbours in that order are
compared: every vector meets those of its own block of ``WINDOW`` places and of the block before it, so all neighbours at most ``WINDOW`` places apart meet,
wherever blocks are cut. Places are counted over the whole order: sums by range partition, then inside of it. Vectors with all hashes equal have one place and stay
together. The links of all passes are united. A run of equal hashes that is longer than ``TILE`` (a large group of near copies) isn't cut off: it is
dealt into tiles by a hash of the id, and every pair of tiles is compared by itself.

The order is made of the distinct hashes with their counts, so that a large group is one row of it. The number of hashes grows with
the logarithm of the largest label, so that all strangers that share all hashes but the last are expected to be fewer than a block, and the number of passes with
it: at the threshold one hash separates two vectors with probability 0.067, a pair meets where all hashes of a pass but the last agree, and
passes are added until a pair at the threshold is missed in all of them with probability ``MISS`` at most (mostly less: neighbours
needn't agree even in those, and pairs above the threshold agree more often).

A pair is counted in the first pass in which it meets, so counts need no list of pairs; what leaves a window is, per
vector, its new links and the root of its group there.

Defined results: vectors that are null, empty, all zero or hold nulls or non-finite components, and rows without label,
link with nothing; the rows of one id are one vector (the smallest label, then the smallest vector); a null id is one row that links
with nothing; vectors of different lengths don't link; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_keys, stored, tidy
from .graph import components

WINDOW, TILE, MISS = 64, 1024, 1e-4
#: Vectors of a block that has a next one, at most: the last run ends in the next.
GUESTS = 3 * WINDOW
#: What is compared together.
GROUP = ("window", "p", "label", "d", "lo", "hi")
#: Width of a hash in distances of unit vectors at the threshold; then two vectors at the threshold agree in a hash as often as AGREE, and strangers as often as BY_CHANCE.
WIDTH, AGREE, BY_CHANCE = 12.0, 0.933, 0.56


def plan(largest: int) -> tuple[int, int]:
    """(hashes, passes) for labels of up to so many vectors."""
    hashes = 2 + max(2, math.ceil(math.log(max(1, largest / WINDOW)) / -math.log(BY_CHANCE)))
    return hashes, math.ceil(math.log(MISS) / math.log(1 - AGREE ** (hashes - 1)))


def _codes(threshold: float, passes: int, hashes: int, seed: int = 7):
    """For each vector and pass its concatenated hashes, as bytes in order."""
    width = WIDTH * float(np.sqrt(2 - 2 * threshold))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column("v")
            o, flat = column.offsets.to_numpy(), column.values.to_numpy()
            sizes = np.diff(o)
            codes = np.zeros((batch.num_rows, passes * hashes), ">u2")
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = flat[(o[:-1][at][:, None] + np.arange(d))].astype(np.float64)
                x /= np.abs(x).max(axis=1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                random = np.random.default_rng((seed, d))
                plane, shift = random.standard_normal((d, passes * hashes)), random.random(passes * hashes)
                codes[at] = np.clip(np.floor(x @ plane / width + shift), -30_000, 30_000) + 32_768
            raw, size = codes.tobytes(), 2 * hashes
            ends = pa.array(np.arange(0, batch.num_rows * passes + 1, passes), pa.int32())
            cut = pa.array([raw[k: k + size] for k in range(0, len(raw), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(ends, cut)], names=["rep", "codes"])
    return tidy(run)


def _places(batches: Iterator) -> Iterator:
    """Runs in sorted order, (p, label, d, code, n), with their partition and the number of vectors before them there."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy()) + before
        starts = np.concatenate([[before], ends[:-1]])[: len(ends)]
        before = int(ends[-1]) if len(ends) else before
        more = [pa.array(np.full(len(ends), part), pa.int32()), pa.array(starts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "start"])


def _links(x: np.ndarray, weight: np.ndarray, windows: np.ndarray, guest: np.ndarray, side: np.ndarray | None, threshold: float):
    """(root: first row of each row's group; links: weight of the rows that it is linked with and has met in no earlier pass). Guests don't meet each other."""
    x = x / np.abs(x).max(axis=1)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    cos = (x @ x.T) / norm[:, None] / norm
    for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12).tolist():  # the product's order of sums isn't fixed: at the threshold sum in order
        cos[i, j] = (x[i] * x[j]).sum() / (norm[i] * norm[j])
    near = (cos >= threshold) & (cos.T >= threshold)
    np.fill_diagonal(near, False)
    near &= ~(guest[:, None] & guest)
    if side is not None:
        near &= side[:, None] != side
    root = np.arange(len(x))
    if not near.any():
        return root, np.zeros(len(x), np.int64)
    while True:
        low = np.minimum(root, np.where(near, root, len(x)).min(axis=1, initial=len(x)))
        if (low == root).all():
            break
        root = low
    i, j = np.nonzero(near)
    new = np.empty(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        new[b] = ~(np.abs(windows[i[b]] - windows[j[b]]) <= 1).any(axis=1)
    return root, np.bincount(i[new], weights=weight[j[new]], minlength=len(x)).astype(np.int64)


def _compare(threshold: float):
    """Rows sorted by ``GROUP``; each of these groups is compared."""
    def groups(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in GROUP])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cut.tolist()], cut.tolist(), strict=False):
                yield batch.slice(a, b - a)
            rest = batch.slice(int(cut[-1]) if len(cut) else 0)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in groups(batches):
            if rows.num_rows < 2:
                continue
            x = rows.column("v").flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
            windows = rows.column("windows").flatten().to_numpy().reshape(rows.num_rows, -1)[:, : rows.column("p")[0].as_py()]
            lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            root, links = _links(x, rows.column("n").to_numpy(), windows, rows.column("guest").to_numpy(zero_copy_only=False), None if lo == hi else rows.column("own").to_numpy(), threshold)
            keep = (links > 0) | (root != np.arange(len(root)))
            if keep.any():
                ids = rows.column("rep").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root][keep]), pa.array(links[keep])], names=["rep", "root", "links"])
    return tidy(run)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component, kept) for every id."""
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", bad)
    good = every.where(fine).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    good = stored(good.withColumn("kind", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)))
    reps = stored(good.groupBy("label", "kind").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    hashes, passes = plan(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0)

    codes = reps.select("rep", "v").mapInArrow(_codes(threshold, passes, hashes), "rep long, codes array<binary>")
    shape = reps.select("rep", "label", F.size("v").alias("d"))
    codes = stored(shape.join(codes, "rep").select("rep", "label", "d", F.posexplode("codes").alias("p", "code")))
    key = ["p", "label", "d", "code"]
    runs = codes.groupBy(*key).agg(F.count("*").alias("n"))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartitionByRange(n_parts, *key).sortWithinPartitions(*key)
    runs = stored(runs.mapInArrow(tidy(_places), "p int, label long, d int, code binary, n long, part int, start long"))
    parts = runs.groupBy("part").agg(F.sum("n").alias("n"))  # a row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    runs = runs.join(F.broadcast(parts), "part").withColumn("window", F.floor((F.col("first") + F.col("start")) / WINDOW))
    block = ["p", "label", "d", "window"]
    sizes = runs.groupBy(*block).agg(F.sum("n").alias("size"))
    after = sizes.select("p", "label", "d", (F.col("window") - 1).alias("window"), F.col("size").alias("size_after"))
    windows = stored(runs.select(*key, "window").join(sizes, block).join(after, block, "left"))
    placed = join_keys(codes, windows, key).select("rep", "p", "window", "size", "size_after")
    placed = stored(placed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("p", "window", "size", "size_after"))).alias("x")))  # an entry for each pass
    one = ["rep", "label", "d", "n", "v"]
    ready = reps.withColumn("d", F.size("v")).join(placed, "rep").select(*one, F.col("x.window").alias("windows"), F.explode("x").alias("y"))
    at = lambda window, size, guest: F.struct(window.alias("window"), size.alias("size"), F.lit(guest).alias("guest"))
    own, after = at(F.col("y.window"), F.col("y.size"), False), at(F.col("y.window") + 1, F.col("y.size_after"), True)
    ready = ready.withColumn("z", F.explode(F.array_compact(F.array(own, F.when(F.col("y.size_after").isNotNull(), after)))))
    ready = ready.select(*one, "windows", "y.p", "z.*")
    parts = F.ceil((F.col("size") + GUESTS) / TILE).cast("int")
    ready = ready.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    ready = ready.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "size")
    ready = ready.repartition("window", "lo", "hi").sortWithinPartitions(*GROUP, "rep")
    found = stored(ready.mapInArrow(_compare(threshold), "rep long, root long, links long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.select("label", "kind", "rep", "n").join(links, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "kind", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    known = join_keys(good.select("id", "label", "kind"), known, ["label", "kind"]).select("id", "links", "root")
    out = every.select("id").distinct().join(known, "id", "left")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("component"), F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), "kept")
