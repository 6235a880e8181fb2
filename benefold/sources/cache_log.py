"""A log of results by key, partitioned by the key's first digits, with compaction to the latest result of each key.

Writers append batches, each a folder of its own. Compaction folds the batches that it saw into a new base, the latest row of each key, and releases it as a numbered version
together with their names (:mod:`.publish`), so readers take the base and the batches that aren't in it: no row is seen twice or lost, whoever reads,
appends or compacts meanwhile. A request reads the partitions of its own keys only.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import publish as P

#: Hexadecimal digits of a key that name its partition.
DIGITS = 2
_BASE, _BATCH = "log", "batch="


def _buckets(rows: DataFrame, key: str, digits: int) -> DataFrame:
    return rows.withColumn("bucket", F.substring(F.lower(F.col(key)), 1, digits))


def append(rows: DataFrame, root: str, key: str = "cache_key", digits: int = DIGITS) -> str:
    """Write a batch of rows, one file a task and partition; its name."""
    name = f"{_BATCH}{uuid.uuid4().hex}"
    _buckets(rows, key, digits).write.partitionBy("bucket").parquet(f"{root}/{name}")
    return name


def _batches(spark: SparkSession, root: str) -> list[str]:
    """Names of the batches that were written whole."""
    at, fs = P._fs(spark, root)
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at))  # a folder a batch
    return [n for n in names if n.startswith(_BATCH) and fs.exists(P._fs(spark, f"{root}/{n}/_SUCCESS")[0])]


def _state(spark: SparkSession, root: str) -> tuple[int, str | None, list[str]]:
    """(last entry, the base's version, names of the batches in it)."""
    entry = P.last_entry(spark, root)
    version = P.current(spark, root, entry) if entry else None
    if version is None:
        return entry, None, []
    tables = P._manifest(spark, root).where(F.col("version") == version).first()["tables"]
    return entry, version, [t for t in tables if t.startswith(_BATCH)]


def read(spark: SparkSession, root: str, buckets: list[str] | None = None) -> DataFrame | None:
    """All rows of the log (older rows of a key too, until they are folded), of some partitions if asked for; None: nothing was ever written."""
    _, version, folded = _state(spark, root)
    parts = [f"{root}/{n}" for n in _batches(spark, root) if n not in folded]
    parts += [f"{root}/v={version}/{_BASE}"] if version else []
    rows = [spark.read.option("basePath", p).parquet(p).withColumn("bucket", F.col("bucket").cast("string")) for p in parts]
    if buckets is not None:
        rows = [r.where(F.col("bucket").isin(buckets)) for r in rows]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None


def latest(rows: DataFrame, key: str = "cache_key", at: str = "generated_at") -> DataFrame:
    """The last row of each key; of rows of one time the one that compares greatest. A key of very many rows is aggregated map-side."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("x")).select(key, "x.*")


def compact(spark: SparkSession, root: str, key: str = "cache_key", at: str = "generated_at") -> str | None:
    """Fold all batches into a new base; refused with :class:`publish.Conflict` if another compaction was quicker."""
    entry, _, folded = _state(spark, root)
    seen = _batches(spark, root)
    rows = read(spark, root)
    if rows is None:
        return None
    version = P.new_version()
    # exchanged by partition and key, so a partition is written by several tasks of bounded size
    latest(rows, key, at).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("bucket").parquet(f"{root}/v={version}/{_BASE}")
    P.release(spark, root, version, [_BASE, *sorted({*folded, *seen})], after=entry)
    return version


def misses(requests: DataFrame, root: str, key: str = "cache_key", digits: int = DIGITS) -> DataFrame:
    """The requests whose key the log doesn't have. Only the partitions of asked keys are read; there are 16 to the power of ``digits`` at most."""
    spark = requests.sparkSession
    asked = [r[0] for r in _buckets(requests, key, digits).select("bucket").distinct().collect()]  # names of partitions
    rows = read(spark, root, [b for b in asked if b is not None])
    return requests if rows is None else requests.join(rows.select(key).distinct(), key, "left_anti")


def hits(requests: DataFrame, root: str, key: str = "cache_key", at: str = "generated_at", digits: int = DIGITS) -> DataFrame | None:
    """The last row of each requested key that the log has."""
    asked = [r[0] for r in _buckets(requests, key, digits).select("bucket").distinct().collect()]
    rows = read(requests.sparkSession, root, [b for b in asked if b is not None])
    return None if rows is None else latest(rows.join(requests.select(key).distinct(), key, "left_semi"), key, at).drop("bucket")
