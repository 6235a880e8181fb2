"""Publishing a set of tables: versioned directories and a manifest of numbered entries that say which version holds.

A version is written whole before the manifest points at it; readers never see a mix. The version before is the snapshot. An entry is a small file
named by its number and created only if nobody created it before; the entry with the largest number holds. So of two writers that saw the same state one is refused
(:class:`Conflict`) and may look again. That rests on the file system creating a file once, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

DAYS = 30
MANIFEST = "number long, version string, action string, at timestamp, expires_at timestamp, tables array<string>"
#: Seconds that a reader waits for an entry that was created but not written yet; after that it counts as given up.
PATIENCE = 5.0


class Conflict(Exception):
    """Another version was published since the state was looked at."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_entry(spark: SparkSession, root: str) -> int:
    """The number of the last entry; 0: nothing was ever published."""
    at, fs = _fs(spark, f"{root}/_manifest")
    if not fs.exists(at):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(at)]  # a file a publication
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """Entries so far; those that were never written count for nothing."""
    return spark.read.schema(MANIFEST).json(f"{root}/_manifest").where("version is not null and number is not null")


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if it exists."""
    at, fs = _fs(spark, path)
    if fs.getScheme() == "file":
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _point(spark: SparkSession, root: str, version: str, action: str, tables: list[str], now: datetime, after: int) -> int:
    number, stamp = after + 1, lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%f%z")
    row = {"number": number, "version": version, "action": action, "at": stamp(now), "expires_at": stamp(now + timedelta(days=DAYS)), "tables": sorted(tables)}
    if not _create(spark, f"{root}/_manifest/{number:09d}.json", json.dumps(row) + "\n"):
        raise Conflict(f"entry {number} was written by another publication")
    return number


def new_version(now: datetime | None = None) -> str:
    """A name for a version; no two calls share one."""
    return f"{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S%f')}-{os.urandom(4).hex()}"


def stage_table(df: DataFrame, root: str, version: str, name: str) -> DataFrame:
    """Write one table of a version that doesn't hold yet, and read it back."""
    df.write.parquet(f"{root}/v={version}/{name}")
    return read(df.sparkSession, root, name, version)


def stage(tables: dict[str, DataFrame], root: str, now: datetime | None = None) -> str:
    """Write all tables as a new version that doesn't hold yet."""
    version = new_version(now)
    for name, df in tables.items():
        stage_table(df, root, version, name)
    return version


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, now: datetime | None = None) -> str:
    """Write all tables as a new version, then let the manifest point at it, after whatever was published meanwhile."""
    now = now or datetime.now(UTC)
    version = stage(tables, root, now)
    while True:
        try:
            release(spark, root, version, list(tables), now)
            return version
        except Conflict:
            continue


def release(spark: SparkSession, root: str, version: str, tables: list[str], now: datetime | None = None, after: int | None = None) -> int:
    """Let a staged version hold; :class:`Conflict` if entry ``after`` (by default the last one) isn't the last one."""
    return _point(spark, root, version, "publish", tables, now or datetime.now(UTC), last_entry(spark, root) if after is None else after)


def is_published(spark: SparkSession, root: str) -> bool:
    """Whether any version holds under ``root``."""
    return last_entry(spark, root) > 0


def current(spark: SparkSession, root: str, entry: int | None = None) -> str:
    """The version that holds, or that held by entry ``entry``; waits for an entry that is being written."""
    entry, until = entry or last_entry(spark, root), time.monotonic() + PATIENCE
    while True:
        row = _manifest(spark, root).where(F.col("number") <= entry).agg(F.max("number").alias("n"), F.max_by("version", "number").alias("v")).first()
        if row["n"] == entry or time.monotonic() > until:
            return row["v"]
        time.sleep(0.1)


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version or current(spark, root)}/{name}")


def snapshots(spark: SparkSession, root: str, now: datetime) -> DataFrame:
    """Versions that may still be restored: the one that holds, and those that haven't expired."""
    rows = _manifest(spark, root)
    return rows.groupBy("version").agg(F.max("expires_at").alias("expires_at"), F.first("tables").alias("tables")).where((F.col("expires_at") > F.lit(now)) | (F.col("version") == current(spark, root)))


def restore(spark: SparkSession, root: str, version: str, tables: list[str], now: datetime | None = None, verify: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
    """Let an earlier version hold again; refused unless it has every table asked for, if ``verify`` raises for them, or if another version is published meanwhile."""
    seen = last_entry(spark, root)
    had = _manifest(spark, root).where(F.col("version") == version).select(F.explode("tables").alias("t")).distinct()
    lost = spark.createDataFrame([(t,) for t in tables], "t string").join(had, "t", "left_anti").count()
    if lost:
        raise ValueError(f"version {version} lacks {lost} of the tables")
    if verify:
        verify({t: read(spark, root, t, version) for t in tables})
    _point(spark, root, version, "restore", tables, now or datetime.now(UTC), seen)


def clone(spark: SparkSession, source: str, target: str, tables: list[str], protected: str = "prod") -> str:
    """Publish another environment's tables here; never into the protected one."""
    if target.rstrip("/").rsplit("/", 1)[-1] == protected:
        raise ValueError(f"{protected} can't be a target")
    version = current(spark, source)  # one version, whatever is published there meanwhile
    return publish(spark, {t: read(spark, source, t, version) for t in tables}, target)
