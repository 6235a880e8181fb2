"""The whole job: read a registry, build the tables, check them, and let them hold only if nothing is wrong.

The tables are written one after the other beside the version that holds, and each is read back for those derived from it: the registry is read once for
``benefits`` and once for tags and documents. What was written is checked; a version that fails stays aside and the old one goes on holding. A version that another
job publishes meanwhile is compared with before this one follows. The version before is the snapshot, which can be restored until it expires.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality
from ..sources import publish as P, registry as R
from ..sources.schema import EDGES, KEYS, typed
from .rows import build_tables


class QualityError(Exception):
    """The problems that keep a version from being published, one a line."""


def row_counts(spark: SparkSession, root: str, names: list[str], version: str | None = None) -> DataFrame:
    """(table, rows) of a version, by default the one that holds."""
    counts = [P.read(spark, root, n, version).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


def verify(tables: dict[str, DataFrame]) -> None:
    """Raise if a key is null or stands in several rows, or an edge's end is no node."""
    wrong = quality.integrity(tables, EDGES, KEYS).orderBy("table", "column", "problem").collect()  # a row a problem
    if wrong:
        raise QualityError("\n".join(f"{r['table']}.{r['column']}: {r['problem']}, {r['n']} rows" for r in wrong))


def publish_records(spark: SparkSession, records: DataFrame, root: str, now: datetime | None = None) -> str:
    """The version made of the records (with record_seq); QualityError, with the old version holding, if the gate or the integrity check finds something."""
    version = P.new_version(now)
    staged = build_tables(records, lambda name, df: P.stage_table(typed(name, df), root, version, name))
    sound = False
    while True:
        seen = P.last_entry(spark, root)
        before = row_counts(spark, root, list(staged), P.current(spark, root, seen)) if seen else None
        problems = quality.check_tables(spark, staged, before).collect()  # a row a problem
        if problems:
            raise QualityError("\n".join(f"{r['table']} {r['check']} {r['column']}: {r['value']} (limit {r['limit']})" for r in problems))
        if not sound:
            verify(staged)
            sound = True
        try:
            P.release(spark, root, version, list(staged), now, seen)
            return version
        except P.Conflict:
            continue


def publish_registry(spark: SparkSession, path: str, root: str, layout: str = "jsonl", now: datetime | None = None) -> str:
    """:func:`publish_records` of the registry file under ``path``."""
    return publish_records(spark, R.read_registry(spark, path, layout), root, now)


def restore_registry(spark: SparkSession, root: str, version: str, now: datetime | None = None) -> None:
    """Let an earlier version hold again, whole and with its edges intact."""
    P.restore(spark, root, version, list(quality.MUST_HAVE), now, verify)
