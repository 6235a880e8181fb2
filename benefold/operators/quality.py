"""The quality gate: all problems of a set of tables at once, as rows; one aggregate per table. An empty table is one problem; nothing else is asked of it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.age import infer_age_clauses
from .filters import ranges_overlap

# Fixed limits.
MAX_DECREASE, MAX_UNKNOWN, MIN_AREAS = 0.3, 0.45, 55
MUST_HAVE = ("benefits", "statuses", "documents", "schemes", "benefit_requires_status", "benefit_requires_doc", "benefit_in_scheme", "benefit_leads_to")
MAX_BLANK = {
    "benefits": {"benefit_id": 0.0, "title": 0.0, "scheme_id": 0.0, "area_code": 0.05, "description": 0.10, "summary": 0.10},
    "statuses": {"status_id": 0.0, "name": 0.0, "type": 0.0},
    "documents": {"doc_id": 0.0, "doc_name": 0.0},
}
SCHEMA = "table string, check string, column string, value double, limit double"


def measures(name: str, df: DataFrame) -> DataFrame:
    """(table, check, column, value): rows, blank shares of the watched columns, and for benefits unknown ages and areas; of an empty table its rows only."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    cells = [("rows", "", F.count("*").cast("double"))]
    cells += [("blank", c, F.try_divide(blank(c), F.count("*"))) for c in MAX_BLANK.get(name, {}) if c in df.columns]
    if name == "benefits" and "age_source" in df.columns:
        cells.append(("unknown_age", "age_source", F.try_divide(F.count_if(F.col("age_source") == "unknown"), F.count("*"))))
    if name == "benefits" and "area_code" in df.columns:
        cells.append(("areas", "area_code", F.countDistinct(F.nullif("area_code", F.lit(""))).cast("double")))
    row = df.agg(*(v.alias(f"v{k}") for k, (_, _, v) in enumerate(cells)))
    every = lambda x: (F.col("v0") > 0) | (x["check"] == "rows")
    parts = F.array(*(F.struct(F.lit(name).alias("table"), F.lit(check).alias("check"), F.lit(c).alias("column"), F.col(f"v{k}").alias("value")) for k, (check, c, _) in enumerate(cells)))
    return row.select(F.explode(F.filter(parts, every)).alias("x")).select("x.*")


def check_tables(spark: SparkSession, tables: dict[str, DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """(table, check, column, value, limit), a row per problem; no rows: the set may be published.

    previous: (table, rows) of the published version; without it the comparison is skipped, and so it is for empty tables. More rows are never a problem.
    """
    every = functools.reduce(DataFrame.unionByName, (measures(n, df) for n, df in tables.items()))
    limits = [(t, "blank", c, v) for t, cols in MAX_BLANK.items() for c, v in cols.items()] + [("benefits", "unknown_age", "age_source", MAX_UNKNOWN)]
    over = every.join(F.broadcast(spark.createDataFrame(limits, "table string, check string, column string, limit double")), ["table", "check", "column"]).where("value > limit")
    few = every.where(f"check = 'areas' and value < {MIN_AREAS}").withColumn("limit", F.lit(float(MIN_AREAS)))
    empty = every.where("check = 'rows' and value = 0").withColumn("limit", F.lit(1.0)).where(F.col("table").isin(*MUST_HAVE))
    lost = [(t, "missing table", "", 0.0, 1.0) for t in MUST_HAVE if t not in tables]
    columns = [(t, "missing column", c, 0.0, 1.0) for t, cols in MAX_BLANK.items() if t in tables for c in cols if c not in tables[t].columns]
    found = over.select("table", "check", "column", "value", "limit").union(few.select("table", "check", "column", "value", "limit")).union(empty.select("table", "check", "column", "value", "limit"))
    filled = F.broadcast(every.where("check = 'rows' and value > 0").select("table"))  # a row a table
    found = found.union(spark.createDataFrame(lost, SCHEMA)).union(spark.createDataFrame(columns, SCHEMA).join(filled, "table", "left_semi"))
    if previous is not None:
        before = previous.select("table", (F.col("rows") * (1 - MAX_DECREASE)).cast("double").alias("limit"))
        drop = every.where("check = 'rows' and value > 0").join(before, "table").where("value < limit and limit > 0")
        found = found.union(drop.select("table", F.lit("fewer rows"), "column", "value", "limit"))
    return found


def integrity(tables: dict[str, DataFrame], edges, keys=()) -> DataFrame:
    """(table, column, problem, n), a row per problem: rows of ``edges`` (table, column, nodes, their column) that meet no node, and keys of ``keys`` (table, columns) that are
    null or stand in several rows.

    One union of (key's digest, where it stands, how often), aggregated map-side and once more after one exchange: ends of edges and keys of nodes meet by digest,
    whatever the number of tables; a key that very many rows hold is a count by then.
    """
    roles = [(t, tuple(columns), f"{t}.{','.join(columns)}") for t, columns in keys]
    asked = [(k, "repeated key", None) for k in range(len(roles))]
    for table, column, nodes, key in edges:
        space = f"{nodes}.{key}"
        known = next((k for k, (_, _, x) in enumerate(roles) if x == space), None)
        if known is None:
            known = len(roles)
            roles.append((nodes, (key,), space))
        asked.append((len(roles), "meets no node", known))
        roles.append((table, (column,), space))

    def uses(role: int) -> DataFrame:
        table, columns, space = roles[role]
        null = functools.reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
        whole = F.to_json(F.array(F.lit(space), *(F.col(c).cast("string") for c in columns)))
        return tables[table].select(F.when(~null, F.md5(whole.cast("binary"))).alias("digest"), F.lit(role).alias("role"))

    counted = functools.reduce(DataFrame.unionByName, (uses(k) for k in range(len(roles)))).groupBy("digest", "role").agg(F.count("*").alias("n"))
    counted = counted.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("at"))  # one entry a role
    n_of = lambda k: F.coalesce(F.try_element_at("at", F.lit(k)), F.lit(0).cast("long"))
    some = F.col("digest").isNotNull()
    cells = [(k, problem, F.when(some & ((n_of(k) > 1) if known is None else (n_of(known) == 0)), n_of(k))) for k, problem, known in asked]
    cells += [(k, "null", F.when(~some, n_of(k))) for k, _, _ in asked]
    row = counted.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(f"c{i}") for i, (_, _, c) in enumerate(cells)))
    found = F.array(*(F.struct(F.lit(roles[k][0]).alias("table"), F.lit(",".join(roles[k][1])).alias("column"), F.lit(problem).alias("problem"), F.col(f"c{i}").alias("n")) for i, (k, problem, _) in enumerate(cells)))
    return row.select(F.explode(found).alias("x")).select("x.*").where("n > 0").distinct()


def age_contradictions(benefits: DataFrame) -> DataFrame:
    """Benefits whose stated bounds don't meet the range that their title says; a report, no stop."""
    rows = benefits.withColumn("said", infer_age_clauses(F.col("title"))).where("said is not null and (min_age_months is not null or max_age_months is not null)")
    return rows.where(~ranges_overlap(F.col("min_age_months"), F.col("max_age_months"), F.col("said.lo"), F.col("said.hi")))
