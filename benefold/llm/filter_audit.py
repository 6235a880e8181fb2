"""Interaction audit of document filters: what each filter removes in every order in which the filters may be applied.

Every document gets a bit mask of the filters that it fails. Documents are counted by (part, mask, good, toxic) first; these few cells are
unpivoted against the steps of all orders. A window that runs over the steps of an order takes the bit-or of the earlier steps'
failures, conditional sums over the cells give the counts of a step, and a window over all steps of a filter gives its total.

Texts are read once; what is exchanged afterwards is an id, a digest and a mask a row. Copies share a digest: the smallest id of each
is aggregated map-side, and the join back can be split where one text has very many copies.

Defined results: a null text is empty, a null language is the part ''; a null id is not a copy of a smaller one, has no labels, and other rows
with its text aren't copies of it; rows that repeat an id are counted each, and aren't copies of each other; labels repeated for an id: 1 if any of them is
1; null labels are no 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import count_keys, join_keys, stored

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one document: its text, and its words in order."""
    n_words, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row; bit k of the mask says that it fails ``FILTERS[k]``. The last filter fails copies of a smaller id's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    fails = failures(F.col("text"), F.col("words"))
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS) if f in fails), F.lit(0))
    rows = stored(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("first_id"))
    copy = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
    bit = 1 << FILTERS.index("E")
    return join_keys(rows, first, ["digest"]).select("id", "part", F.when(copy, F.col("mask") + bit).otherwise(F.col("mask")).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by these."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marks = marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))))
    rows = join_keys(rows, marks, ["id"], "left")
    rows = rows.select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return count_keys(rows, "part", "mask", "good", "toxic").withColumnRenamed("_n", "n")


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every step of every order of the filters, from cells."""
    orders = ["".join(p) for p in itertools.permutations(filters)]
    long = counted.withColumn("filter_order", F.explode(F.lit(orders)))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    own = F.col("mask").bitwiseAND(F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    steps = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("own", own).withColumn("earlier", F.coalesce(F.bit_or("own").over(steps), F.lit(0)))
    fails, left = F.col("own") != 0, F.col("earlier") == 0
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    out = long.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter").agg(
        count(left & ~fails).alias("kept"),
        count(left & fails).alias("removed"),
        count(fails & ~left).alias("redundant"),
        count(fails & (F.col("own") == F.col("mask"))).alias("unique_fails"),
        count(left & fails & F.col("good")).alias("good_lost"),
        count(left & fails & F.col("toxic")).alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", total.alias("shapley"))


def op12(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audit(cells(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B",
        100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
        coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false) AS "E"
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, good, toxic, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END) || (CASE WHEN "D" THEN 'D' ELSE '' END)
        || (CASE WHEN "E" THEN 'E' ELSE '' END) AS bad, count(*) AS n FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, good, toxic, bad, n,
        contains(bad, substr(filter_order, step, 1)) AS own, translate(substr(filter_order, 1, step - 1), bad, '') <> substr(filter_order, 1, step - 1) AS before
      FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT before), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (own AND before), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (bad = filter), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (own AND NOT before AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (own AND NOT before AND toxic), 0) AS BIGINT) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""
