"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target is met by whole passes over it and a
rest, smaller than the source. The rest is fitted over the lengths: each length first gives its even share (rounded
down), the words then missing are less than a pass over the distinct lengths; they are given length by length from
the longest down until little is left, and a bounded-knapsack dynamic programme over the lengths still in stock finds the
subset whose sum comes nearest. Of each length the documents with the smallest seeded hashes (of id and text) are taken.

The programme sees lengths and counts, never documents: one task has the distinct lengths of one source, and sums up to twice what is
left to fit. Targets see one row for each source (a label of the corpus, not something that grows with its documents). Ranking
within a length is done in hash ranges, so a length shared by very many documents isn't ranked in one task.

Defined results: a null text has size 0, is never taken and adds nothing; a null source is a source of its own (the last);
no documents, no rows; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hash ranges in which the documents of one length are ranked.
RANGES = 1024
#: The dynamic programme runs over sums up to this; longer ways to it are covered by whole lengths first.
SUMS = 1 << 16
#: Documents of each length that the even share gives back to the programme.
GIVEN_BACK = 8


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over the sources by code point, null last. A target stops at ``most`` times its source's size;
    the excess goes to the others by weight. Sorted by size per weight, those that stop are the first ones: a source stops if
    its share of what the ones before leave over is above its limit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.array(*(F.lit(float(w)) for w in weights))[rank % len(weights)]
    limit = (F.col("source_size") * F.lit(most)).alias("cap")
    rows = sources.withColumn("w", weight).select("*", limit)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True)
    rows = rows.withColumn("level", first.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("opened", F.max("open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("opened"), F.least(F.col("cap"), F.col("level") * F.col("w"))).otherwise(F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def fit_lengths(budget: int, stock: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that their lengths add up as near to ``budget`` as can be."""
    total = sum(n * k for n, k in stock.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(stock)
    take = {n: k * budget // total for n, k in stock.items()}
    left = budget - sum(n * k for n, k in take.items())
    for n in sorted(stock, reverse=True):  # at most one more each, while a good deal is left
        if left - n >= min(SUMS, 4 * max(stock)) // 2 and take[n] < stock[n]:
            take[n] += 1
            left -= n
    for n in sorted(stock, reverse=True):
        if left - n > SUMS and take[n] < stock[n]:
            k = min(stock[n] - take[n], (left - SUMS) // n)
            take[n] += k
            left -= k * n
    for n in sorted(stock):  # a few of each short length are open again, so that the programme has a choice
        k = min(take[n], GIVEN_BACK, max(0, SUMS - left) // n)
        take[n] -= k
        left += n * k
    top = left + min(left, max(stock))  # a sum just above may be nearer; one farther off than none at all can't be
    reach, steps = 1, []
    for n in sorted(stock):
        room, size = min(stock[n] - take[n], top // n), 1
        while room > 0 and not reach >> left & 1:
            k = min(size, room)
            more = (reach | reach << (n * k)) & ((1 << (top + 1)) - 1)
            steps.append((n, k, reach))
            reach, room, size = more, room - k, size * 2
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    high = left + ((above & -above).bit_length() - 1) if above else None
    best = high if high is not None and high - left < left - low else low
    for n, k, had in reversed(steps):
        if not had >> best & 1:
            take[n] += k
            best -= n * k
    return {n: k for n, k in take.items() if k}


def _fit(batches: Iterator) -> Iterator:
    import pandas as pd

    for rows in batches:
        out = []
        for source, no, target, total, sizes, counts in rows[["source", "no", "target", "source_size", "sizes", "counts"]].itertuples(index=False):
            passes = int(target // total) if total else 0
            take = fit_lengths(round(target) - passes * total, dict(zip(sizes.tolist(), counts.tolist(), strict=True)))
            out += [(no, n, passes, take.get(n, 0)) for n in sizes.tolist()]
        yield pd.DataFrame(out, columns=["no", "size", "passes", "extra"])


def words(text) -> Column:
    """Size of a text: its runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
        weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row: copies is how often the mix has the document (0, 1, 2)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    rows = stored(rows.withColumn("range", F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(RANGES)).cast("int")))
    ranges = stored(rows.groupBy("source", "size", "range").agg(F.count("*").alias("n")))
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = stored(targets(sizes, weights, share, most).withColumn("no", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    same = F.col("source").eqNullSafe(F.col("_s"))
    stock = lengths.where("size > 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("x"))
    stock = stock.select(F.col("source").alias("_s"), F.col("x.size").alias("sizes"), F.col("x.n").alias("counts"))
    fitted = plan.join(stock, same).drop("_s").mapInPandas(_fit, "no long, size long, passes int, extra long")
    fitted = stored(fitted)
    numbered = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("no")
    upto = Window.partitionBy("no", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    quota = ranges.select(numbered, "size", "range", "n").join(fitted, ["no", "size"]).select(
        "no", "size", "range", "passes", (F.col("extra") - F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("room"))
    place = F.row_number().over(Window.partitionBy("no", "size", "range").orderBy("h", "id"))
    ranked = rows.select("*", numbered).withColumn("place", place).join(quota, ["no", "size", "range"], "left")
    copies = F.coalesce(F.col("passes") + (F.col("place") <= F.col("room")).cast("int"), F.lit(0))
    known = plan.select("no", "source", "source_size", "target")
    known = F.broadcast(known) if plan.count() <= 10_000 else known
    return ranked.select("id", "no", "size", copies.alias("copies")).join(known, "no").select("id", "source", "size", "source_size", "target", "copies")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
