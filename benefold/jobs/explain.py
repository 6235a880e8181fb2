"""What an explanation of a benefit is made from: fact sheets, cache keys, the backlog; no model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dedupe_links
from ..operators.serve import cache_misses

# Label, column, longest text (None: whole).
FACTS = (
    ("制度名", "title", None), ("カテゴリ", "category", None), ("自治体", "area_name", None), ("概要", "summary", None), ("詳細", "description", 2000),
    ("対象者", "target_persons_text", None), ("その他の条件", "conditions_text", None), ("金銭的支援", "monetary_support_text", None), ("申請方法", "procedure_method", 1000),
)
CONDITIONS = (("対象になる方", "target_persons_text"), ("その他の条件", "conditions_text"))


def fact_sheets(benefits: DataFrame, facts=FACTS) -> DataFrame:
    """(benefit_id, sheet): a line ``label: value`` for each fact that isn't empty; a column that ``benefits`` lacks gives none."""
    cut = lambda c, n: F.col(c) if n is None else F.substring(c, 1, n)
    lines = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), cut(c, n))) for label, c, n in facts if c in benefits.columns]
    return benefits.select("benefit_id", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("sheet"))


def cache_key(benefit: Column, prompt_hash: Column, model: str, level: str, version: int) -> Column:
    """SHA-256 of the five parts, a line each: any change makes another key."""
    return F.sha2(F.concat_ws("\n", benefit, prompt_hash, F.lit(model), F.lit(level), F.lit(str(version))), 256)


def explanation_backlog(benefits: DataFrame, cache: DataFrame, model: str, level: str, version: int) -> DataFrame:
    """Fact sheets whose key isn't in the cache log yet."""
    sheets = fact_sheets(benefits)
    sheets = sheets.withColumn("cache_key", cache_key(F.col("benefit_id"), F.sha2("sheet", 256), model, level, version))
    return cache_misses(sheets, cache, ["cache_key"])


def display_links() -> Column:
    """Related and embedded links once per uri, without those among the form links."""
    every = dedupe_links(F.concat("related_links", "embedded_links"))
    forms = F.col("form_links")["uri"]
    return F.filter(every, lambda x: ~F.array_contains(forms, x["uri"]))


def titled_links(links: Column) -> Column:
    """Links that have a uri, which is also the title of those without one."""
    kept = F.filter(links, lambda x: F.coalesce(x["uri"], F.lit("")) != "")
    return F.transform(kept, lambda x: F.struct(F.coalesce(F.nullif(x["title"], F.lit("")), x["uri"]).alias("title"), x["uri"].alias("uri")))


def condition_texts() -> Column:
    """Array of (label, text): who a benefit is for, and its other conditions unless these are the same text."""
    (who, persons), (other, conditions) = CONDITIONS
    pair = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("text"))
    return F.array_compact(F.array(F.when(F.col(persons) != "", pair(who, persons)), F.when((F.col(conditions) != "") & ~F.col(conditions).eqNullSafe(F.col(persons)), pair(other, conditions))))
