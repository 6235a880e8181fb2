"""Profiles of households: cleaning, and the children's ages in months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import full_months

OLDEST, MOST = 300, 10


def clean_profiles(profiles: DataFrame) -> DataFrame:
    """Bad values are dropped, never errors: area of six digits, dates that exist, months 0 to 300, ten children."""
    birth = lambda c: F.when(c["birth_date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c["birth_date"], "yyyy-MM-dd"))
    months = lambda c: F.when(c["age_months"].rlike(r"^[0-9]{1,3}$"), c["age_months"].try_cast("int"))
    children = F.transform("children", lambda c: F.struct(birth(c).alias("birth_date"), F.when(months(c) <= OLDEST, months(c)).alias("age_months")))
    children = F.slice(F.filter(children, lambda c: c["birth_date"].isNotNull() | c["age_months"].isNotNull()), 1, MOST)
    return profiles.withColumns({"area_code": F.when(F.col("area_code").rlike(r"^[0-9]{6}$"), F.col("area_code")), "children": children})


def profile_ages(children: Column, today: Column) -> Column:
    """Ages in request order: those with birth dates first, then those in months; the birth date wins."""
    born = F.filter(children, lambda c: c["birth_date"].isNotNull())
    rest = F.filter(children, lambda c: c["birth_date"].isNull() & c["age_months"].isNotNull())
    return F.concat(F.transform(born, lambda c: full_months(c["birth_date"], today)), F.transform(rest, lambda c: c["age_months"]))
