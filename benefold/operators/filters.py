"""Predicates of the query layer. A missing bound passes in search and match, and excludes on the timeline."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the area whose benefits hold everywhere.
WIDE = "130001"


def age_in_range(age: Column, lo: Column, hi: Column, prenatal: Column | None = None) -> Column:
    ok = (lo.isNull() | (lo <= age)) & (hi.isNull() | (hi >= age))
    return ok if prenatal is None else ok | F.coalesce(prenatal, F.lit(False))


def any_age_in_range(ages: Column, lo: Column, hi: Column) -> Column:
    """Some of the ages lies in the range; no ages, no match."""
    return F.coalesce(F.exists(ages, lambda a: (lo.isNull() | (lo <= a)) & (hi.isNull() | (hi >= a))), F.lit(False))


def area_or_wide(area: Column, asked: str) -> Column:
    return area.isin(asked, WIDE)


def overlaps_stage(lo: Column, hi: Column, stage_lo: Column, stage_hi: Column, prenatal: Column, stage_prenatal: Column) -> Column:
    """Ranges overlap; unknown bounds are excluded; prenatal benefits belong to the prenatal stage alone."""
    ranges = lo.isNotNull() & hi.isNotNull() & (lo <= stage_hi) & (hi >= stage_lo) & ~F.coalesce(prenatal, F.lit(False))
    return F.when(stage_prenatal, F.coalesce(prenatal, F.lit(False))).otherwise(ranges)


def ranges_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Ranges overlap; a missing bound is open, whatever the other one is."""
    below = lambda lo, hi: lo.isNull() | hi.isNull() | (lo <= hi)
    return below(lo1, hi2) & below(lo2, hi1)


def title_like(title: Column, asked: str) -> Column:
    """Contains the keyword whatever its case; % and _ are wildcards."""
    return F.lower(title).like(f"%{asked.lower()}%")


def has_code(codes: Column, code: str) -> Column:
    """For sorting and labels, never as a filter."""
    return F.coalesce(F.array_contains(codes, code), F.lit(False))


def source_rank(source: Column) -> Column:
    return F.when(source == "explicit", 0).when(source == "inferred", 1).otherwise(2)
