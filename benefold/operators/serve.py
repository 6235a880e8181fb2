"""The query layer: search, batch match, next steps, timeline, neighbourhoods, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored
from . import filters as P

# Fixed values.
SINGLE_PARENT, DISABILITY = "088", "090"
LABELS = {"single_parent": "ひとり親家庭", "disability": "障がいのあるお子さん"}
RELATIONS = ("REQUIRES_BENEFIT", "SHARED_DOC", "NEXT_STEP")
STAGES = (("prenatal", None, None), ("0y", 0, 11), ("1y", 12, 23), ("2y", 24, 35), ("3-5y", 36, 71), ("6-11y", 72, 143), ("12-14y", 144, 179), ("15-18y", 180, 227))
PREFIX, STEPS, SALTS = 30, 80, 16
#: Profiles that are given one list of steps at once.
DEALT = 4096
#: Lists beside those of ages (no age is as large), and the place of benefits whatever their area.
PRENATAL, ANY, EVERYWHERE = 1 << 40, (1 << 40) + 1, "*"
#: Distinct bounds of ages up to which their codes are broadcast.
MOST_CODES = 1 << 16
LO, HI = "effective_min_age_months", "effective_max_age_months"


def search(benefits: DataFrame, q: str | None = None, category: str | None = None, area: str | None = None, age: int | None = None, limit: int = 30) -> DataFrame:
    """Filtered benefits by title, or by how sure the age is and title when an age is asked for."""
    rows = benefits
    if q:
        rows = rows.where(P.title_like(F.col("title"), q))
    if category:
        rows = rows.where(F.col("category") == category)
    if area:
        rows = rows.where(P.area_or_wide(F.col("area_code"), area))
    order = [F.col("title"), F.col("benefit_id")]
    if age is not None:
        rows = rows.where(P.age_in_range(F.lit(age), F.col(LO), F.col(HI)))
        order = [P.source_rank(F.col("age_source")), *order]
    return rows.orderBy(*order).limit(min(limit, 100))


def _nodes(low: Column, stop: Column, depth: int) -> Column:
    """Array of the ranges of codes, each a power of two long and aligned, that together are ``low`` up to ``stop``, which is left out: a few for each power."""
    parts = []
    for k in range(depth + 1):
        a, b = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(stop, k)
        parts += [F.when((a < b) & (a % 2 == 1), _node(k, a, depth)), F.when((a < b) & (b % 2 == 1), _node(k, b - 1, depth))]
    return F.array_compact(F.array(*parts))


def _node(k: int, at: Column, depth: int) -> Column:
    return at + (k << depth + 1)


def _above(code: Column, depth: int) -> Column:
    """Array of the ranges that hold a code."""
    return F.array(*(_node(k, F.shiftright(code, k), depth) for k in range(depth + 1)))


def match(profiles: DataFrame, benefits: DataFrame, limit: int = 60) -> DataFrame:
    """For every profile its first benefits: (profile_id, rank, the benefit's columns, matched ages, attributes, reasons).

    profiles: profile_id, area_code, ages (array of months, in request order), is_pregnant, is_single_parent, has_disability.
    """
    full = ranked_needs(profiles, benefits, limit).join(benefits, "benefit_id")
    out = profiles.withColumnRenamed("area_code", "p_area").withColumn("need_id", _need_id("p_area"))
    return explained(out.join(full, "need_id").drop("need_id"))


def ranked_needs(profiles: DataFrame, benefits: DataFrame, limit: int = 60, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(need_id, rank, benefit_id, and of sp, dis and is_prenatal those asked for): :func:`need_lists`, a row for each benefit."""
    best = need_lists(profiles, benefits, limit, attributes)
    return best.select("need_id", F.posexplode("first").alias("pos", "y")).select("need_id", (F.col("pos") + 1).alias("rank"), "y.benefit_id", *(F.col(f"y._{c}").alias(c) for c in attributes))


def need_lists(profiles: DataFrame, benefits: DataFrame, limit: int = 60, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(need_id, first): the first benefits, in order, of what profiles ask for; profiles that ask for the same share a need.

    No profile is joined with all benefits of an area. Months are coded by how many of the distinct bounds of all age ranges lie at or below them, so
    no month is out of reach and a missing bound is the first or the last code. A benefit is listed under the few aligned ranges of codes that make up its age
    range (and under "prenatal" and "any"); of each area, range and order of attributes only the first ``limit`` stay. An asked age is
    looked up in the ranges that hold it, once for all profiles, and again only the first ``limit`` stay. A need (area, set of ages, flags) merges
    the lists of its ages for its area and for the region-wide code, and is ranked once for all of its profiles. Region-wide lists, which
    all needs read, are dealt over salts. All joins are on equal keys, and none gives more than ``limit`` rows for each key of the other side.
    """
    flags = ["sp_first", "dis_first"]
    code = lambda c: P.has_code(F.col("target_codes"), c)
    bounds = benefits.select(F.explode(F.array(F.col(LO).cast("long"), F.col(HI).cast("long") + 1)).alias("month")).where("month is not null").distinct()
    n_codes = bounds.count()
    depth = n_codes.bit_length()
    rows = benefits.select("benefit_id", F.coalesce("area_code", F.lit("")).alias("area"), LO, HI, F.coalesce("is_prenatal", F.lit(False)).alias("is_prenatal"), "title",
                           P.source_rank(F.col("age_source")).alias("source"), code(SINGLE_PARENT).alias("sp"), code(DISABILITY).alias("dis"))
    first_needs = profiles.select(_need_id("area_code").alias("need_id"), F.col("area_code").alias("n_area"), F.array_sort(F.array_distinct("ages")).alias("n_ages"),
                                  F.coalesce("is_pregnant", F.lit(False)).alias("is_pregnant"), F.coalesce("is_single_parent", F.lit(False)).alias("sp_first"), F.coalesce("has_disability", F.lit(False)).alias("dis_first"))
    needs = first_needs.dropDuplicates(["need_id"])
    # what a need asks for: areas, and ages or one of the two other lists
    pregnant = F.when(F.col("is_pregnant"), F.array(F.lit(PRENATAL))).otherwise(F.array().cast("array<long>"))
    asks = F.concat(F.transform("n_ages", lambda m: m.cast("long")), pregnant)
    asks = F.when(F.size(asks) > 0, asks).otherwise(F.array(F.lit(ANY)))
    places = F.when(F.col("n_area").isNull(), F.array(F.lit(EVERYWHERE))).otherwise(F.array_distinct(F.array("n_area", F.lit(P.WIDE))))
    asked = needs.select("need_id", *flags, F.explode(places).alias("area"), asks.alias("asks")).withColumn("ask", F.explode("asks")).drop("asks")
    orders = asked.select("area", "ask", *flags).distinct()
    # codes of bounds and of asked ages; a row for each distinct month
    months = bounds.withColumn("bound", F.lit(1)).union(orders.select("ask", F.lit(0)).where(F.col("ask") < PRENATAL).distinct()).groupBy("month").agg(F.max("bound").alias("bound"))
    codes = months.select("month", "bound", F.sum("bound").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("code"))
    of_bound = codes.where("bound = 1").select("month", "code")
    of_bound = F.broadcast(of_bound) if n_codes <= MOST_CODES else of_bound

    order = [F.when(F.col("sp_first"), ~F.col("sp")).otherwise(False).alias("o1"), F.when(F.col("dis_first"), ~F.col("dis")).otherwise(False).alias("o2"), F.col("source").alias("o3"),
             F.col(LO).isNull().alias("o4"), F.col(LO).alias("o5"), F.col("title").alias("o6"), "benefit_id"]
    names = ["o1", "o2", "o3", "o4", "o5", "o6", "benefit_id"]
    told = [F.col(c).alias(f"_{c}") for c in attributes]
    carried = [f"_{c}" for c in attributes]

    def first(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_rn") <= limit).drop("_rn")

    other = F.when(F.col("is_prenatal"), F.array(F.lit(PRENATAL), F.lit(ANY))).otherwise(F.array(F.lit(ANY)))
    coded = rows.join(of_bound.select(F.col("month").alias("_lo"), F.col("code").alias("_low")), F.col(LO) == F.col("_lo"), "left")
    coded = coded.join(of_bound.select(F.col("month").alias("_hi"), F.col("code").alias("_stop")), F.col(HI).cast("long") + 1 == F.col("_hi"), "left").drop("_lo", "_hi")
    listed = coded.withColumn("node", F.explode(F.concat(_nodes(F.coalesce("_low", F.lit(0)), F.coalesce("_stop", F.lit(n_codes + 1)), depth), other))).drop("_low", "_stop")
    listed = listed.withColumn("area", F.explode(F.array("area", F.lit(EVERYWHERE)))).where("area <> ''")
    listed = first(listed, ["area", "node", "sp", "dis"], ["source", F.col(LO).asc_nulls_last(), "title", "benefit_id"])
    each = orders.select("area", *flags).distinct()
    listed = first(listed.join(each, "area").select("area", "node", *flags, *order, *told), ["area", "node", *flags], names)
    of_ask = codes.select(F.col("month").alias("ask"), "code")
    above = F.when(F.col("code").isNull(), F.array("ask")).otherwise(_above(F.col("code"), depth))
    found = orders.join(of_ask, "ask", "left").withColumn("node", F.explode(above)).drop("code").join(listed, ["area", "node", *flags])
    found = first(found, ["area", "ask", *flags], names)
    salts = F.when(F.col("area").isin(P.WIDE, EVERYWHERE), SALTS).otherwise(1)
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    own = asked.withColumn("salt", F.pmod(F.xxhash64("need_id", F.lit(0)), salts).cast("int"))
    best = own.join(found, ["area", "ask", *flags, "salt"]).groupBy("need_id").agg(F.collect_set(F.struct(*names, *carried)).alias("x"))  # ``limit`` of each ask and area
    return best.select("need_id", F.slice(F.array_sort("x"), 1, limit).alias("first"))


def _need_id(area: str) -> Column:
    """Name of what a profile asks for: 128 bits, so that no two needs of 10**9 share one."""
    parts = [area, F.col(area).isNull(), F.array_sort(F.array_distinct("ages")), *(F.coalesce(c, F.lit(False)) for c in ("is_pregnant", "is_single_parent", "has_disability"))]
    return F.md5(F.to_json(F.struct(*(F.col(x).alias("a0") if isinstance(x, str) else x.alias(f"a{k}") for k, x in enumerate(parts)))).cast("binary"))


def explained(rows: DataFrame) -> DataFrame:
    """Adds matched_ages, matched_attributes and match_reasons."""
    lo, hi = F.col(LO), F.col(HI)
    rows = rows.withColumn("matched_ages", F.filter("ages", lambda a: P.age_in_range(a, lo, hi)))
    sp = F.col("is_single_parent") & P.has_code(F.col("target_codes"), SINGLE_PARENT)
    dis = F.col("has_disability") & P.has_code(F.col("target_codes"), DISABILITY)
    pre = F.col("is_pregnant") & F.col("is_prenatal")
    span = F.concat(F.coalesce(lo.cast("string"), F.lit("-")), F.lit("〜"), F.coalesce(hi.cast("string"), F.lit("-")), F.lit("ヶ月"))
    who = F.array_join(F.transform("matched_ages", lambda a: F.concat(F.lit("月齢"), a.cast("string"))), "・")
    sure = F.when(F.col("age_source") == "inferred", F.lit("（対象年齢は本文からの推定）")).otherwise("")
    child = F.when((F.size("matched_ages") > 0) & (lo.isNotNull() | hi.isNotNull()), F.concat(F.lit("お子さん（"), who, F.lit("）が対象範囲"), span, F.lit("に該当"), sure))
    place = F.when(F.col("p_area").isNotNull(), F.when(F.col("area_code") == P.WIDE, F.lit("東京都全域の制度")).otherwise(F.concat(F.lit("お住まいの"), F.coalesce("area_name", F.lit("")), F.lit("が対象"))))
    attributes = F.array_compact(F.array(F.when(pre, F.lit("prenatal")), F.when(sp, F.lit("single_parent")), F.when(dis, F.lit("disability"))))
    reasons = F.array_compact(F.array(place, child, F.when(pre, F.lit("妊娠中の方が対象")), *(
        F.when(c, F.lit(f"{LABELS[k]}向けに分類されている制度")) for c, k in ((sp, "single_parent"), (dis, "disability")))))
    return rows.withColumns({"matched_attributes": attributes, "match_reasons": reasons})


def shown(matches: DataFrame) -> DataFrame:
    """Matches as they are shown: texts cut, and what has to be looked up or confirmed."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return matches.select(
        "profile_id", "rank", "benefit_id", "title", "category", cut("summary", 140).alias("summary"), "area_name", F.col(LO).alias("min_age_months"), F.col(HI).alias("max_age_months"), "age_source",
        F.col("matched_ages").alias("matched_child_age_months"), "is_free", (F.coalesce("monetary_support_text", F.lit("")) != "").alias("has_amount_info"), "electronic_submission",
        F.col("has_free_text_conditions").alias("needs_confirmation"), F.nullif(cut("conditions_text", 200), F.lit("")).alias("conditions_text"), "official_url", "match_reasons", "matched_attributes")


def search_results(rows: DataFrame) -> DataFrame:
    """Found benefits as they are shown in a list."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return rows.select(
        "benefit_id", "title", "category", F.substring(F.coalesce("summary", F.lit("")), 1, 120).alias("summary"), F.col(LO).alias("min_age_months"), F.col(HI).alias("max_age_months"), "age_source", "area_name",
        "has_free_text_conditions", "is_free", (some("monetary_support_text") | some("cost_text")).alias("has_amount_info"), "electronic_submission")


def group_by_attribute(matches: DataFrame) -> DataFrame:
    """(profile_id, group, n): each match in the group of its first attribute, single parents first."""
    has = lambda k: F.array_contains("matched_attributes", k)
    group = F.coalesce(*(F.when(has(k), F.lit(k)) for k in ("single_parent", "disability", "prenatal")), F.lit("other"))
    return matches.groupBy("profile_id", group.alias("group")).agg(F.count("*").alias("n"))


def match_groups(profiles: DataFrame, benefits: DataFrame, limit: int = 60) -> DataFrame:
    """:func:`group_by_attribute` of :func:`match`: a need's benefits bring the attributes that groups are made of and are counted before profiles meet them,
    eight rows for each at most; matches themselves are neither joined with benefits nor exchanged."""
    found = ["sp", "dis", "is_prenatal"]
    counts = ranked_needs(profiles, benefits, limit, tuple(found)).groupBy("need_id", *found).agg(F.count("*").alias("n"))
    asked = [("single_parent", "is_single_parent", "sp"), ("disability", "has_disability", "dis"), ("prenatal", "is_pregnant", "pre")]
    rows = profiles.select("profile_id", _need_id("area_code").alias("need_id"), *(c for _, c, _ in asked)).join(counts.withColumnRenamed("is_prenatal", "pre"), "need_id")
    group = F.coalesce(*(F.when(F.col(c) & F.col(has), F.lit(k)) for k, c, has in asked), F.lit("other"))
    return rows.groupBy("profile_id", group.alias("group")).agg(F.sum("n").alias("n"))


def next_steps(matches: DataFrame, edges: DataFrame, benefits: DataFrame, limit: int = STEPS) -> DataFrame:
    """Outgoing edges of each profile's first matches with both titles, by relation and titles.

    Only the first ``limit`` edges of a benefit can be among those of a profile. They are put together in runs of one relation and title, and profiles meet the
    sizes of runs: the runs that they need, by a running sum, are known before any edge is given to them.
    """
    names = benefits.select("benefit_id", "title")
    first = matches.where(F.col("rank") <= PREFIX).select("profile_id", F.col("benefit_id").alias("from_benefit_id"))
    rows = edges.join(first.select("from_benefit_id").distinct(), "from_benefit_id", "left_semi")  # edges of what was matched only
    rows = rows.join(names.select(F.col("benefit_id").alias("from_benefit_id"), F.col("title").alias("from_title")), "from_benefit_id")
    rows = rows.join(names.select(F.col("benefit_id").alias("to_benefit_id"), F.col("title").alias("to_title")), "to_benefit_id")
    rows = rows.withColumn("_rank", F.coalesce(*(F.when(F.col("relation") == r, k) for k, r in enumerate(RELATIONS)), F.lit(len(RELATIONS))))
    own = Window.partitionBy("from_benefit_id", "from_title").orderBy("_rank", "to_title", "relation", "to_benefit_id")
    rows = rows.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= limit).drop("_rn")
    run = ["from_benefit_id", "from_title", "_rank", "to_title", "relation"]
    edge = [c for c in rows.columns if c not in run and c != "to_benefit_id"]
    runs = stored(rows.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("to_benefit_id", *edge))).alias("_edges")), "runs")
    order = Window.partitionBy("profile_id").orderBy("_rank", "from_title", "to_title", "relation", "from_benefit_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = first.join(runs.select(*run, F.size("_edges").alias("_n")), "from_benefit_id").withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    needed = sized.where(F.col("_before") < limit).select("profile_id", "_before", *(F.col(c).alias(f"_need_{c}") for c in run))
    found = runs.join(needed, (F.col("from_benefit_id") == F.col("_need_from_benefit_id")) & F.expr(" and ".join(f"{c} <=> _need_{c}" for c in run[1:])))
    found = found.select("profile_id", *(c for c in run if c != "_rank"), "_before", F.posexplode("_edges").alias("_pos", "x"))
    return found.select("profile_id", *(c for c in run if c != "_rank"), "x.*", (F.col("_before") + F.col("_pos") + 1).cast("int").alias("step")).where(F.col("step") <= limit)


def next_steps_of_profiles(profiles: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], benefits: DataFrame, limit: int = STEPS) -> DataFrame:
    """:func:`next_steps` of the matches of profiles, worked out once for all needs that have the same matches and then given to all of their profiles (a row of profiles each; repeated rows give repeated steps).

    Edges may be a function that is given the (distinct) ``benefit_id`` of what is matched at all, and returns their edges, of each the first ``limit`` by relation, title and id at least.
    Of a need's benefits only the first ``PREFIX`` are ranked at all, so its lists are as long as steps need them. Steps don't depend on the order of matches.
    """
    lists = need_lists(profiles, benefits, PREFIX).select("need_id", F.array_sort(F.transform("first", lambda x: x["benefit_id"])).alias("ids"))
    lists = stored(lists.withColumn("set_id", F.md5(F.to_json("ids").cast("binary"))), "needs")
    sets = stored(lists.groupBy("set_id").agg(F.first("ids").alias("ids")), "matched")
    matches = sets.select(F.col("set_id").alias("profile_id"), F.explode("ids").alias("benefit_id"), F.lit(1).alias("rank"))
    steps = next_steps(matches, edges(matches.select("benefit_id").distinct()) if callable(edges) else edges, benefits, limit)
    steps = steps.groupBy(F.col("profile_id").alias("set_id")).agg(F.collect_list(F.struct(*(c for c in steps.columns if c != "profile_id"))).alias("steps"))
    # a set's steps are dealt over its profiles, some ``DEALT`` at once
    who = profiles.select("profile_id", _need_id("area_code").alias("need_id")).join(lists.select("need_id", "set_id"), "need_id").drop("need_id")
    sizes = who.groupBy("set_id").agg(F.ceil(F.count("*") / DEALT).alias("n"))
    who = who.join(sizes, "set_id").withColumn("block", F.pmod(F.xxhash64("profile_id"), F.col("n"))).drop("n")
    who = who.repartition(int(who.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_id", "block")
    dealt = steps.join(sizes, "set_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    return who.join(dealt, ["set_id", "block"]).select("profile_id", F.explode("steps").alias("x")).select("profile_id", "x.*")


def timeline(benefits: DataFrame, per_stage: int = 8, by_area: bool = False) -> DataFrame:
    """The first benefits of each life stage (and area); eight stages, so the other side of the join is broadcast."""
    stages = F.broadcast(benefits.sparkSession.createDataFrame(STAGES, "stage string, s_lo int, s_hi int"))
    fits = P.overlaps_stage(F.col(LO), F.col(HI), F.col("s_lo"), F.col("s_hi"), F.col("is_prenatal"), F.col("stage") == "prenatal")
    keys = ["area_code", "stage"] if by_area else ["stage"]
    order = [F.when(F.col("age_source") == "explicit", 0).otherwise(1), F.col(LO).asc_nulls_last(), "title", "benefit_id"]
    return benefits.join(stages, fits).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= per_stage)


def neighbourhood(benefits: DataFrame, requires_status: DataFrame, statuses: DataFrame, requires_doc: DataFrame, documents: DataFrame, ids: DataFrame | None = None):
    """(nodes, edges) one hop around benefits; statuses and documents are two branches, never multiplied."""
    if ids is not None:
        benefits = benefits.join(ids, "benefit_id", "left_semi")
    centre = benefits.select("benefit_id", F.col("benefit_id").alias("node_id"), F.lit("benefit").alias("kind"), F.col("title").alias("name"))
    here = benefits.select("benefit_id")
    # ids are made distinct before names join them: what a task keeps are ids
    s = requires_status.select("benefit_id", "status_id").distinct().join(here, "benefit_id", "left_semi").join(statuses.select("status_id", "name").distinct(), "status_id")
    probable = documents.where("is_probable_document").select("doc_id", F.col("doc_name").alias("name")).distinct()
    d = requires_doc.select("benefit_id", "doc_id").distinct().join(here, "benefit_id", "left_semi").join(probable, "doc_id")
    nodes = centre.union(s.select("benefit_id", "status_id", F.lit("status"), "name")).union(d.select("benefit_id", "doc_id", F.lit("document"), "name"))
    edges = s.select("benefit_id", F.col("status_id").alias("node_id"), F.lit("REQUIRES").alias("relation")).union(d.select("benefit_id", "doc_id", F.lit("REQUIRES_DOC")))
    return nodes, edges


def relation_rows(benefits, requires_status, statuses, requires_doc, documents) -> DataFrame:
    """Benefit, status and document of each benefit that has both; documents get their names before they meet statuses, which multiplies them."""
    named = requires_doc.join(documents.select("doc_id", "doc_name"), "doc_id")
    rows = benefits.select("benefit_id", "title").join(requires_status, "benefit_id").join(statuses.select("status_id", F.col("name").alias("status_name")), "status_id")
    return rows.join(named, "benefit_id")


def leads_to_resolved(edges: DataFrame, benefits: DataFrame, area: str | None = None) -> DataFrame:
    """Edges with both titles, of one source area if asked for."""
    a = benefits.select(F.col("benefit_id").alias("from_benefit_id"), F.col("title").alias("from_title"), "area_code")
    b = benefits.select(F.col("benefit_id").alias("to_benefit_id"), F.col("title").alias("to_title"))
    return edges.join(a.where(F.col("area_code") == area) if area else a, "from_benefit_id").join(b, "to_benefit_id")


def unknown_areas(profiles: DataFrame, benefits: DataFrame) -> DataFrame:
    return profiles.where("area_code is not null").join(benefits.select("area_code").distinct(), "area_code", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame, edge_col: str, node_col: str) -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col(node_col).alias(edge_col)), edge_col, "left_anti")


def category_counts(benefits: DataFrame, limit: int = 50) -> DataFrame:
    return benefits.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def area_counts(benefits: DataFrame) -> DataFrame:
    return benefits.where("area_code is not null").groupBy("area_code", "area_name").agg(F.count("*").alias("n"))


def freshness(benefits: DataFrame) -> DataFrame:
    return benefits.agg(F.count("*").alias("n_benefits"), F.countDistinct("area_code").alias("n_areas"), F.max("update_date").alias("latest"))


def rule_coverage(benefits: DataFrame, columns: tuple[str, ...] = ("age_source", "age_inference_rule", "income_rule", "income_basis")) -> DataFrame:
    """(column, value, n): rows by source and rule of the age, and by rule and basis of the income condition; those that the table has, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns if c in benefits.columns))
    return benefits.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def age_selectivity(benefits: DataFrame, ages: tuple[int, ...]) -> DataFrame:
    """(age, source, n): how many benefits an age lets through."""
    asked = F.broadcast(benefits.sparkSession.createDataFrame([(a,) for a in ages], "age int"))
    return benefits.join(asked, P.age_in_range(F.col("age"), F.col(LO), F.col(HI))).groupBy("age", "age_source").agg(F.count("*").alias("n"))


def latest_by_key(log: DataFrame, keys: list[str], at: Column, value: Column) -> DataFrame:
    """The value with the greatest ``at`` of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, at).alias("value"), F.max(at).alias("latest_at"))


def cache_misses(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")
