"""Surveys of how conditions are worded: tallies of labelled patterns in one pass, masks, text reuse, thresholds, references."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import names_within


def pattern_survey(df: DataFrame, text: Column, mention: str, patterns: dict[str, str]) -> DataFrame:
    """(label, n): rows that mention, rows of each labelled pattern among them (several may hold), and of none."""
    rows = df.where(text.rlike(mention)).select(*(text.rlike(p).alias(f"p{k}") for k, p in enumerate(patterns.values())))
    some = F.greatest(*(F.col(f"p{k}") for k in range(len(patterns))), F.lit(False))
    cells = [("mention", F.count("*"))] + [(label, F.count_if(f"p{k}")) for k, label in enumerate(patterns)] + [("none", F.count_if(~some))]
    row = rows.agg(*(c.alias(f"c{k}") for k, (_, c) in enumerate(cells)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"c{k}").alias("n")) for k, (label, _) in enumerate(cells)))).alias("x")).select("x.*")


def masked_survey(df: DataFrame, text: Column, mask: str, keyword: str, known: str) -> DataFrame:
    """One row: mentions; those that stay after phrases are masked; noise; known attribute and others, others only."""
    rows = df.where(text.rlike(keyword)).select(text.alias("t"), F.regexp_replace(text, mask, "#").alias("m"))
    left, is_known = F.col("m").rlike(keyword), F.col("m").rlike(known)
    return rows.agg(F.count("*").alias("mentions"), F.count_if(left).alias("after_mask"), F.count_if(~left).alias("noise"), F.count_if(left & is_known).alias("known"), F.count_if(left & ~is_known).alias("other_only"))


def text_reuse(df: DataFrame, scheme: str, text: str) -> DataFrame:
    """One row: rows, distinct schemes, distinct texts whatever their white space."""
    bare = F.md5(F.regexp_replace(text, r"(?U)\s+", "").cast("binary"))
    return df.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_rows"), F.countDistinct(scheme).alias("n_schemes"), F.countDistinct(bare).alias("n_texts"))


def threshold_labels(df: DataFrame, text: Column, pattern: str) -> DataFrame:
    """(label, n): all matches of a threshold pattern, digits of either width alike."""
    found = df.select(F.explode(F.regexp_extract_all(F.translate(text, "０１２３４５６７８９", "0123456789"), F.lit(pattern), 0)).alias("label"))
    return found.groupBy("label").agg(F.count("*").alias("n"))


def top_titles(df: DataFrame, title: str, n: int = 5, length: int = 40) -> DataFrame:
    """(title, n): the most frequent titles, cut for the report; counted whole."""
    return df.groupBy(F.col(title).alias("_t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_t").limit(n).select(F.substring("_t", 1, length).alias("title"), "n")


# What is surveyed of conditions on employment.
WORK = "就労|勤務|就職|求職|仕事"
WORK_THRESHOLD = r"(?:月|週|1日|一日)\s*[0-9０-９]{1,3}\s*(?:時間|日)\s*以上"
CHILD_CARE = "保育|学童|預かり|クラブ|こども園|幼稚園"
WORDINGS = {
    "① 就労時間のしきい値": WORK_THRESHOLD,
    "② 保育の必要性（就労等の事由）": "就労(?:等|など)?(?:により|によって|のため|の理由)|保育を必要と|保育が困難|家庭(?:で|において)保育",
    "③ 求職活動中": "求職",
    "④ 就学・技能習得": "就学|技能を?習得|職業訓練|養成機関",
    "⑤ 就労証明書（書類であって条件ではない）": "就労証明書?|勤務証明書?|就労状況(?:届|申告)",
    "⑥ 育児休業": "育児休業|育休",
    "⑦ ひとり親の就業支援": "高等職業訓練|自立支援教育訓練|就業支援|母子家庭等就業",
}
CARE_REASONS = {
    "就労": "就労", "疾病・障害": "疾病|病気|障害", "就学": "就学|技能", "介護・看護": "介護|看護", "妊娠・出産": "妊娠|出産", "求職活動": "求職", "災害復旧": "災害", "育児休業": "育児休業|育休", "虐待・DV": "虐待|DV",
}
SICKNESS = "疾病|病気|障害"
GUARDIAN_SICK = "(?:保護者|父母|父|母|申請者|養育者)[^。]{0,20}?(?:疾病|病気|障害)"
CHILD_SICK = "(?:児童|子ども|お子|乳幼児)[^。]{0,15}?(?:疾病|病気|障害)|(?:疾病|病気|障害)[^。]{0,10}?(?:のある|の)?(?:児童|子ども|お子)"


def employment_survey(df: DataFrame, text: Column, title: Column) -> DataFrame:
    """(section, label, n) over the rows that mention work, in one pass: all, those of child care, those with a threshold; wordings and reasons (several
    may hold); and whose sickness is meant, the guardian's before the child's before nobody's in particular."""
    is_sick, guardian, child = (text.rlike(p) for p in (SICKNESS, GUARDIAN_SICK, CHILD_SICK))
    some = functools.reduce(lambda a, b: a | b, (text.rlike(p) for p in WORDINGS.values()))
    tests = {("rows", "mention"): F.lit(True), ("rows", "child care"): F.concat(title, text).rlike(CHILD_CARE), ("rows", "threshold"): text.rlike(WORK_THRESHOLD), ("wording", "none"): ~some}
    tests |= {("wording", k): text.rlike(p) for k, p in WORDINGS.items()} | {("reason", k): text.rlike(p) for k, p in CARE_REASONS.items()}
    tests |= {("subject", "guardian"): is_sick & guardian, ("subject", "child"): is_sick & ~guardian & child, ("subject", "ambiguous"): is_sick & ~guardian & ~child}
    row = df.where(text.rlike(WORK)).agg(*(F.count_if(c).alias(f"c{k}") for k, c in enumerate(tests.values())))
    cells = (F.struct(F.lit(section).alias("section"), F.lit(label).alias("label"), F.col(f"c{k}").alias("n")) for k, (section, label) in enumerate(tests))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def work_thresholds(df: DataFrame, text: Column) -> DataFrame:
    """(label, n): all thresholds of hours or days, without white space, digits of either width alike."""
    found = threshold_labels(df.where(text.rlike(WORK)), text, WORK_THRESHOLD)
    return found.groupBy(F.regexp_replace("label", r"(?U)\s+", "").alias("label")).agg(F.sum("n").alias("n"))


# What is surveyed of references to other benefits; a name here may hold kana, unlike in the edges.
SURVEY_NAME = "[一-龥ぁ-んァ-ヶ]{2,18}?(?:手当|給付金|助成|医療証|受給者証)"
SURVEY_REQUIRES = f"({SURVEY_NAME})(?:の支給)?を?(?:受けている|受給している|受給し[てい]|支給を受けて|認定を受けて)"
SURVEY_EXCLUDES = (
    "(?:過去に|既に|すでに)[^。]{0,30}?(?:給付金|手当|訓練給付金)[^。]{0,20}?(?:受けたことがない|受給していない|受けていない)"
    f"|{SURVEY_NAME}[^。]{{0,12}}?(?:受給していない|受けていない|受けることができません|対象となりません)"
)
NO_NAME = "^(?:過去に|既に|すでに|同じ|本事業|この|当該)|過去"
HUB = "児童扶養手当"


def references(benefits: DataFrame) -> DataFrame:
    """(benefit_id, area_code, area_name, title, name, resolved) for every reference: whether a title of the area contains the name, plainly.

    The area's distinct titles give the names they contain, and these meet the references on (area, name).
    """
    refs = benefits.select("benefit_id", "area_code", "area_name", "title", F.explode(F.regexp_extract_all(_conditions(), F.lit(SURVEY_REQUIRES), 1)).alias("name")).where(~F.col("name").rlike(NO_NAME))
    titles = benefits.select("area_code", "title").distinct()
    known = titles.select("area_code", F.explode(names_within(F.col("title"))).alias("name")).distinct().withColumn("resolved", F.lit(True))
    return refs.join(known, ["area_code", "name"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def _conditions() -> Column:
    return F.concat(F.coalesce("conditions_text", F.lit("")), F.lit(" "), F.coalesce("target_persons_text", F.lit("")))


def reference_counts(benefits: DataFrame) -> DataFrame:
    """One row: benefits that demand another one, benefits that demand its absence, references, and those resolved in the area and not."""
    refs = references(benefits).agg(F.countDistinct("benefit_id").alias("n_positive"), F.count("*").alias("n_refs"), F.count_if("resolved").alias("n_resolved"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
    return refs.join(benefits.agg(F.count_if(_conditions().rlike(SURVEY_EXCLUDES)).alias("n_negative")))  # a row each


def reference_survey(benefits: DataFrame) -> DataFrame:
    """(name, n_refs, n_resolved): names demanded, and how many of the references are resolved."""
    return references(benefits).groupBy("name").agg(F.count("*").alias("n_refs"), F.count_if("resolved").alias("n_resolved"))


def unresolved_names(benefits: DataFrame, n: int = 5) -> DataFrame:
    """(name, n): the names most often left unresolved."""
    return references(benefits).where(~F.col("resolved")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def hub_references(benefits: DataFrame, hub: str = HUB) -> DataFrame:
    """The resolved references whose name contains the hub."""
    return references(benefits).where(F.col("resolved") & F.col("name").contains(hub))


def hub_titles(benefits: DataFrame, hub: str = HUB, n: int = 10, length: int = 40) -> DataFrame:
    """(title, n): the titles, cut, that refer to the hub most often."""
    return hub_references(benefits, hub).groupBy(F.substring("title", 1, length).alias("title")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(n)


def downstream(benefits: DataFrame, hub: str = HUB) -> DataFrame:
    """One row over areas: how many refer to the hub, and the upper median, mean and maximum of their numbers of references."""
    per = hub_references(benefits, hub).groupBy("area_name").agg(F.count("*").alias("n"))
    upper = F.sort_array(F.collect_list("n"))  # one number per area
    return per.agg(F.count("*").alias("n_areas"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.element_at(upper, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("upper_median"))
