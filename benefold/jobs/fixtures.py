"""Registry tables derived from the driver's tables, in SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_TEXT = lambda x: f"CAST({x} AS STRING)"
_A, _B = "(o_custkey % 9 + 1)", "(o_custkey % 9 + 1 + o_orderkey % 4)"
#: A text for each rule of ages, in SQL, with the bounds that it says (a, b: numbers in it) and the rule's name.
AGE_KINDS = (
    (f"{_TEXT(_A)} || '歳から' || {_TEXT(_B + ' + 1')} || '歳未満'", "a * 12", "b * 12 + 11", "range_years_exclusive"), (f"{_TEXT(_A)} || '歳〜' || {_TEXT(_B)} || '歳'", "a * 12", "b * 12 + 11", "range_years"),
    (f"'生後' || {_TEXT(_A)} || 'か月から' || {_TEXT(_B)} || 'ヵ月'", "a", "b", "range_months"), (f"'生後' || {_TEXT(_A + ' * 30')} || '日から' || {_TEXT(_B + ' * 30')} || '日の赤ちゃん'", "a", "b", "range_days"),
    (f"'小学校' || {_TEXT(_A)} || '年生から中学3年生'", "60 + a * 12", "179", "range_grades"), (f"'小学校' || {_TEXT(_A)} || '年生'", "60 + a * 12", "71 + a * 12", "single_grade"),
    ("'義務教育就学期の児童'", "72", "191", "stage_compulsory_education"), ("'小学校入学前の幼児'", "0", "71", "stage_preschool"), ("'小・中学校'", "72", "179", "stage_elementary_juniorhigh"),
    ("'中・高校'", "144", "215", "stage_juniorhigh_highschool"), ("'18歳に達する日以後の最初の3月31日まで'", "0", "227", "stage_until18fy"), (f"{_TEXT(_A)} || '歳になった年度末まで'", "0", "a * 12 + 11", "stage_until_fiscal_year_end"),
    (f"'満' || {_TEXT(_A)} || '歳未満'", "0", "a * 12 - 1", "upper_years_exclusive"), (f"{_TEXT(_A)} || '歳まで'", "0", "a * 12 + 11", "upper_years"), (f"{_TEXT(_A)} || '歳以上の方'", "a * 12", "NULL", "lower_years"),
    (f"'生後' || {_TEXT(_A)} || 'か月未満'", "0", "a - 1", "upper_months"), (f"{_TEXT(_A)} || '～' || {_TEXT(_B)} || 'か月児健診'", "a", "b", "range_months_child"),
    (f"{_TEXT(_A)} || '～' || {_TEXT(_B)} || '歳児クラス'", "a * 12", "b * 12 + 11", "range_years_child"), (f"{_TEXT(_A)} || '歳6か月児健診'", "a * 12 + 6", "a * 12 + 11", "child_age_ym"),
    (f"'おおむね' || {_TEXT(_A)} || 'か月のお子さん'", "a", "a + 2", "child_age_months"), (f"{_TEXT(_A)} || '歳児健康診査'", "a * 12", "a * 12 + 11", "child_age_years"), ("'高校生等'", "180", "215", "stage_highschool"),
    ("'中学生'", "144", "179", "stage_juniorhigh"), ("'小学生'", "72", "143", "stage_elementary"), ("'新生児'", "0", "1", "stage_newborn"), ("'乳幼児'", "0", "71", "stage_infant_toddler"), ("'乳児'", "0", "11", "stage_infant"),
    ("'幼児'", "12", "71", "stage_toddler"), (f"'生後' || {_TEXT(_A + ' * 30 + 1')} || '日以内の方'", "0", "a", "upper_days"), ("'区民の方'", "NULL", "NULL", "NULL"),
)
_N = "(o_custkey % 800 + 100)"
#: A text for each rule of incomes, in SQL, with yen, whether inclusive, basis, rule and evidence (n: the number in it; t: the text), and the flag that it sets.
INCOME_KINDS = (
    (f"'世帯の所得が' || {_TEXT(_N)} || '万円未満の方'", "n * 10000", "false", "'income'", "threshold_upper", "t", ""), (f"'市民税所得割額' || {_TEXT(_N)} || '千円以下'", "n * 1000", "true", "'tax_levy'", "threshold_upper", "t", ""),
    (f"'所得税額が' || {_TEXT(_N)} || '円以内の世帯'", "n", "true", "'income_tax'", "threshold_upper", "t", ""), (f"'総収入' || {_TEXT(_N)} || '万円を超えない方'", "n * 10000", "true", "'salary'", "threshold_upper", "t", ""),
    (f"'年収' || {_TEXT(_N)} || '万円を超える方は対象外'", "n * 10000", "true", "'salary'", "threshold_lower_excluded", "t", ""), (f"'所得が' || {_TEXT(_N)} || '万円以上の方は除く'", "n * 10000", "false", "'income'", "threshold_lower_excluded", "t", ""),
    (f"'課税標準額が' || {_TEXT(_N)} || '万円以下'", "n * 10000", "true", "NULL", "threshold_upper", "t", ""), ("'住民税非課税世帯'", "NULL", "NULL", "NULL", "tax_non_taxable", "t", "requires_non_taxable"),
    ("'市民税が課税されている世帯'", "NULL", "NULL", "NULL", "tax_taxable", "t", "requires_taxable"), ("'区民。生活保護を受給している方'", "NULL", "NULL", "NULL", "welfare_required", "'生活保護を受給している方'", "requires_welfare"),
    ("'生活保護世帯は除く'", "NULL", "NULL", "NULL", "welfare_excluded", "t", "excludes_welfare"), ("'区民の方'", "NULL", "NULL", "NULL", "", "NULL", ""),
    (f"'区民の方。住民税非課税の世帯。所得が' || {_TEXT(_N)} || '万円以下'", "n * 10000", "true", "'income'", "threshold_upper", f"'所得が' || {_TEXT('n')} || '万円以下'", ""),
    (f"repeat('あ', 100) || '所得が' || {_TEXT(_N)} || '万円以下' || repeat('い', 100)", "n * 10000", "true", "'income'", "threshold_upper", f"'…' || repeat('あ', 57) || '所得が' || {_TEXT('n')} || '万円以下' || repeat('い', 58) || '…'", ""),
    ("'住民税課税世帯を除く。' || repeat('う', 70) || '住民税非課税' || repeat('え', 90)", "NULL", "NULL", "NULL", "tax_non_taxable", "repeat('う', 70) || '住民税非課税' || repeat('え', 44)", "requires_non_taxable"),
)
SQL = {
    "income_each": f"""
        SELECT o_orderkey AS id, CAST(o_orderkey % {len(INCOME_KINDS)} AS INT) AS kind, CAST({_N} AS BIGINT) AS n,
          CASE o_orderkey % {len(INCOME_KINDS)} {' '.join(f'WHEN {k} THEN {text}' for k, (text, *_) in enumerate(INCOME_KINDS))} END AS t
        FROM orders""",
    "age_texts": f"""
        SELECT o_orderkey AS id, CAST(o_orderkey % {len(AGE_KINDS)} AS INT) AS kind, CAST({_A} AS INT) AS a, CAST({_B} AS INT) AS b,
          CASE o_orderkey % {len(AGE_KINDS)} {' '.join(f'WHEN {k} THEN {text}' for k, (text, *_) in enumerate(AGE_KINDS))} END AS text
        FROM orders""",
    "benefits": """
        SELECT 'psid-' || CAST(o_orderkey AS STRING) AS benefit_id, o_orderkey AS record_seq, o_custkey AS custkey,
          '13' || lpad(CAST(o_custkey % 63 AS STRING), 4, '0') AS area_code, '区' || CAST(o_custkey % 63 AS STRING) AS area_name,
          CASE o_orderkey % 29 WHEN 0 THEN '児童扶養手当' WHEN 1 THEN '特別児童扶養手当' WHEN 2 THEN '医療費助成（一般）' WHEN 3 THEN '新・育成手当のご案内'
            ELSE '制度' || CAST(o_orderkey % 211 AS STRING) END AS title,
          CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'scheme' || CAST(o_custkey % 300 AS STRING) END AS canonical_name,
          o_orderpriority AS category, o_orderstatus AS status,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 37) * 6 END AS INT) AS effective_min_age_months,
          CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 37) * 6 + (o_custkey % 9) * 3 - 3 END AS INT) AS effective_max_age_months,
          CASE WHEN o_orderkey % 15 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'explicit' ELSE 'inferred' END AS age_source,
          o_orderkey % 17 = 0 AS is_prenatal,
          CASE o_orderkey % 6 WHEN 0 THEN '088' WHEN 1 THEN '090 ' WHEN 2 THEN '088，090' ELSE '000' END AS target_text,
          CASE o_orderkey % 11 WHEN 0 THEN '児童扶養手当の支給を受けている方' WHEN 1 THEN '区内の方。児童扶養手当および育成手当を受給している方'
            WHEN 2 THEN '過去に給付金を受けたことがない方' WHEN 3 THEN '所得' || CAST(o_orderkey % 90 + 10 AS STRING) || '万円未満の方' ELSE NULL END AS conditions_text,
          CAST(NULL AS STRING) AS target_persons_text,
          CAST(o_orderdate AS DATE) AS update_date
        FROM orders""",
    "requires_doc": """
        SELECT DISTINCT 'psid-' || CAST(l_orderkey AS STRING) AS benefit_id, 'DOC_' || CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_partkey END AS STRING) AS doc_id
        FROM lineitem""",
    "documents_": """
        SELECT 'DOC_' || CAST(p_partkey AS STRING) AS doc_id, p_name || ' ' || CAST(p_partkey AS STRING) AS doc_name, p_size % 3 > 0 AS is_probable_document
        FROM part WHERE p_partkey % 50 > 0""",
    "profiles": """
        SELECT c_custkey AS profile_id,
          CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE '13' || lpad(CAST(c_custkey % 64 AS STRING), 4, '0') END AS area_code,
          CAST(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey * 7) % 230 END AS INT) AS age1, CAST(CASE WHEN c_custkey % 3 > 1 THEN c_custkey % 190 END AS INT) AS age2,
          c_custkey % 5 = 0 AS is_pregnant, c_mktsegment = 'BUILDING' AS is_single_parent, c_custkey % 7 = 0 AS has_disability
        FROM customer""",
    "rule_texts": """
        SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INT) AS kind, CAST(o_custkey % 9 + 1 AS INT) AS a, CAST(o_custkey % 9 + 1 + o_orderkey % 4 AS INT) AS b,
          CASE o_orderkey % 10
            WHEN 0 THEN '対象は満' || CAST(o_custkey % 9 + 1 AS STRING) || '歳未満のお子さん'
            WHEN 1 THEN CAST(o_custkey % 9 + 1 AS STRING) || '歳から' || CAST(o_custkey % 9 + 1 + o_orderkey % 4 AS STRING) || '歳まで'
            WHEN 2 THEN '小学校入学前の幼児'
            WHEN 3 THEN '生後' || CAST(o_custkey % 9 + 1 AS STRING) || 'か月から' || CAST(o_custkey % 9 + 1 + o_orderkey % 4 AS STRING) || 'ヵ月'
            WHEN 4 THEN CAST(o_custkey % 9 + 1 AS STRING) || '歳以上の方'
            WHEN 5 THEN '中学生・高校生'
            WHEN 6 THEN CAST(o_custkey % 9 + 1 AS STRING) || '歳児健康診査'
            WHEN 7 THEN '（1）' || CAST(o_custkey % 9 + 1 AS STRING) || '歳以下（2）新生児'
            WHEN 8 THEN CAST(o_custkey % 9 + 1 AS STRING) || '～' || CAST(o_custkey % 9 + 1 + o_orderkey % 4 AS STRING) || 'か月児健診'
            ELSE '区民の方' END AS text
        FROM orders""",
    "work_texts": """
        SELECT o_orderkey AS id, CAST(o_orderkey % 8 AS INT) AS kind, CAST(o_custkey % 40 + 10 AS INT) AS hours, CASE WHEN o_custkey % 4 = 0 THEN '一時預かり' ELSE '助成' END AS title,
          CASE o_orderkey % 8
            WHEN 0 THEN '月' || CAST(o_custkey % 40 + 10 AS STRING) || '時間以上就労している保護者'
            WHEN 1 THEN '就労により保育を必要とする世帯。保護者の疾病でもよい'
            WHEN 2 THEN '求職活動中の方。障害のある児童'
            WHEN 3 THEN '週3日以上、1日4時間以上の勤務'
            WHEN 4 THEN '就労証明書。病気のとき'
            WHEN 5 THEN '育児休業中で仕事に戻る方'
            WHEN 6 THEN '区民の方'
            ELSE '仕事のある方' END AS text
        FROM orders""",
    "income_texts": """
        SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS INT) AS kind, CAST(o_custkey % 800 + 100 AS BIGINT) AS a,
          CASE o_orderkey % 7
            WHEN 0 THEN '世帯の所得が' || CAST(o_custkey % 800 + 100 AS STRING) || '万円未満の方'
            WHEN 1 THEN '市民税所得割額' || CAST(o_custkey % 800 + 100 AS STRING) || '千円以下の世帯'
            WHEN 2 THEN '年収' || CAST(o_custkey % 800 + 100 AS STRING) || '万円を超える方は対象外です'
            WHEN 3 THEN '住民税が非課税の世帯'
            WHEN 4 THEN '区民。生活保護を受給している方'
            WHEN 5 THEN '助成額は月額' || CAST(o_custkey % 800 + 100 AS STRING) || '円以下'
            ELSE '生活保護を受けている方は除く' END AS text
        FROM orders""",
}


def cte(*names: str) -> str:
    """``WITH`` and the fixtures, for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in ("orders", "lineitem", "part", "customer"):
        if f"FROM {table}" in SQL[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(SQL[name])


#: Columns of texts that the derived benefits have besides, in SQL.
TEXTS = """CASE record_seq % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE repeat(title, 40) END AS summary, CASE record_seq % 4 WHEN 0 THEN NULL ELSE repeat(title || status, 500) END AS description,
  CASE record_seq % 5 WHEN 0 THEN conditions_text WHEN 1 THEN '' ELSE '区民の方' END AS persons, CASE record_seq % 7 WHEN 0 THEN '月額1万円' WHEN 1 THEN '' END AS monetary_support_text,
  CASE record_seq % 6 WHEN 0 THEN repeat('窓口で申請', 250) END AS procedure_method, CASE record_seq % 11 WHEN 5 THEN '無料' WHEN 6 THEN '' END AS cost_text"""


def benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import clean_codes

    return fixture(spark, sf_dir, "benefits").withColumn("target_codes", clean_codes(F.array("target_text")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "profiles").withColumn("ages", F.array_compact(F.array("age1", "age2"))).drop("age1", "age2")


def benefits_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`benefits` with the columns of ``TEXTS`` and those that are made of them."""
    rows = benefits(spark, sf_dir)
    rows = rows.select("*", *(F.expr(x) for x in _split(TEXTS))).drop("target_persons_text").withColumnRenamed("persons", "target_persons_text")
    return rows.withColumns({"has_free_text_conditions": F.col("conditions_text").isNotNull(), "is_free": F.coalesce(F.col("cost_text") == "無料", F.lit(False)), "electronic_submission": F.col("is_prenatal"),
                             "official_url": F.concat(F.lit("https://a.example/"), "benefit_id")})


def _split(columns: str) -> list[str]:
    """The columns of a list in SQL, each up to its name."""
    out, rest = [], columns
    while rest.strip(", \n"):
        head, _, tail = rest.partition(" AS ")
        name, _, rest = tail.partition(",")
        out.append(f"{head.strip(', \n')} AS {name.strip()}")
    return out
