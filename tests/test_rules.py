"""Case tables for the rules on text, each evaluated by one Spark job; values as the rules' order demands."""

from pyspark.sql import functions as F

from benefold.functions import age, documents as D, income, refs, text as T

AGE = [
    ("満3歳から6歳未満", 36, 71, "range_years_exclusive"), ("0歳～2歳", 0, 35, "range_years"), ("５歳から３歳", None, None, None), ("生後2か月から18ヵ月", 2, 18, "range_months"),
    ("生後5日から7日の赤ちゃん", 0, 0, "range_days"), ("小学校6年生から高校1年生", 132, 191, "range_grades"), ("小学校4年生", 108, 119, "single_grade"), ("義務教育就学期の児童", 72, 191, "stage_compulsory_education"),
    ("満3歳になった後の4月1日から小学校入学前まで", 36, 71, "stage_preschool"), ("小学校に入学するまで", 0, 71, "stage_preschool"), ("未就学児", 0, 71, "stage_preschool"), ("義務教育就学前", 0, 71, "stage_preschool"),
    ("小・中学校", 72, 179, "stage_elementary_juniorhigh"), ("18歳に達する日以後の最初の3月31日まで", 0, 227, "stage_until18fy"), ("15歳になった年度末まで", 0, 191, "stage_until_fiscal_year_end"),
    ("18歳未満", 0, 215, "upper_years_exclusive"), ("3歳以下", 0, 47, "upper_years"), ("20歳以上", 240, None, "lower_years"), ("生後4か月未満", 0, 3, "upper_months"), ("3～4か月児健康診査", 3, 4, "range_months_child"),
    ("3～5歳児クラス及び0～2歳児クラス", 0, 71, "range_years_child"), ("1歳6か月児健診", 18, 23, "child_age_ym"), ("おおむね5か月のお子さん", 5, 7, "child_age_months"), ("三歳児", 36, 47, "child_age_years"),
    ("高校生等", 180, 215, "stage_highschool"), ("小学生", 72, 143, "stage_elementary"), ("新生児", 0, 1, "stage_newborn"), ("乳幼児", 0, 71, "stage_infant_toddler"), ("生後28日以内の方", 0, 0, "upper_days"),
    ("生後28日以内の新生児", 0, 1, "stage_newborn"), ("妊娠8か月", None, None, None), ("区民の方", None, None, None), ("（1）1歳未満（2）12歳以下", 0, 155, "union_of_clauses"), ("（1）20歳以上（2）3歳児", 36, None, "union_of_clauses"),
    ("11か月～1歳4か月頃のお子さん", None, None, None),
]
INCOME = [
    ("世帯の所得が46万円未満の方", 460_000, False, "income", "threshold_upper"), ("市民税所得割額が７７，１００円以下", 77_100, True, "tax_levy", "threshold_upper"), ("総収入600万円以内", 6_000_000, True, "salary", "threshold_upper"),
    ("所得税額が8,400円以下の世帯", 8_400, True, "income_tax", "threshold_upper"), ("年収が1億2千円を超える方は対象外", 100_002_000, True, "salary", "threshold_lower_excluded"), ("所得が46万円以上の方は対象外", 460_000, False, "income", "threshold_lower_excluded"),
    ("所得が46万円以上の方", None, None, None, None), ("助成額は月額5,000円以下", None, None, None, None), ("住民税非課税世帯", None, None, None, "tax_non_taxable"), ("住民税課税世帯を除く", None, None, None, None),
    ("生活保護を受給している方", None, None, None, "welfare_required"), ("生活保護世帯は除く", None, None, None, "welfare_excluded"), ("生活保護を受けていない方", None, None, None, "welfare_excluded"), (None, None, None, None, None),
]


def test_age_rules(spark):
    rows = spark.createDataFrame(AGE, "text string, lo int, hi int, rule string")
    got = rows.select("*", age.infer_age_clauses(F.col("text")).alias("x")).collect()
    wrong = [(r["text"], r["x"]) for r in got if (tuple(r["x"]) if r["x"] else (None, None, None)) != (r["lo"], r["hi"], r["rule"])]
    assert not wrong, wrong


def test_income_rules(spark):
    rows = spark.createDataFrame(INCOME, "text string, yen long, inclusive boolean, basis string, rule string")
    for r in rows.select("*", income.extract_income(F.col("text")).alias("x")).collect():
        assert (r["x"]["max_yen"], r["x"]["max_inclusive"], r["x"]["basis"], r["x"]["rule"]) == (r["yen"], r["inclusive"], r["basis"], r["rule"]), r


def test_yen(spark):
    cases = [("23万5千円", 235_000), ("46万円", 460_000), ("1,000円", 1_000), ("1億2千万円", None), ("円", None), ("0円", None), ("７７，１００円", 77_100), ("1億2千円", 100_002_000), ("9" * 30 + "円", None), (None, None), ("約5円", None)]
    for r in spark.createDataFrame(cases, "text string, want long").select("*", income.yen(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_income_amounts_and_their_words(spark):
    """Of several amounts and words those that belong together; other sentences and readers come later."""
    cases = [
        ("所得が46万円、扶養1人につき38万円以下", 380_000, "income"), ("所得は問わない。助成額は5万円以下。年収は300万円以下", 3_000_000, "salary"), ("所得" + "あ" * 21 + "5万円以下", None, None), ("所得が0円以下または収入が7万円以下", 70_000, "salary"),
        ("・区民・総収入が9万円を超えない方", 90_000, "salary"), ("住民税非課税で、所得が5万円以下", 50_000, "income"),
    ]
    rows = spark.createDataFrame(cases, "text string, yen long, basis string").select("*", income.extract_income(F.col("text")).alias("x")).collect()
    assert [(r["x"]["max_yen"], r["x"]["basis"]) for r in rows] == [c[1:] for c in cases]


def test_evidence_is_cut_around_the_amount(spark):
    rows = spark.createDataFrame([("あ" * 200 + "所得が46万円以下" + "い" * 200,), ("　所得が46万円以下 ",)], "t string")
    long, short = (r["x"]["evidence"] for r in rows.select(income.extract_income(F.col("t")).alias("x")).collect())
    assert long == "…" + "あ" * 57 + "所得が46万円以下" + "い" * 58 + "…" and short == "所得が46万円以下"


def test_cleaning(spark):
    rows = spark.createDataFrame([("　a ", "2024-4-1", "9:05", "１３１００１６", "131016;千代田区"), ("", "2024/02/31", "25:00", "03-1234", "131016"), (None, "随時", "9時", None, None), (" ", "2024/12/05", "12:30 ", "131-0016", ";x")],
                                 "a string, d string, t string, z string, area string")
    code, name = T.split_area(F.col("area"))
    got = rows.select(T.clean_text(F.col("a")), T.normalize_date(F.col("d")).cast("string"), T.normalize_time(F.col("t")), T.normalize_zip(F.col("z")), code, name).collect()
    assert [tuple(r) for r in got] == [("a", "2024-04-01", "09:05", "131-0016", "131016", "千代田区"), (None, None, "25:00", "03-1234", "131016", None), (None, None, None, None, None, None), (None, "2024-12-05", "12:30", "131-0016", None, "x")]


def test_full_months(spark):
    rows = spark.createDataFrame([("2024-02-29", "2025-02-28", 11), ("2024-01-31", "2024-02-29", 0), ("2024-01-15", "2024-02-15", 1), ("2025-01-01", "2024-01-01", 0), ("2020-05-10", "2024-05-09", 47)], "b string, t string, m int")
    assert all(r["x"] == r["m"] for r in rows.select("m", T.full_months(F.to_date("b"), F.to_date("t")).alias("x")).collect())


def test_links(spark):
    cases = [
        ("傷病届 (PDF: 30KB);https://a.jp/x.pdf。続き", [("傷病届 (PDF: 30KB)", "https://a.jp/x.pdf")], "傷病届 (PDF: 30KB)。続き"),
        ("A;https://a.jp/1;B;https://a.jp/2", [("A", "https://a.jp/1"), ("B", "https://a.jp/2")], "A;B"), ("案内;https://a.jp/jikan.html等", [("案内", "https://a.jp/jikan.html")], "案内等"),
        ("詳細;https://a.jp/診療科-部門紹介/より", [("詳細", "https://a.jp/診療科-部門紹介/")], "詳細より"), ("ただの文", [], "ただの文"), (None, [], None), ("A;https://a.jp/x「注」", [("A", "https://a.jp/x")], "A「注」"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    for r in rows.select("i", T.split_links(F.col("t")).alias("x")).collect():
        _, links, plain = cases[r["i"]]
        assert [tuple(x) for x in r["x"]["links"]] == links, r
        assert plain is None or r["x"]["plain"] == plain, r


def test_documents(spark):
    rows = spark.createDataFrame([
        ("親子手帳（写し）", "母子健康手帳", True), ("医療証交付申請書 （PDF 117.1KB）新しいウィンドウで開きます", "医療証交付申請書", True), ("詳しくはこちら", "詳しくはこちら", False), ("委任状をご提出ください", "委任状をご提出ください", False),
        ("確認しますので、", "確認しますので", False), ("ただし、印鑑", "ただし、印鑑", False), ("あ" * 41, "あ" * 41, False), ("あ" * 40 + "（PDF：98KB）", "あ" * 40, True), ("印鑑", "印鑑", True)], "t string, name string, ok boolean")
    for r in rows.select("*", D.canonical_name(F.col("t")).alias("n"), D.looks_like_document(F.col("t")).alias("x")).collect():
        assert (r["n"], r["x"]) == (r["name"], r["ok"]), r


def test_items(spark):
    r = spark.createDataFrame([("・印鑑\n（1） 申請書、写し\n\n　 \n２．住民票",)], "t string").select(D.split_items(F.col("t")).alias("x")).first()
    assert r["x"][:2] == ["印鑑", "申請書、写し"] and len(r["x"]) == 3


def test_required_names(spark):
    cases = [("児童扶養手当の支給を受けている方", ["児童扶養手当"]), ("特別児童扶養手当を受給している方", ["特別児童扶養手当"]), ("過去にこの給付金を受けたことがない方", []), ("児童扶養手当を受けている方\\給付を受給していない方", ["児童扶養手当"]),
             ("児童扶養手当および医療費助成を受けている方", ["児童扶養手当", "医療費助成"]), ("父または母が児童扶養手当の支給を受けているか", ["児童扶養手当"]), (None, [])]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    assert all(r["x"] == cases[r["i"]][1] for r in rows.select("i", refs.required_names(F.col("t")).alias("x")).collect())
    pairs = spark.createDataFrame([("特別児童扶養手当", "児童扶養手当", False), ("児童扶養手当", "児童扶養手当", True), ("新・児童扶養手当", "児童扶養手当", True), (None, "x", False), ("a.b", "b", True)], "t string, n string, ok boolean")
    assert all(r["ok"] == r["x"] for r in pairs.select("ok", refs.title_refers_to(F.col("t"), F.col("n")).alias("x")).collect())


def test_trimming_takes_all_white_space_and_tries_no_pattern(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"{c}{c}a {c}b{c}") for c in chars], "c string, t string")
    assert rows.where(~F.col("t").eqNullSafe(F.concat("c", "c", F.lit("a "), "c", F.lit("b"), "c"))).count() == 0
    want = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.where(T.trimmed(F.col("t")) != want).count() == 0 and rows.where(T.trimmed(F.col("t")) != F.col("t")).count() == 25
    assert "regexp" not in str(T.clean_text(F.col("t")))


def test_links_are_marked_by_one_pass_also_in_texts_with_marks(spark):
    cases = ["費用 案内;https://a.example/1.html等の 表;https://a.example/2", "a\u0001b 案内;https://a.example/1\u0002x", "\u0002;https://a.example/\u0001", "https://b.example/;https://a.example/", ";http", "x;https://", "", None, "a\n表;https://a.example/あ 次"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    x = T.split_links(F.col("t"))
    plain = F.when(F.col("t").contains(";http"), T.clean_text(F.regexp_replace("t", T.LINK, "$1$3"))).otherwise(T.clean_text(F.col("t")))
    got = rows.select("i", x["links"]["uri"].alias("uris"), F.regexp_extract_all("t", F.lit(T.LINK), 2).alias("want"), x["plain"].alias("plain"), plain.alias("want_plain")).collect()
    assert all((r["uris"] or []) == (r["want"] or []) and r["plain"] == r["want_plain"] for r in got), got


def test_income_of_a_text_with_a_control_character_in_its_cue(spark):
    rows = spark.createDataFrame([("住民税非課\u0001税世帯",), ("区民の方",), (None,)], "t string").select(income.extract_income(F.col("t"))["rule"].alias("rule")).collect()
    assert [r["rule"] for r in rows] == ["tax_non_taxable", None, None]
