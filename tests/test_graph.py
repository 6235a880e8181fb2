"""Edges against brute force, matching, timeline, quality gate, publishing; each counter-test breaks a plausible mistake."""

import hashlib
import json
import random
import re
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from benefold.jobs import publish_registry as J
from benefold.jobs.rows import build_benefits, build_tables
from benefold.functions import refs
from benefold.operators import edges, filters, nodes, quality, serve, survey
from benefold.sources import cache_log as L, publish as P, registry as R
from benefold.sources.schema import EDGES, KEYS, typed


def benefits_of(spark, rows):
    return spark.createDataFrame(rows, "benefit_id string, record_seq long, area_code string, area_name string, title string, effective_min_age_months int, effective_max_age_months int, conditions_text string, target_persons_text string")


def test_next_steps_against_brute_force(spark):
    r = random.Random(3)
    rows = [(f"b{i}", i, r.choice(["1", "2", None, ""]), "区", "t", r.choice([None, *range(0, 40, 3)]), r.choice([None, *range(0, 40, 3)]), None, None) for i in range(400)]
    want = set()
    for area in ("1", "2"):
        aged = sorted((x for x in rows if x[2] == area and x[5] is not None and x[6] is not None), key=lambda x: (x[5], x[6], x[1]))
        for i, x in enumerate(aged):
            later = [y for y in aged[i + 1:] if 0 <= y[5] - x[6] <= 12]
            want |= {(x[0], y[0]) for y in later[:2]}
    got = {(e["from_benefit_id"], e["to_benefit_id"]) for e in edges.next_step_edges(benefits_of(spark, rows)).collect()}
    assert got == want and want


def test_next_steps_once_for_each_need(spark):
    from benefold.jobs import fixtures

    data = "/root/testdata/sf0.001"
    profiles, benefits = fixtures.profiles(spark, data), fixtures.benefits(spark, data)
    profiles = profiles.union(profiles.withColumn("profile_id", F.col("profile_id") + 1_000_000)).withColumn("label", F.lit("x"))  # needs of two profiles each
    leads = edges.leads_to(benefits, fixtures.fixture(spark, data, "requires_doc"))
    columns = ["profile_id", "step", "from_benefit_id", "to_benefit_id", "relation", "reason"]
    got, want = (sorted(map(tuple, df.select(columns).collect())) for df in (serve.next_steps_of_profiles(profiles, leads, benefits, 20), serve.next_steps(serve.match(profiles, benefits), leads, benefits, 20)))
    assert got == want and len({x[0] for x in got}) > 200 and {x[1] for x in got} == set(range(1, 21))
    assert serve.next_steps_of_profiles(profiles.limit(0), leads, benefits).count() == 0


def test_shared_documents_against_brute_force(spark):
    r = random.Random(4)
    rows = [(f"b{i}", i, r.choice(["1", "2"]), "区", "t", None, None, None, None) for i in range(120)]
    need = {(f"b{r.randrange(120)}", f"d{int(r.triangular(0, 30, 0))}") for _ in range(260)}
    usage = {d: sum(x[1] == d for x in need) for _, d in need}
    want = {}
    for area in "12":
        for d in usage:
            ids = sorted((int(b[1:]) for b, x in need if x == d and rows[int(b[1:])][2] == area))
            if usage[d] <= max(120 * 0.05, 2) and 2 <= len(ids) <= 6:
                for i, a in enumerate(ids):
                    for b in ids[i + 1:]:
                        want[f"b{a}", f"b{b}"] = min(d, want.get((f"b{a}", f"b{b}"), "z"))
    got = edges.shared_doc_edges(benefits_of(spark, rows), spark.createDataFrame(sorted(need), "benefit_id string, doc_id string")).collect()
    assert {(e[0], e[1]): e["reason"] for e in got} == {k: f"同じ書類（{d}）が必要" for k, d in want.items()}


def test_requires_edges_against_brute_force(spark):
    """Names at places of a title, of any length, with the area's name before them or not."""
    r = random.Random(12)
    parts, ends = ["児童", "育成", "特別", "新", "中央区", "ひとり親", "A", "・", "（", " ", "の", "医療", "ァ", "受給"], ["手当", "給付金", "助成", "医療証", "受給者証"]
    title = lambda: "".join(r.choice(parts + ends) for _ in range(r.randrange(1, 7)))
    name = lambda: "".join(r.choice(["児童", "育成", "特別", "中央区", "医療", "ァ"]) for _ in range(r.randrange(1, 10)))[:18] + r.choice(ends)
    rows, pool = [], [name() for _ in range(14)]
    for i in range(300):
        asked = r.choice(pool)
        said = r.choice([f"{asked}を受けている方", f"{asked}または{r.choice(pool)}を受給している方", None, "区民の方"])
        rows.append((f"b{i}", i, r.choice(["1", "2", None]), r.choice(["中央区", "港区", "", None]), r.choice([title(), asked, f"{asked}のご案内", f"新・{asked}", asked[2:], f"x{asked}"]), None, None, said, None))
    df = benefits_of(spark, rows)
    titles = df.select("area_code", F.col("benefit_id").alias("src"), "title")
    asked = df.select(F.col("benefit_id").alias("dst"), "area_code", "area_name", F.explode(refs.required_names(F.col("conditions_text"))).alias("name"))
    pairs = {(x["src"], x["dst"]) for x in asked.join(titles, "area_code").where("src <> dst").collect() for n in {x["name"], x["name"][len(x["area_name"]):] if x["area_name"] and x["name"].startswith(x["area_name"]) else x["name"]}
             if len(n) >= 3 and re.search(rf"(?<![{refs.NAME_CHAR}]){re.escape(n)}", x["title"])}
    assert {(x[0], x[1]) for x in edges.requires_edges(df).collect()} == pairs and len(pairs) > 30
    found = {(x["benefit_id"], x["name"]): x["resolved"] for x in survey.references(df).collect()}
    area = {x[0]: x[2] for x in rows}
    assert found == {(b, n): area[b] is not None and any(x[2] == area[b] and n in x[4] for x in rows) for b, n in found} and True in found.values() and False in found.values()


def test_requires_edges(spark):
    rows = [("a", 0, "1", "中央区", "児童扶養手当", None, None, None, None), ("b", 1, "1", "中央区", "訓練給付金", None, None, "児童扶養手当の支給を受けている方", None), ("c", 2, "1", "中央区", "特別児童扶養手当", None, None, "中央区児童育成手当を受給している方", None),
            ("d", 3, "2", "港区", "児童扶養手当", None, None, None, None), ("e", 4, "1", "中央区", "児童育成手当", None, None, "児童育成手当を受給していない方", None)]
    got = {(x[0], x[1]) for x in edges.requires_edges(benefits_of(spark, rows)).collect()}
    assert got == {("a", "b"), ("e", "c")}


def test_requires_edges_of_large_kinds(spark, monkeypatch):
    """Kinds of many blocks, with both titles; nothing above the last explode groups or exchanges the pairs."""
    monkeypatch.setattr(edges, "BLOCK", 7)
    rows = [(f"b{i}", i, "1", "中央区", ["児童扶養手当", "新・育成手当", "x"][i % 3], None, None, ["児童扶養手当を受けている方", "中央区児童扶養手当または育成手当を受給している方", None][i // 3 % 3], None) for i in range(180)]
    df = edges.requires_edges(benefits_of(spark, rows), titles=True)
    want = [(a[0], b[0], "条件に「" + ("中央区" if b[1] // 3 % 3 and a[1] % 3 == 0 else "") + ("育成手当" if a[1] % 3 else "児童扶養手当") + "を受けている」とある", a[4], b[4])
            for a in rows for b in rows if a != b and (a[1] % 3, b[1] // 3 % 3) in {(0, 0), (0, 1), (1, 1)}]
    assert sorted(map(tuple, df.select("from_benefit_id", "to_benefit_id", "reason", "from_title", "to_title").collect())) == sorted(want)
    assert not re.search("Exchange|Aggregate|Sort|Window", df._jdf.queryExecution().sparkPlan().toString().partition("Generate explode(targets")[0])
    assert df.columns[:4] == edges.requires_edges(benefits_of(spark, rows)).columns


def test_requires_edges_keep_no_tile(spark):
    """Sources are unfolded one by one, not fused with what unfolds their edges (which would keep all edges of a tile); demands are read twice, for kinds and for members, whatever reads links."""
    rows = [(f"b{i}", i, "12"[i % 2], "区", ["児童扶養手当", "x"][i // 2 % 2], None, None, ["児童扶養手当を受けている方", None][i // 4 % 2], None) for i in range(80)]
    df = edges.requires_edges(benefits_of(spark, rows))
    assert len(df.collect()) == sum(a[2] == b[2] and a[4] != "x" and b[7] is not None and a != b for a in rows for b in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    fused = [bool(x) for x in re.findall(r"(\*\(\d+\) )?Generate explode\([^\n]*sources#\d+", plan)]
    assert fused == [False] and len(re.findall("ReusedExchange|ReusedQueryStage", plan)) >= 2


def test_first_edges_of_what_is_matched(spark):
    """Every title links with every demand, but steps are made from the first few edges of matched benefits only; equal needs and equal matches are worked out once."""
    demand = ["児童扶養手当を受けている方", "児童扶養手当または育成手当を受給している方", None]
    rows = [(f"b{i:03d}", i, "12"[i % 2], "区", ["児童扶養手当", "新・育成手当", "c", "a"][i // 2 % 4], [None, 0, 6, 14][i % 7 % 4], [None, 11][i % 5 % 2], demand[i // 3 % 3], None) for i in range(400)]
    b = benefits_of(spark, rows).withColumns({"age_source": F.lit("explicit"), "is_prenatal": F.lit(False), "target_codes": F.array().cast("array<string>")})
    uses = spark.createDataFrame([(f"b{i:03d}", f"d{i // k}") for i in range(0, 400, 3) for k in (8, 30)], "benefit_id string, doc_id string")
    every = edges.leads_to(b, uses)
    whole = {}
    for x in every.join(b.select(F.col("benefit_id").alias("to_benefit_id"), "title"), "to_benefit_id").collect():
        whole.setdefault((x["from_benefit_id"], x["relation"]), set()).add((x["title"], x["to_benefit_id"], x["reason"]))
    some = {f"b{i:03d}" for i in range(0, 400, 9)}
    got = {}
    for x in edges.first_leads_to(b, uses, spark.createDataFrame([(x,) for x in some], "benefit_id string"), 5).collect():
        got.setdefault((x["from_benefit_id"], x["relation"]), set()).add((x["to_benefit_id"], x["reason"]))
    assert set(got) == {k for k in whole if k[0] in some} and {k[1] for k in got} == {"REQUIRES_BENEFIT", "SHARED_DOC", "NEXT_STEP"}
    for (a, relation), found in got.items():
        want = sorted(whole[a, relation])
        assert {x[1:] for x in want[:5 if relation == "REQUIRES_BENEFIT" else None]} <= found <= {x[1:] for x in want} and (relation != "REQUIRES_BENEFIT" or len(found) <= 6 < len(want))
    p = spark.createDataFrame([(i, ["1", "2", None][i % 3], [[], [3], [3, 9], [8]][i % 4], False, False, False) for i in range(60)] + [(3, "1", [8], False, False, False)], "profile_id int, area_code string, ages array<int>, is_pregnant boolean, is_single_parent boolean, has_disability boolean")
    asked = []

    def first(of):
        asked.extend(x[0] for x in of.collect())
        return edges.first_leads_to(b, uses, of, 70)

    plain, title = {}, {x[0]: x[4] for x in rows}
    for m in serve.match(p.where("profile_id <> 3"), b).where("rank <= 30").collect():
        plain.setdefault(m["profile_id"], []).extend((serve.RELATIONS.index(k[1]), title[k[0]], t, k[0], to, why) for k in whole if k[0] == m["benefit_id"] for t, to, why in whole[k])
    want = [(i, n + 1, *x[3:5], serve.RELATIONS[x[0]], x[5]) for i, found in plain.items() for n, x in enumerate(sorted(found)[:70])]
    out = serve.next_steps_of_profiles(p, first, b, 70)
    got = sorted(tuple(x) for x in out.where("profile_id <> 3").select("profile_id", "step", "from_benefit_id", "to_benefit_id", "relation", "reason").collect())
    assert got == sorted(want) and {x[4] for x in got} >= {"REQUIRES_BENEFIT", "SHARED_DOC"}
    assert len(asked) == len(set(asked)) < 400 and out.where("profile_id = 3").count() == 140  # two rows of one profile


def test_match_uses_effective_bounds_and_never_filters_by_attribute(spark):
    b = spark.createDataFrame([("x", "1", "区", 12, 35, "inferred", False, ["088"], "b"), ("y", "130001", "都", None, None, "unknown", False, None, "a"), ("z", "2", "町", 0, 100, "explicit", False, [], "c"), ("p", "1", "区", None, 0, "explicit", True, [], "d")],
                              "benefit_id string, area_code string, area_name string, effective_min_age_months int, effective_max_age_months int, age_source string, is_prenatal boolean, target_codes array<string>, title string")
    p = spark.createDataFrame([(1, "1", [20, 50], False, False, False), (2, None, [20], False, True, False), (3, "1", [], True, False, False), (4, "9", [], False, False, False)], "profile_id int, area_code string, ages array<int>, is_pregnant boolean, is_single_parent boolean, has_disability boolean")
    got = {}
    for r in sorted(serve.match(p, b).collect(), key=lambda r: (r["profile_id"], r["rank"])):
        got.setdefault(r["profile_id"], []).append((r["benefit_id"], r["matched_ages"]))
    assert got == {1: [("x", [20]), ("y", [20, 50])], 2: [("x", [20]), ("z", [20]), ("y", [20])], 3: [("p", [])], 4: [("y", [])]}


def test_groups_without_joining_matches(spark):
    """Counts of needs, of repeated profiles too, equal the groups of all matches; benefits aren't joined by id."""
    from benefold.jobs import fixtures

    data = "/root/testdata/sf0.001"
    profiles, benefits = fixtures.profiles(spark, data), fixtures.benefits(spark, data)
    profiles = profiles.union(profiles.limit(20)).union(profiles.limit(30).withColumn("is_pregnant", F.lit(None).cast("boolean")).withColumn("profile_id", -F.col("profile_id")))
    got = serve.match_groups(profiles, benefits, 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, serve.group_by_attribute(serve.match(profiles, benefits, 9)).collect()))
    assert not re.search(r"Join \w+, \(benefit_id", got._jdf.queryExecution().optimizedPlan().toString())


def test_statuses_of_odd_records(spark):
    """The first record names a place, whatever it is called later; codes are trimmed and repeated ones count once; null bounds and areas; names are made after rows are brought together."""
    rows = [(5, "a", None, 3, "1", "", ["088，088 "]), (4, "b", 0, 3, "1", "新宿区", None), (3, "c", None, 3, "1", "港区", ["777"]), (2, "d", None, None, None, "x", []), (1, "d", None, None, "", "y", [" "]), (6, "a", None, 3, "1", "港区", ["090", "088"])]
    b = spark.createDataFrame(rows, "record_seq long, benefit_id string, effective_min_age_months int, effective_max_age_months int, area_code string, area_name string, target_codes array<string>")
    b = b.withColumns({f"{k}_codes": F.array().cast("array<string>") for k in ("category", "content")})
    ident = lambda kind, x: f"{kind}_" + hashlib.md5(f"{kind}|{x}".encode()).hexdigest()[:12]
    upper, span, place = ident("AGE", "None|3"), ident("AGE", "0|3"), ident("LOCATION", "1")
    t = {c: ident("TAG_TARGET", c) for c in ("088", "090", "777")}
    got, needs = nodes.build_statuses(b)
    assert sorted(map(tuple, needs.collect())) == sorted([("a", upper), ("a", place), ("a", t["088"]), ("a", t["090"]), ("b", span), ("b", place), ("c", upper), ("c", place), ("c", t["777"])])
    assert {r["status_id"]: (r["name"], r["type"], r["code"]) for r in got.collect()} == {
        upper: ("3か月以下", "AGE", None), span: ("0歳〜3か月", "AGE", None), place: ("港区", "LOCATION", "1"), t["088"]: ("ひとり親家庭（088）", "TAG_TARGET", "088"), t["090"]: ("障がい児（090）", "TAG_TARGET", "090"), t["777"]: ("分類777（777）", "TAG_TARGET", "777")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("min(record_seq"):].partition("\n")[2]
    assert "md5(" in plan and below and "md5(" not in below


def test_what_is_joined_and_made_distinct(spark):
    """Names aren't part of what is made distinct; documents meet their names before statuses multiply them; few common documents are left out without moving uses by document."""
    b = spark.createDataFrame([(f"b{i}", i, "1", "t") for i in range(4)] + [("b0", 0, "1", "t")], "benefit_id string, record_seq long, area_code string, title string")
    need = spark.createDataFrame([("b0", "s"), ("b0", "s"), ("b1", "s"), ("x", "s")], "benefit_id string, status_id string")
    said = spark.createDataFrame([("s", "S"), ("s", "S")], "status_id string, name string")
    docs = spark.createDataFrame([("d", "D", True), ("d", "D", True), ("e", "E", False)], "doc_id string, doc_name string, is_probable_document boolean")
    uses = spark.createDataFrame([("b0", "d"), ("b0", "d"), ("b1", "d"), ("b1", "e"), ("x", "d"), (None, "d"), ("b2", None), ("b3", None)], "benefit_id string, doc_id string")
    n, e = serve.neighbourhood(b, need, said, uses, docs)
    assert sorted(map(tuple, e.collect())) == [("b0", "d", "REQUIRES_DOC"), ("b0", "s", "REQUIRES"), ("b1", "d", "REQUIRES_DOC"), ("b1", "s", "REQUIRES")]
    assert not re.search(r"Aggregate \[benefit_id#\d+, \w+_id#\d+, name", n._jdf.queryExecution().optimizedPlan().toString())
    plan = serve.relation_rows(b, need, said, uses, docs)._jdf.queryExecution().analyzed().toString()
    assert "Using(Inner" not in plan and plan.index("benefit_id#") >= 0 and [re.search(r"\((\w+)#", x)[1] for x in re.findall(r"Join Inner, .*", plan)] == ["benefit_id", "status_id", "benefit_id", "doc_id"]
    shared = edges.shared_doc_edges(b.where("benefit_id <> 'b0' or title = 't'").distinct(), uses)
    assert {(x[0], x[1]) for x in shared.collect()} == set() and "LeftAnti" in shared._jdf.queryExecution().optimizedPlan().toString()


def test_match_has_no_limits_of_months(spark):
    """Against brute force: months far out, negative ones, open and inverted ranges, repeated ages, no areas."""
    r = random.Random(9)
    far = [-2**31, -200_000, -1025, -1024, -5, -1, 0, 3, 11, 12, 3071, 3072, 3100, 100_001, 2**31 - 1]
    b = [(f"b{i:03d}", r.choice(["1", "2", "130001", None, ""]), "区", r.choice([None, *far]), r.choice([None, *far]), r.choice(["explicit", "inferred", "unknown"]), r.random() < 0.2, r.choice([[], ["088"], ["090"], ["088", "090"], None]), r.choice("xyz")) for i in range(150)]
    p = [(i, r.choice(["1", "2", "9", None]), r.choice([[], [r.choice(far)], [r.choice(far), r.choice(far)]]), *(r.random() < 0.4 for _ in range(3))) for i in range(80)]
    benefits = spark.createDataFrame(b, "benefit_id string, area_code string, area_name string, effective_min_age_months int, effective_max_age_months int, age_source string, is_prenatal boolean, target_codes array<string>, title string")
    profiles = spark.createDataFrame(p, "profile_id int, area_code string, ages array<int>, is_pregnant boolean, is_single_parent boolean, has_disability boolean")
    got = {}
    for x in sorted(serve.match(profiles, benefits, 9).collect(), key=lambda x: (x["profile_id"], x["rank"])):
        got.setdefault(x["profile_id"], []).append(x["benefit_id"])
    want = {}
    for i, area, ages, pregnant, single, disability in p:
        fits = []
        for x in b:
            lo, hi, codes = x[3], x[4], x[7] or []
            if area is not None and x[1] not in (area, "130001"):
                continue
            ok = any((lo is None or lo <= a) and (hi is None or hi >= a) for a in ages) or (pregnant and x[6]) or (not ages and not pregnant)
            if ok:
                fits.append((single and "088" not in codes, disability and "090" not in codes, ["explicit", "inferred", "unknown"].index(x[5]), lo is None, lo or 0, x[8], x[0]))
        if fits:
            want[i] = [x[-1] for x in sorted(fits)[:9]]
    assert got == want


def test_timeline_excludes_unknown_bounds(spark):
    b = spark.createDataFrame([("x", 0, 11, "explicit", False, "t"), ("y", None, 11, "explicit", False, "t"), ("z", 0, 11, "explicit", True, "t")], "benefit_id string, effective_min_age_months int, effective_max_age_months int, age_source string, is_prenatal boolean, title string")
    assert {(r["stage"], r["benefit_id"]) for r in serve.timeline(b).collect()} == {("0y", "x"), ("prenatal", "z")}


def test_first_record_supplies_attributes(spark):
    records = spark.createDataFrame([("b", 1, "印鑑\n母子手帳"), ("a", 0, "親子手帳（写し）")], "benefit_id string, record_seq long, belongings string").repartition(3)
    docs, need = nodes.build_documents(records)
    assert {r["doc_name"]: r["original_name"] for r in docs.collect()} == {"母子健康手帳": "親子手帳（写し）", "印鑑": "印鑑"} and need.count() == 3


def healthy(spark):
    b = spark.range(100).select(F.concat(F.lit("b"), "id").alias("benefit_id"), F.lit("t").alias("title"), F.lit("s").alias("scheme_id"), (F.col("id") % 60).cast("string").alias("area_code"), F.lit("d").alias("description"), F.lit("s").alias("summary"),
                                F.when(F.col("id") < 70, "explicit").otherwise("unknown").alias("age_source"))
    one = lambda **k: spark.createDataFrame([tuple(k.values())], list(k))
    out = {"benefits": b, "schemes": one(scheme_id="s"), "statuses": one(status_id="s", name="n", type="t"), "documents": one(doc_id="d", doc_name="n")}
    return out | {t: one(benefit_id="b0", x="y") for t in quality.MUST_HAVE if t not in out}


def problems(spark, tables, previous=None):
    return {(r["table"], r["check"], r["column"]) for r in quality.check_tables(spark, tables, previous).collect()}


def test_quality_gate(spark):
    good = healthy(spark)
    before = spark.createDataFrame([("benefits", 100)], "table string, rows long")
    assert problems(spark, good, before) == set()
    b = good["benefits"]
    bad = good | {"schemes": good["schemes"].limit(0), "benefits": b.where("benefit_id < 'b5'").withColumns({"title": F.lit(" "), "age_source": F.lit("unknown"), "area_code": F.lit("1")}).drop("summary")}
    del bad["documents"]
    found = problems(spark, bad, before)
    assert {("schemes", "rows", ""), ("benefits", "blank", "title"), ("benefits", "unknown_age", "age_source"), ("benefits", "areas", "area_code"), ("benefits", "missing column", "summary"), ("documents", "missing table", ""), ("benefits", "fewer rows", "")} <= found


def test_gate_reports_an_empty_table_once(spark):
    """One problem each, no shares, no comparison, no crash; whether or not the table's columns are all there."""
    good = healthy(spark)
    before = spark.createDataFrame([(t, 100) for t in quality.MUST_HAVE], "table string, rows long")
    assert problems(spark, {t: df.limit(0) for t, df in good.items()}, before) == {(t, "rows", "") for t in quality.MUST_HAVE}
    assert problems(spark, good | {t: good[t].limit(0).select(F.lit(1).alias("other")) for t in ("benefits", "documents")}) == {("benefits", "rows", ""), ("documents", "rows", "")}


def graph(spark, **changed):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes_ = {"benefits": ("benefit_id", "b"), "statuses": ("status_id", "s"), "documents": ("doc_id", "d"), "schemes": ("scheme_id", "c")}
    out = {t: one([(f"{p}{i}",) for i in range(3)], f"{c} string") for t, (c, p) in nodes_.items()}
    out["benefit_requires_status"] = one([("b0", "s1"), ("b1", "s1")], "benefit_id string, status_id string")
    out["benefit_requires_doc"] = one([("b0", "d1"), ("b0", "d2")], "benefit_id string, doc_id string")
    out["benefit_in_scheme"] = one([("b0", "c1")], "benefit_id string, scheme_id string")
    out["benefit_leads_to"] = one([("b0", "b1", "X"), ("b0", "b1", "Y")], "from_benefit_id string, to_benefit_id string, relation string")
    return out | {t: one(rows, out[t].schema) for t, rows in changed.items()}


def found(spark, **changed):
    return {tuple(r) for r in quality.integrity(graph(spark, **changed), EDGES, KEYS).collect()}


def test_keys_and_ends(spark):
    assert found(spark) == set()
    assert found(spark, statuses=[("s1",), ("s1",), ("s2",), (None,)]) == {("statuses", "status_id", "repeated key", 2), ("statuses", "status_id", "null", 1)}
    assert found(spark, benefit_leads_to=[("b0", "b9", "X"), ("b0", "b9", "X"), ("b7", "b1", None)]) == {
        ("benefit_leads_to", "from_benefit_id,to_benefit_id,relation", "repeated key", 2), ("benefit_leads_to", "to_benefit_id", "meets no node", 2), ("benefit_leads_to", "from_benefit_id", "meets no node", 1),
        ("benefit_leads_to", "from_benefit_id,to_benefit_id,relation", "null", 1)}
    assert found(spark, benefits=[]) >= {("benefit_requires_doc", "benefit_id", "meets no node", 2), ("benefit_in_scheme", "benefit_id", "meets no node", 1)}
    assert found(spark, benefit_in_scheme=[("b0,c1", "c1"), (None, "c2")]) == {("benefit_in_scheme", "benefit_id", "meets no node", 1), ("benefit_in_scheme", "benefit_id", "null", 1), ("benefit_in_scheme", "benefit_id,scheme_id", "null", 1)}


def record(i, **more):
    return {"psid": f"p{i:03d}", "title": "児童扶養手当" if i < 60 else f"事業{i % 7}", "description": "説明", "summary": "概要", "area": {"areaCode": f"{131000 + i % 60};区{i % 60}"}, "institutionName": {"canonicalName": f"制度{i % 9}"},
            "target": {"targetPersons": ["満3歳未満", "小学生", "区民"][i % 3], "conditions": ["児童扶養手当を受けている方", "所得が46万円以下"][i % 2]}, "tag": {"targetCode": ["088"]}, "documents": ["印鑑", "住民票\n申請書"][i % 2]} | more


def written(tmp_path, name, records):
    (tmp_path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records), encoding="utf-8")
    return str(tmp_path / name)


def test_whole_publication(spark, tmp_path, monkeypatch):
    """Built and read from what was written, refused by the gate and by keys with the old version holding, restored."""
    root, now = str(tmp_path / "dev"), datetime(2024, 1, 1, tzinfo=UTC)
    records = R.read_registry(spark, written(tmp_path, "a.json", [record(i) for i in range(120)])).cache()
    read = spark.sparkContext.accumulator(0)

    first = J.publish_records(spark, _counted(records, read), root, now)
    assert read.value == 2 * 120  # benefits; tags and documents
    counts = dict(map(tuple, J.row_counts(spark, root, list(quality.MUST_HAVE)).collect()))
    assert {t: counts[t] for t in ("benefits", "schemes", "documents", "benefit_requires_doc", "benefit_in_scheme")} == {"benefits": 120, "schemes": 9, "documents": 3, "benefit_requires_doc": 180, "benefit_in_scheme": 120}
    direct = build_tables(records)
    for name in ("benefits", "benefit_requires_doc"):
        a, b = (sorted(map(str, typed(name, x).collect())) for x in (direct[name], P.read(spark, root, name)))
        assert a == b, name
    few = R.read_registry(spark, written(tmp_path, "b.json", [record(i) for i in range(70)]))
    with pytest.raises(J.QualityError, match="fewer rows"):
        J.publish_records(spark, few, root, now + timedelta(days=1))
    assert P.current(spark, root) == first and P.last_entry(spark, root) == 1
    check, calls = quality.check_tables, []

    def slow(spark, tables, previous=None):
        if not calls:
            P.release(spark, root, first, list(quality.MUST_HAVE))  # another job, meanwhile
        calls.append(1)
        return check(spark, tables, previous)

    monkeypatch.setattr(quality, "check_tables", slow)
    second = J.publish_registry(spark, written(tmp_path, "d.json", [record(i) for i in range(130)]), root, now=now + timedelta(days=2))
    assert len(calls) == 2 and P.last_entry(spark, root) == 3 and P.current(spark, root) == second and P.read(spark, root, "benefits").count() == 130
    J.restore_registry(spark, root, first, now + timedelta(days=3))
    assert P.current(spark, root) == first and P.read(spark, root, "benefits").count() == 120
    with pytest.raises(ValueError):
        P.restore(spark, root, second, ["schemes2"])


def _counted(records, read):
    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return records.mapInArrow(run, records.schema)


def test_two_publications_at_once(spark, tmp_path):
    """Of two that saw the same state one is refused; a job that meets another one compares with it before it follows."""
    root = str(tmp_path / "x")
    first = P.publish(spark, {"a": spark.range(3)}, root)
    staged = [P.stage({"a": spark.range(4 + k)}, root) for k in range(2)]
    gate, done = threading.Barrier(2), []

    def go(version):
        gate.wait()
        try:
            done.append(P.release(spark, root, version, ["a"], after=1))
        except P.Conflict:
            done.append(None)

    threads = [threading.Thread(target=go, args=(v,)) for v in staged]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done, key=str) == [2, None] and P.current(spark, root) in staged and P.last_entry(spark, root) == 2
    assert P.current(spark, root, 1) == first
    third = P.publish(spark, {"a": spark.range(9)}, root)
    assert P.current(spark, root) == third and P.read(spark, root, "a").count() == 9
    (tmp_path / "x/_manifest/000000004.json").write_text("")  # created, never written
    P.PATIENCE, kept = 0.3, P.PATIENCE
    assert P.current(spark, root) == third and P.release(spark, root, staged[0], ["a"]) == 5 and P.current(spark, root) == staged[0]
    P.PATIENCE = kept


def test_cache_log(spark, tmp_path):
    """Appended, folded and read meanwhile: the last row of each key, nothing twice, and only the files of asked keys."""
    r, root, rows = random.Random(21), str(tmp_path / "log"), []
    key = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    assert L.read(spark, root) is None and L.compact(spark, root) is None
    schema = "cache_key string, generated_at long, result string"
    asked = spark.createDataFrame([(key(k),) for k in range(0, 600, 7)], "cache_key string")
    assert L.misses(asked, root).count() == asked.count()
    for batch in range(4):
        new = [(key(r.randrange(400)), batch * 1000 + i, f"{batch}-{i}") for i in range(200)] + [(key(3), batch * 1000 + 500, "hot")] * 50
        rows += new
        L.append(spark.createDataFrame(new, schema).repartition(2), root)
        if batch in (1, 2):
            L.compact(spark, root)
        want = {}
        for k, at, result in rows:
            want[k] = max(want.get(k, (-1, "")), (at, result))
        got = {x["cache_key"]: (x["generated_at"], x["result"]) for x in L.hits(asked, root).collect()}
        every = {key(k) for k in range(0, 600, 7)}
        assert got == {k: v for k, v in want.items() if k in every}
        assert {x[0] for x in L.misses(asked, root).collect()} == every - set(want)
    few = L.read(spark, root, [key(3)[:2]])
    assert {x[0] for x in few.select("bucket").distinct().collect()} == {key(3)[:2]}
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(few) <= 6 < files(L.read(spark, root))
    (tmp_path / "log/batch=torn").mkdir()  # a batch that is being written
    assert L.read(spark, root).count() == L.read(spark, root).count() and len(L._batches(spark, root)) == 4
    entry = P.last_entry(spark, root)
    with pytest.raises(P.Conflict):
        P.release(spark, root, "x", ["log"], after=entry - 1)


def test_publish_restore_clone(spark, tmp_path):
    root, now = str(tmp_path / "dev"), datetime(2024, 1, 1, tzinfo=UTC)
    first = P.publish(spark, {"a": spark.range(3), "b": spark.range(2)}, root, now)
    second = P.publish(spark, {"a": spark.range(5), "b": spark.range(2)}, root, now + timedelta(days=1))
    assert P.current(spark, root) == second and P.read(spark, root, "a").count() == 5
    P.restore(spark, root, first, ["a", "b"], now + timedelta(days=2))
    assert P.read(spark, root, "a").count() == 3
    assert P.snapshots(spark, root, now + timedelta(days=60)).count() == 1
    for call in (lambda: P.restore(spark, root, first, ["a", "c"]), lambda: P.clone(spark, root, str(tmp_path / "prod"), ["a"])):
        try:
            call()
        except ValueError:
            continue
        raise AssertionError("not refused")
    P.clone(spark, root, str(tmp_path / "test"), ["a"])
    assert P.read(spark, str(tmp_path / "test"), "a").count() == 3


def test_records_are_numbered_by_file_and_line(spark, tmp_path):
    """Whatever the sizes of the files and of their splits, and in whatever order they were written."""
    r = random.Random(6)
    sizes = {"a": 1, "b": 900, "c": 0, "d": 40, "e/f": 300, "z": 2}
    want = []
    for name in sizes:
        rows = [{"id": f"{name}{i}", "summary": "x" * r.choice([1, 900])} for i in range(sizes[name])]
        want += [x["id"] for x in rows]
        at = tmp_path / "in" / f"{name}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("".join(json.dumps(x) + "\n" for x in rows))
    glob = [str(tmp_path / "in/*.json"), str(tmp_path / "in/*/*.json")]
    for split in ("200", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = [tuple(x) for x in R.read_registry(spark, glob).select("record_seq", "id").orderBy("record_seq").collect()]
        assert got == list(enumerate(want)), split
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "x1.json").write_text('{"id": "same", "summary": "first"}\n')
    (tmp_path / "x2.json").write_text('no json\n{"id": "same"\n[1]\n\n' + '{"id": "same", "summary": "later"}\n' * 3000)
    rows = R.read_registry(spark, str(tmp_path / "x*.json"))
    assert rows.count() == 3001 and build_benefits(rows).select("summary").collect()[0][0] == "first" and rows.where("record_seq = 0").first()["summary"] == "first"


def test_documents_are_read_in_splits(spark, tmp_path):
    """Arrays and envelopes, in splits down to 100 bytes, against a JSON parser: braces, brackets, quotes and backslashes in strings, nested objects, elements that are no objects."""
    r = random.Random(31)
    text = lambda: "".join(r.choice(["}", "{", "[", "]", '"', "\\", ",", ":", "a", "漢", " ", "\n", '"data": [', "},{"]) for _ in range(r.randrange(12)))
    one = lambda i: {"id": f"i{i}", "summary": text(), "target": {"targetPersons": text(), "greaterThan": {"targetAge": 1}}, "relatedLink": [{"title": text(), "uri": "u"}] * r.randrange(3)}
    files = []
    for n in range(3):
        elements = [one(f"{n}-{i}") if r.random() < 0.8 else r.choice([1, "x},{", None, "y, z"]) for i in range(60)] + [one(f"{n}-last")]
        files.append(elements)
        (tmp_path / f"a{n}").write_text(json.dumps(elements, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])), encoding="utf-8")
        whole = {"meta": {"records": text(), "n": [1, {"a": 2}]}, "note": text(), "data": elements, "more": [{"id": "no"}], "items": [{"id": "neither"}]}
        (tmp_path / f"e{n}").write_text(json.dumps(whole, ensure_ascii=r.random() < 0.5), encoding="utf-8")
    (tmp_path / "e3").write_text(json.dumps(one("single")) + "\n")
    want, before = [], 0
    for elements in files:
        want += [(before + k, x["id"], x["summary"], x["target"]["targetPersons"], len(x["relatedLink"])) for k, x in enumerate(elements) if isinstance(x, dict)]
        before += len(elements)
    for split in ("100", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        for layout in ("array", "envelope"):
            got = R.read_registry(spark, str(tmp_path / f"{layout[0]}*"), layout).select("record_seq", "id", "summary", "target.targetPersons", F.size("relatedLink")).orderBy("record_seq").collect()
            got = [tuple(x) for x in got]
            assert got[: len(want)] == want and [x[1] for x in got[len(want):]] == (["isingle"] if layout == "envelope" else []), (split, layout)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_registry_layouts(spark, tmp_path):
    records = [{"id": "x", "basicInformation": {"psid": "p"}, "belongings": "印鑑"}, "no object", {"basicInformation": {"psid": "q"}}]
    for name, text in (("array", json.dumps(records)), ("envelope", json.dumps({"items": records}))):
        (tmp_path / name).write_text(text)
        got = R.read_registry(spark, str(tmp_path / name), name)
        assert [tuple(r) for r in got.select("record_seq", R.benefit_id()).orderBy("record_seq").collect()] == [(0, "x"), (2, "q")]
        (tmp_path / f"{name}2").write_text(text)
        two = R.read_registry(spark, str(tmp_path / f"{name}*"), name)
        assert [r[0] for r in two.select("record_seq").orderBy("record_seq").collect()] == [0, 2, 3, 5]
    (tmp_path / "lines").write_text("\n".join(json.dumps(r) for r in records if isinstance(r, dict)))
    assert R.read_registry(spark, str(tmp_path / "lines")).count() == 2


def test_predicates_differ_on_missing_bounds(spark):
    r = spark.range(1).select(filters.age_in_range(F.lit(5), F.lit(None).cast("int"), F.lit(9)), filters.overlaps_stage(F.lit(None).cast("int"), F.lit(9), F.lit(0), F.lit(11), F.lit(False), F.lit(False)), filters.ranges_overlap(F.lit(None).cast("int"), F.lit(9), F.lit(5), F.lit(None).cast("int"))).first()
    assert tuple(r) == (True, False, True)
    below = spark.createDataFrame([(None, -5, -7, None, True), (None, -5, -4, None, False), (-9, None, None, -10, False), (None, None, None, -10**6, True), (3, 1, None, None, True)], "a int, b int, c int, d int, ok boolean")
    assert all(x["ok"] == x["got"] for x in below.select("ok", filters.ranges_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect())


def test_uses_of_documents_are_exchanged_once_to_be_distinct(spark):
    rows = spark.createDataFrame([(f"b{k}", "131016", k) for k in range(50)], "benefit_id string, area_code string, record_seq long")
    uses = spark.createDataFrame([(f"b{k}", f"d{k // 2}") for k in range(50)] + [(f"b{k}", "common") for k in range(50)] + [("b0", None)], "benefit_id string, doc_id string")
    out = edges.shared_doc_edges(rows, uses.distinct())
    assert {(r[0], r[1]) for r in out.collect()} == {(f"b{k}", f"b{k + 1}") for k in range(0, 50, 2)}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
