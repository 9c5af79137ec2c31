"""Retrieval, requirements, verdicts, conflicts, scores on small cases."""

from dataclasses import replace

from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import conflicts, deliverables, evaluation, requirements, retrieval, verdicts

CHUNKS = [
    (1, 10, "2.2 구조 — 항목: 방수 등급, 사양: IP65", "카탈로그 > LT-150 사양", ["LT-150"]),
    (2, 10, "방수 등급: IP66", "카탈로그 > LT-200 사양", ["LT-200"]),
    (3, 11, "보증 기간: 2년", "카탈로그 > 공통", []),
    (4, 12, "3. 시험 설비 보유 현황 — 염수분무 시험기: 미보유", "현황 > 3. 시험 설비", []),
    (5, 12, "진동 시험기: 미보유", "현황 > 3. 시험 설비", []),
]


def chunks(spark):
    df = spark.createDataFrame([(i, p, 1, "catalog", c, s, m) for i, p, c, s, m in CHUNKS], "chunk_id long, parent_id long, document_id long, doc_kind string, content string, section_path string, model_tags array<string>")
    return df.withColumn("keywords", T.keywords(F.col("content")))


def ask(spark, text, probes=None, model=None, **settings):
    q = spark.createDataFrame([(1, text, [text, *(probes or [])], model)], "query_id long, text string, probes array<string>, model_filter string")
    return retrieval.search(q, chunks(spark), s=replace(retrieval.Settings(), threshold=0.0, **settings)).orderBy("rank").collect()


def test_exact_token_decides(spark):
    assert ask(spark, "IP66 이상")[0]["chunk_id"] == 2
    assert ask(spark, "IP65")[0]["chunk_id"] == 1
    assert ask(spark, " ") == []


def test_stripped_probe_finds_equipment(spark):
    assert ask(spark, "내진동 시험", ["진동 시험"])[0]["chunk_id"] == 5


def test_model_filter_demotes_but_keeps(spark):
    got = {r["chunk_id"]: r["score"] for r in ask(spark, "방수 등급", model="LT-150")}
    plain = {r["chunk_id"]: r["score"] for r in ask(spark, "방수 등급")}
    assert got[1] == round(plain[1] + 0.1, 6) and abs(got[2] - plain[2] * 0.3) < 2e-6


def test_parent_cap(spark):
    rows = spark.createDataFrame([(1, i, 7 if i < 4 else 8, 1.0 - i / 10) for i in range(6)], "query_id long, chunk_id long, parent_id long, score double")
    assert [r["chunk_id"] for r in retrieval.diverse_top(rows, retrieval.Settings()).orderBy("rank").collect()] == [0, 1, 4, 5]


def test_semantic_top(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "chunk_id long, embedding array<double>")
    got = {r["chunk_id"]: r["semantic"] for r in retrieval.semantic_top(q, c, 40).collect()}
    assert round(got[1], 3) == 0.995 and got[2] == got[3] == 0.0 and 4 not in got


def test_requirement_queries(spark):
    r = spark.createDataFrame([(1, "내진동 시험", "KS C 7658", "test_standard", True), (2, " ", "x", "other", True), (3, "LT-150 실적", "", "track_record", True)], "requirement_id long, item string, requirement_text string, category string, is_active boolean")
    got = {x["query_id"]: x for x in retrieval.requirement_queries(r, "LT-200").collect()}
    assert set(got) == {1, 3} and got[1]["model_filter"] == "LT-200" and got[3]["model_filter"] == "LT-150"
    assert got[1]["probes"] == ["내진동 시험", "내진동 시험 KS C 7658", "진동 시험"]


def test_requirements(spark):
    response = '{"requirements":[{"clause_no":" 2.1 ","item":"a","category":"odd","source_page":1},{"clause_no":"2.1","item":"a"},{"clause_no":"2.1","item":"b","requirement_text":"x","source_page":"p"},{"clause_no":"","item":"c"}],"submission_items":[{"seq":1,"name":"n"},{"seq":"x","name":"m"},{"seq":1,"name":"o"}],"participation_reqs":[{"seq":"3.1","text":"t"},{"seq":"","text":"u"}],"bid_info":{"title":" T ","announced_on":"2025-7-1","bid_due_at":"soon"},"warnings":["w"]}'
    rows = spark.createDataFrame([(1, 1, "announcement", response), (1, 2, "techspec", "oops"), (1, 3, "techspec", None)], "project_id long, document_id long, doc_type string, response string")
    parsed, bad = requirements.parse_responses(rows)
    assert bad.count() == 2
    made, warned = requirements.save_requirements(requirements.requirement_rows(parsed))
    assert {(r["clause_no"], r["item"], r["category"], r["source_page"]) for r in made.collect()} == {("2.1", "a", "other", 1), ("2.1", "b", "other", None)}
    assert sorted(r["kind"] for r in warned.collect()) == ["blank", "duplicate", "no text"]
    items, wrong = requirements.save_submissions(parsed)
    assert [(r["seq"], r["name"]) for r in items.collect()] == [(1, "n")] and wrong.count() == 1
    assert [r["seq"] for r in requirements.save_participation(parsed).collect()] == ["3.1"]
    fields = [f"'{''}' AS {f}" for f in requirements.HEADER_TEXT if f != "org"] + ["'kept' AS org", "CAST(NULL AS date) AS announced_on"] + [f"CAST(NULL AS timestamp) AS {f}" for f in requirements.HEADER_TIMES]
    p, w = requirements.fill_header(spark.sql(f"SELECT 1L AS project_id, {', '.join(fields)}"), parsed)
    row = p.first()
    assert (row["title"], row["org"], str(row["announced_on"]), row["bid_due_at"]) == ("T", "kept", "2025-07-01", None)
    assert [r["field"] for r in w.collect()] == ["bid_due_at"]


def assessments(spark):
    kind = "run_id long, requirement_id long, clause_no string, category string, item string, requirement_text string, our_value string, verdict string, rationale string, gap_detail string, remedy string, side_effects array<struct<field:string,op:string,value:double,unit:string,source:string>>"
    return spark.createDataFrame(
        [
            (1, 1, "3.1", "filter_grade", "방수 등급", "IP66 이상", "IP65", "GAP", "", "한 등급 미달", "IP66 하우징", [("weight", "add", 1.4, "kg", ""), ("lead_time", "add", 3.0, "주", "")]),
            (1, 2, "3.2", "dimension", "무게", "8 kg 이하", "7.2 kg", "MEET", "ok", "", "", []),
            (1, 3, "3.3", "performance", "동작 온도", "-20℃ ~ 50℃", "-20 ~ 45℃", "GAP", "", "5℃", "확장 온도", [("price", "add", 12.0, "%", ""), ("lead_time", "add", 2.0, "주", "")]),
            (1, 4, "4.3", "test_standard", "내염수분무 시험", "240시간", "", "CHECK", "없음", "", "", []),
        ],
        kind,
    )


def test_conflicts(spark):
    issues, _ = conflicts.side_effect_issues(assessments(spark))
    (row,) = issues.collect()
    assert row["clause_nos"] == ["3.1", "3.2"] and row["severity"] == "high" and "7.2 + 1.4 = 8.6" in row["description"]
    terms = spark.createDataFrame([(1, "45일", "계약체결일로부터 60일 이내")], "run_id long, base_text string, limit_text string")
    got = {tuple(r["clause_nos"]): (r["total"], r["severity"]) for r in conflicts.lead_time_issues(assessments(spark), terms).collect()}
    assert got == {("3.1",): (66.0, "high"), ("3.3",): (59.0, "medium"), ("3.1", "3.3"): (80.0, "high")}


def test_verdict_repair(spark):
    rows = [(1, "MAYBE", "found_sufficient", [1], 0.5), (2, "MEET", "found_sufficient", [1], 2.0), (3, "MEET", "found_sufficient", [], 0.5), (4, "GAP", "found_absent", [1], 0.5), (5, "MEET", "found_sufficient", [1], 1.0)]
    a = spark.createDataFrame([(1, i, v, s, c, f, "r", "") for i, v, s, c, f in rows], "run_id long, requirement_id long, verdict string, evidence_state string, cited_ranks array<int>, confidence double, rationale string, our_value string")
    hits = spark.createDataFrame([(1, i, 2) for i in (1, 3, 4, 5)], "run_id long, requirement_id long, hits int")
    got = {r["requirement_id"]: r for r in verdicts.repair(a, hits).collect()}
    assert [got[i]["ai_verdict"] for i in range(1, 6)] == ["CHECK", "CHECK", "CHECK", "CHECK", "MEET"]
    assert got[2]["evidence_state"] == "not_found" and got[2]["confidence"] is None and got[2]["rationale"].startswith(verdicts.REPAIR_NOTE)


def test_traps(spark):
    kind = "trap_id string, check_no int, kind string, clause_nos array<string>, equals string, contains string, not_contains string, any_of array<string>, all_of array<string>, field string, value double, model string, severity string"
    n = None
    checks = spark.createDataFrame([("T1", 0, "verdict", ["3.1"], "GAP", n, n, n, n, n, n, n, n), ("T1", 1, "our_value", ["3.2"], n, "7.2", "9.8", n, n, n, n, n, n), ("T1", 2, "no_top_evidence_model", ["3.1", "3.2"], n, n, n, n, n, n, n, "LT-200", n), ("T2", 0, "side_effect", ["3.1"], n, n, n, n, n, "weight", 1.4, n, n), ("T2", 1, "cross_issue", ["3.2", "3.1"], n, "8.6", n, n, n, n, n, n, "high"), ("T4", 0, "verdict", ["9.9"], "CHECK", n, n, n, n, n, n, n, n)], kind)
    a = assessments(spark).withColumns({"ai_verdict": F.col("verdict"), "evidence_state": F.lit("")})
    e = spark.createDataFrame([("3.1", 1, "IP65", ["LT-150"]), ("3.1", 2, "IP66", ["LT-200"])], "clause_no string, rank int, content string, model_tags array<string>")
    got = {r["trap_id"]: r["passed"] for r in evaluation.traps(evaluation.trap_checks(checks, a, e, conflicts.side_effect_issues(a)[0])).collect()}
    assert got == {"T1": True, "T2": True, "T4": False}


def test_deliverables(spark):
    a = assessments(spark)
    issues = conflicts.side_effect_issues(a)[0].withColumn("is_dismissed", F.lit(False))
    req = a.select("requirement_id", "clause_no", F.lit("3").alias("chapter"), "category", "item", "requirement_text").withColumns({"is_active": F.lit(True), "is_edited": F.lit(False)})
    e = spark.createDataFrame([(1, 1, "제품 카탈로그", "HB-CAT-2025-02", "2.2 구조", 1)], "run_id long, requirement_id long, doc_title string, doc_no string, location string, rank int")
    m = {r["clause_no"]: r for r in deliverables.compliance_matrix(req, a.drop("clause_no", "category", "item", "requirement_text"), e, issues).collect()}
    assert m["3.1"]["remedy"] == "IP66 하우징 (무게 +1.4kg, 납기 +3주)" and m["3.1"]["evidence_document"] == "제품 카탈로그 (HB-CAT-2025-02)" and m["3.1"]["notes"] == "이슈 1"
    assert m["4.3"]["our_value"] == "-" and m["3.2"]["remedy"] == ""
    asked = deliverables.inquiries(a, issues).orderBy("seq").collect()
    assert [(r["clause_refs"], r["source_kind"]) for r in asked] == [(["4.3"], "check"), (["3.1", "3.2"], "cross_clause"), (["3.3"], "gap_remedy")]
    items = spark.createDataFrame([(1, 1, 1, "입찰참가신청서", ""), (1, 1, 8, "시험성적서", "기술사양서 제4장 전체"), (1, 1, 7, "제품 카탈로그", ""), (1, 1, 9, "x", "")], "project_id long, run_id long, seq int, name string, note string")
    hits = spark.createDataFrame([(1, 8, 1, "q"), (1, 7, 1, "q")], "project_id long, seq int, rank int, quote string")
    got = {r["seq"]: r["status"] for r in deliverables.submission_checklist(items, hits, a).collect()}
    assert got == {1: "need", 8: "uncertain", 7: "have", 9: "uncertain"}
