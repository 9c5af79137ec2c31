"""Limits with several numbers, runs graded apart, numbers inside a batch, odd responses, numbering, the index table, writers."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import conflicts, evaluation, requirements
from clausegrid.sources import index, io


@pytest.mark.parametrize("text,unit,want", [
    ("50 W 등기구, 무게 8 kg 이하", "kg", ("<=", None, 8.0, "kg")),
    ("20℃ 이상 50℃ 이하", "℃", ("range", 20.0, 50.0, "℃")),
    ("영하 20℃ 이상 50℃ 미만", "℃", ("range", -20.0, 50.0, "℃")),
    ("-10 ~ 40℃", "℃", ("range", -10.0, 40.0, "℃")),
    ("8 kg 이하, 납기 3주 이내", "주", ("<=", None, 3.0, "주")),
    ("8 kg 이하, 10 kg 미만", "kg", ("<=", None, 8.0, "kg")),
    ("1,200 lm 초과", "lm", (">", 1200.0, None, "lm")),
    ("8 kg (받침 포함) 이하", "kg", ("<=", None, 8.0, "kg")),
    ("8 kg 이하", "mm", ("<=", None, 8.0, "kg")),
    ("8 kg", "kg", (None, None, None, None)),
    ("", "kg", (None, None, None, None)),
    (None, "kg", (None, None, None, None)),
])
def test_a_limit_takes_the_number_before_its_word(spark, text, unit, want):
    c = spark.createDataFrame([(text,)], "t string").select(conflicts.parse_constraint(F.col("t"), F.lit(unit)).alias("c")).first()["c"]
    assert (c["op"], c["lo"], c["hi"], c["unit"]) == want


def test_open_and_closed_ends(spark):
    rows = spark.createDataFrame([(v, t) for v in (19.0, 20.0, 30.0, 50.0) for t in ("20℃ 이상 50℃ 미만", "20℃ 초과 50℃ 이하", "20 ~ 50℃", "x")], "v double, t string")
    got = {(r["v"], r["t"]): r["b"] for r in rows.select("v", "t", conflicts.violates(F.col("v"), conflicts.parse_constraint(F.col("t"))).alias("b")).collect()}
    assert [got[v, "20℃ 이상 50℃ 미만"] for v in (19.0, 20.0, 30.0, 50.0)] == [True, False, False, True]
    assert [got[v, "20℃ 초과 50℃ 이하"] for v in (19.0, 20.0, 30.0, 50.0)] == [True, True, False, False]
    assert [got[v, "20 ~ 50℃"] for v in (19.0, 20.0, 30.0, 50.0)] == [True, False, False, False] and got[19.0, "x"] is None


def test_every_run_is_graded_on_the_whole_key(spark):
    key = spark.createDataFrame([("1", "MEET"), ("2", "GAP")], "clause_no string, expected_verdict string")
    said = spark.createDataFrame([(1, "1", "MEET"), (1, "2", "GAP"), (2, "1", "GAP"), (2, "2", "CHECK"), (3, "1", "MEET")], "run_id long, clause_no string, ai_verdict string")
    score = {r["run_id"]: (r["correct"], r["total"]) for r in evaluation.accuracy(evaluation.graded(key, said)).collect()}
    assert score == {1: (2, 2), 2: (0, 2), 3: (1, 2)}
    runs = spark.createDataFrame([(1,), (9,)], "run_id long")
    assert {r["run_id"]: r["correct"] for r in evaluation.accuracy(evaluation.graded(key, said, runs)).collect()} == {1: 2, 9: 0}
    assert {(r["run_id"], r["actual"]) for r in evaluation.confusion(evaluation.graded(key, said)).collect()} == {(2, "GAP"), (2, "CHECK"), (3, "missing")}
    one = evaluation.accuracy(evaluation.graded(key, said.filter("run_id = 1").drop("run_id"))).first()
    assert (one["correct"], one["total"]) == (2, 2) and "run_id" not in one


def test_a_trap_passes_and_fails_by_run(spark):
    none = F.lit(None).cast("string")
    checks = spark.createDataFrame([(1, 0, "verdict", ["1"], "MEET"), (2, 0, "cross_issue", ["1", "2"], None)], "trap_id long, check_no int, kind string, clause_nos array<string>, equals string")
    checks = checks.withColumns({x: none for x in ("contains", "not_contains", "field", "model", "severity")}).withColumns({"any_of": F.array(none), "all_of": F.array(none), "value": F.lit(1.0)})
    said = spark.createDataFrame([(1, "1", "MEET"), (2, "1", "GAP")], "run_id long, clause_no string, ai_verdict string").withColumns({x: F.lit("") for x in ("evidence_state", "our_value", "rationale")})
    said = said.withColumn("side_effects", F.array().cast("array<struct<field:string,value:double>>"))
    found = spark.createDataFrame([(1, "1", 1, "c", ["m"])], "run_id long, clause_no string, rank int, content string, model_tags array<string>")
    issues = spark.createDataFrame([(2, ["2", "1"], "high", "d")], "run_id long, clause_nos array<string>, severity string, description string")
    got = {(r["run_id"], r["trap_id"]): r["passed"] for r in evaluation.traps(evaluation.trap_checks(checks, said, found, issues)).collect()}
    assert got == {(1, 1): True, (2, 1): False, (1, 2): False, (2, 2): True}


def test_a_text_is_searched_for_limits_once(spark):
    """However many of a constraint's fields are read: the parsing grew with every use of a field."""
    rows = spark.range(3).selectExpr("id", "concat(id, ' kg 이하') AS t").withColumn("c", conflicts.parse_constraint(F.col("t"), F.lit("kg")))
    rows = rows.select("c.op", "c.lo", "c.hi", "c.unit", conflicts.violates(F.lit(1.0), F.col("c")).alias("broken"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 0
    assert [(r["hi"], r["broken"]) for r in rows.orderBy("hi").collect()] == [(0.0, True), (1.0, False), (2.0, False)]


def test_a_clause_without_an_assessment_passes_no_check(spark):
    """Nothing found against it is no pass; a clause that is assessed and has no evidence does pass."""
    none = F.lit(None).cast("string")
    rows = [(t, 0, kind, [c]) for t, c in ((1, "there"), (2, "missing")) for kind in ("no_top_evidence_model", "text")]
    checks = spark.createDataFrame([(10 * t + i, *rest) for i, (t, *rest) in enumerate(rows)], "trap_id long, check_no int, kind string, clause_nos array<string>")
    checks = checks.withColumns({x: none for x in ("equals", "contains", "field", "severity")} | {"not_contains": F.lit("9"), "model": F.lit("m"), "value": F.lit(1.0), "any_of": F.array(none), "all_of": F.array(none)})
    said = spark.createDataFrame([("there", "MEET", "", "", "r")], "clause_no string, ai_verdict string, evidence_state string, our_value string, rationale string")
    said = said.withColumn("side_effects", F.array().cast("array<struct<field:string,value:double>>"))
    found = spark.createDataFrame([], "clause_no string, rank int, content string, model_tags array<string>")
    issues = spark.createDataFrame([], "clause_nos array<string>, severity string, description string")
    got = {r["trap_id"]: r["passed"] for r in evaluation.traps(evaluation.trap_checks(checks, said, found, issues)).collect()}
    assert got == {10: True, 11: True, 22: False, 23: False}


@pytest.mark.parametrize("replace", [False, True])
def test_numbers_stay_unique_inside_a_batch(spark, replace):
    old = spark.createDataFrame([(1, "A"), (2, "")], "document_id long, doc_no string")
    new = spark.createDataFrame([(5, "A"), (6, "B"), (7, "B"), (8, ""), (9, ""), (10, "B"), (11, None)], "document_id long, doc_no string")
    loaded, rejected = io.admit_numbers(old, new, replace)
    now = {r["document_id"] for r in loaded.collect()}
    assert now == ({2, 5, 10, 8, 9, 11} if replace else {1, 2, 6, 8, 9, 11})
    assert {r["document_id"] for r in rejected.collect()} == (set() if replace else {5, 7, 10})


def test_an_ill_typed_field_costs_only_itself(spark):
    said = [
        {"requirements": [{"clause_no": 1.1, "item": "a", "source_page": 3, "requirement_text": True, "context_text": 0, "chapter": ["x"], "category": {"a": 1}}, "text", None], "warnings": "one text", "bid_info": "none", "participation_reqs": [{"seq": 3, "text": "{t}"}]},
        {"warnings": ["w", 3, None, ["x"]], "requirements": "none", "bid_info": {"title": 5, "org": "o", "bid_no": ["x"]}},
    ]
    rows = spark.createDataFrame([(1, i, "announcement", json.dumps(r)) for i, r in enumerate(said)] + [(1, 8, "announcement", "[1]"), (1, 9, "announcement", None)], "project_id long, document_id long, doc_type string, response string")
    parsed, bad = requirements.parse_responses(rows)
    assert {r["document_id"] for r in bad.collect()} == {8, 9}
    (r,) = requirements.requirement_rows(parsed).collect()
    assert (r["clause_no"], r["item"], r["source_page"], r["requirement_text"], r["context_text"], r["chapter"], r["category"]) == ("1.1", "a", 3, "true", "", "", "other")
    assert [(r["seq"], r["text"]) for r in requirements.save_participation(parsed).collect()] == [("3", "{t}")]
    docs = rows.select("project_id", "document_id", F.lit("f").alias("original_name"))
    assert sorted(r["message"] for r in requirements.document_warnings(docs, docs, parsed).collect()) == ["f: 3", "f: w"]
    plan = requirements.requirement_rows(parsed)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("parseJson") == 1


def test_numbering_in_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice([None, 1, 1, 1, 2]), r.randint(0, 40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, a long, b long")
    whole = evaluation.numbered(df, [], ["a", "b"]).collect()
    assert [x["b"] for x in sorted(whole, key=lambda x: x["no"])] == [b for _, _, b in sorted(rows, key=lambda x: x[1:])]
    for g in (None, 1, 2):
        mine = sorted((x for x in evaluation.numbered(df, ["g"], [F.desc("a"), "b"]).collect() if x["g"] == g), key=lambda x: x["no"])
        assert [x["no"] for x in mine] == list(range(1, len(mine) + 1)) and [x["b"] for x in mine] == [b for _, a, b in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))]
    assert evaluation.numbered(df.limit(0), [], ["a"]).count() == 0


def chunk_rows(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, is_parent boolean, content string")
    return df.withColumns({"section_path": F.lit("p"), "keywords": F.array(F.lit("IP65")), "model_tags": F.array(F.lit("LT-101"))})


def files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if "bucket=" in d}


def test_an_update_touches_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(d * 10 + i, d, i == 0, f"text {d} {i}") for d in range(40) for i in range(3)]
    docs = lambda ids: spark.createDataFrame([(i,) for i in ids], "document_id long")
    index.update_index(spark, path, docs(range(41)), chunk_rows(spark, rows), "m1", buckets=16)
    before = files(tmp_path / "index")
    index.update_index(spark, path, docs([3, 5]), chunk_rows(spark, [(31, 3, False, "new text"), (999, 7, False, "not asked for")]), "m2")
    after = files(tmp_path / "index")
    bucket = lambda p: p.split("bucket=")[1].split("/")[0]
    changed = {bucket(p) for p in before.keys() ^ after.keys()} | {bucket(p) for p in before.keys() & after.keys() if before[p] != after[p]}
    want = {str(r["b"]) for r in docs([3, 5]).select(F.pmod(F.xxhash64("document_id"), F.lit(16)).alias("b")).collect()}
    assert changed == want
    now = index.open_index(spark, path)
    got = sorted((r["document_id"], r["chunk_id"], r["content"]) for r in now.chunks.collect())
    assert got == sorted([(d, c, t) for c, d, _, t in rows if d != 3] + [(3, 31, "new text")])
    status = {r["document_id"]: (r["status"], r["chunk_count"], r["embedding_model"]) for r in now.status.collect()}
    assert (status[3], status[5], status[7], status[40]) == (("indexed", 1, "m2"), ("failed", 3, "m1"), ("indexed", 3, "m1"), ("failed", 0, ""))
    assert {r["chunk_id"] for r in now.texts.collect()} == {c for c, d, p, _ in rows if not p and d != 3} | {31} == {r["chunk_id"] for r in now.postings.collect()}
    again = files(tmp_path / "index")
    index.update_index(spark, path, docs([3]), chunk_rows(spark, [(31, 3, False, "new text")]), "m2")
    assert sorted((r["document_id"], r["chunk_id"], r["content"]) for r in index.open_index(spark, path).chunks.collect()) == got and again


def test_an_update_that_died_is_run_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(i,) for i in range(6)], "document_id long")
    rows = chunk_rows(spark, [(i, i % 6, False, f"text {i}") for i in range(18)])
    replaced, put = [], index._replace
    monkeypatch.setattr(index, "_replace", lambda rows, path, name, sort: (_ for _ in ()).throw(OSError) if name == "status" and len(replaced) == 3 else (replaced.append(name), put(rows, path, name, sort)))
    with pytest.raises(OSError):
        index.update_index(spark, path, docs, rows, "m1", buckets=4)
    assert replaced == ["chunks", "texts", "postings"]
    index.update_index(spark, path, docs, rows, "m1")
    now = index.open_index(spark, path)
    assert now.chunks.count() == 18 == now.texts.count() and {(r["status"], r["chunk_count"]) for r in now.status.collect()} == {("indexed", 3)}


def test_deliverables_with_nested_values_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b|c"], {"k": 1}, "one\r\ntwo\nthree"), (2, None, None, None)], "n long, refs array<string>, m map<string,int>, t string").coalesce(1)
    io.write_table(df, str(tmp_path / "md"), "markdown")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines == ["| n | refs | m | t |", "|---|---|---|---|", '| 1 | ["a","b\\|c"] | {"k":1} | one<br>two<br>three |', "| 2 |  |  |  |"]
    io.write_table(df, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape="\\").orderBy("n").collect()
    assert json.loads(back[0]["refs"]) == ["a", "b|c"] and back[1]["refs"] is None
