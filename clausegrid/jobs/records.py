"""Registered queries of single steps on requirements, verdicts, runs and deliverables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conflicts, deliverables, evaluation, requirements, verdicts
from . import derived as D
from .queries import CATEGORY_SQL, RESPONSES, RUN_GRADES, _run_grades, table
from .registry import query


def _requirements(spark, sf):
    parsed, _ = requirements.parse_responses(D.event_responses(spark, sf))
    return parsed, requirements.requirement_rows(parsed)


@query("submission_warnings", "SELECT user_id // 3 AS project_id, CASE x WHEN 0 THEN event_type ELSE 'y' END AS name, 'seq' AS kind FROM events, range(2) r(x) WHERE event_id % 2 = 0 AND event_id % 97 <> 0 AND (x = 1 OR CAST(json_extract(props, '$.k') AS INTEGER) % 3 = 0)")
def submission_warnings(spark, sf):
    """Items whose number is a text."""
    return requirements.save_submissions(_requirements(spark, sf)[0])[1]


@query("existing_requirements", RESPONSES + "SELECT project_id, clause_no, item FROM u WHERE project_id % 3 > 0")
def existing_requirements(spark, sf):
    """What every third project already has stays and wins: only the others' rows are new."""
    rows = _requirements(spark, sf)[1]
    return requirements.save_requirements(rows, rows.filter("project_id % 3 = 0"))[0].select("project_id", "clause_no", "item")


@query("replaced_requirements", RESPONSES + """
SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM u WHERE project_id % 2 = 0 OR doc_order = 0 GROUP BY 1, 2""")
def replaced_requirements(spark, sf):
    """Every second project is extracted anew and replaces its rows; the others keep the announcement's."""
    parsed, rows = _requirements(spark, sf)
    old = requirements.save_requirements(rows.filter("doc_order = 0"))[0].withColumn("version", F.lit("old"))
    anew = rows.filter("project_id % 2 = 0")
    made = requirements.save_requirements(anew)[0].withColumn("version", F.lit("new"))
    stored = requirements.after_extraction(old, made, parsed.filter("project_id % 2 = 0"), replace=True)
    return stored.groupBy("project_id", "version").agg(F.count("*").alias("n"))


@query("project_summary", RESPONSES + """
, s AS (SELECT DISTINCT project_id, k FROM e WHERE document_id % 2 = 0 AND k % 3 > 0), p AS (SELECT DISTINCT project_id, k % 7 AS seq FROM e WHERE document_id % 2 = 0)
SELECT c_custkey AS project_id, (SELECT count(*) FROM u WHERE u.project_id = c_custkey) AS requirements, (SELECT count(*) FROM s WHERE s.project_id = c_custkey) AS submissions,
  (SELECT count(*) FROM p WHERE p.project_id = c_custkey) AS participations, (SELECT count(*) FROM u WHERE u.project_id = c_custkey) = 0 AS nothing_extracted FROM customer""")
def project_summary(spark, sf):
    parsed, rows = _requirements(spark, sf)
    return requirements.project_summary(D.customer_projects(spark, sf), requirements.save_requirements(rows)[0], requirements.save_submissions(parsed)[0], requirements.save_participation(parsed))


@query("filtered_requirements", RESPONSES + f"SELECT project_id, clause_no, item FROM u WHERE {CATEGORY_SQL} = 'delivery'")
def filtered_requirements(spark, sf):
    made = requirements.save_requirements(_requirements(spark, sf)[1])[0]
    return requirements.filtered(made, category="delivery", is_active=True, is_graded=None).select("project_id", "clause_no", "item")


@query("unmatched_key", "SELECT s_suppkey % 9 || '.' || s_suppkey AS clause_no FROM supplier WHERE s_suppkey % 3 = 1")
def unmatched_key(spark, sf):
    """Clauses of the key that no requirement has."""
    r = table(spark, sf, "supplier").withColumn("clause_no", F.concat(D.s(F.col("s_suppkey") % 9), F.lit("."), D.s("s_suppkey")))
    return requirements.mark_graded(r.filter("s_suppkey % 3 <> 1").select("clause_no"), r.select("clause_no"))[1]


@query("failed_items", """
SELECT doc_id // 50 AS run_id, doc_id AS requirement_id, CASE WHEN doc_id % 19 = 0 THEN 'CHECK' WHEN doc_id % 17 = 0 THEN 'MAYBE' WHEN quality = 1 THEN 'MEET' ELSE 'GAP' END AS verdict, CASE WHEN doc_id % 19 = 0 THEN '판정 실패: timeout' ELSE 'why' END AS rationale FROM labels""")
def failed_items(spark, sf):
    return verdicts.fail_items(D.label_assessments(spark, sf)).select("run_id", "requirement_id", "verdict", "rationale")


@query("run_history", f"""
WITH r AS (SELECT o_orderkey AS run_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 100 * 1000 END AS duration_ms FROM orders),
s AS (SELECT doc_id // 50 AS run_id, count(*) FILTER (quality = 1 AND doc_id % 17 <> 0) AS meets, count(*) AS total FROM labels GROUP BY 1),
g AS (WITH y AS ({RUN_GRADES} SELECT * FROM x) SELECT run_id, count(*) FILTER (is_match)::DOUBLE / count(*) AS accuracy FROM y GROUP BY 1)
SELECT run_id, created_at, CAST(duration_ms AS BIGINT) AS duration_ms, meets, total, accuracy FROM r LEFT JOIN s USING (run_id) LEFT JOIN g USING (run_id)""")
def run_history(spark, sf):
    """All runs, newest first; those with verdicts have counts and an accuracy."""
    later = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 100 * 1000)
    started = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), started.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), later.alias("updated_at"))
    rows = D.label_assessments(spark, sf).withColumns({"is_active": F.lit(True), "is_graded": F.lit(False)})
    scores = evaluation.accuracy(_run_grades(spark, sf))
    return evaluation.run_history(runs, evaluation.run_summary(rows), scores).select("run_id", "created_at", "duration_ms", F.col("MEET").alias("meets"), "total", "accuracy")


@query("issue_order", """
SELECT p_partkey AS run_id, CAST(row_number() OVER (ORDER BY CASE WHEN 45 + p_size % 4 * 7 > 60 THEN 'high' ELSE 'medium' END, p_partkey) AS INTEGER) AS no, CASE WHEN 45 + p_size % 4 * 7 > 60 THEN 'high' ELSE 'medium' END AS severity FROM part""")
def issue_order(spark, sf):
    """All runs' issues in the order of a report, numbered through."""
    terms = table(spark, sf, "part").select(F.col("p_partkey").alias("run_id"), F.lit("45일").alias("base_text"), F.lit("60일 이내").alias("limit_text"))
    issues = conflicts.lead_time_issues(D.part_assessments(spark, sf), terms).withColumn("clause_nos", F.array(F.lpad(D.s("run_id"), 9, "0")))
    return evaluation.numbered(issues, [], [evaluation.severity_rank(F.col("severity")), "clause_nos"]).select("run_id", "no", "severity")


TRAPS = """
WITH a AS (SELECT p_partkey AS k, p_partkey // 5 AS trap_id, p_partkey % 5 AS kind, p_size FROM part),
r AS (SELECT trap_id, CASE kind WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size <> 7 WHEN 2 THEN p_size % 4 > 0 WHEN 3 THEN p_size % 3 = 0 ELSE p_size % 6 > 0 END AS passed FROM a)
"""


@query("trap_results", TRAPS + "SELECT trap_id, bool_and(passed) AS passed FROM r GROUP BY 1")
def trap_results(spark, sf):
    """A clause and one check for each part, five checks for each trap."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part").withColumn("clause_no", F.concat(F.lit("1."), D.s(k)))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("verdict", "our_value", "no_top_evidence_model", "side_effect", "cross_issue")]), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    checks = p.select(F.floor(k / 5).alias("trap_id"), (k % 5).alias("check_no"), kind.alias("kind"), F.when(k % 5 == 4, F.array("clause_no", F.lit("9.9"))).otherwise(F.array("clause_no")).alias("clause_nos"), F.lit("MEET").alias("equals"), F.when(k % 5 == 1, D.s(size * 1000)).when(k % 5 == 4, "kg").alias("contains"), F.when(k % 5 == 1, "=7,000").alias("not_contains"), F.array(none).alias("any_of"), F.array(none).alias("all_of"), F.lit("weight").alias("field"), F.lit(1.5).alias("value"), F.lit("LT-200").alias("model"), F.lit("high").alias("severity"))
    effect = F.array(F.struct(F.lit("weight").alias("field"), F.when(size % 3 == 0, 1.5).otherwise(2.5).alias("value")))
    answers = p.select("clause_no", F.when(size % 2 == 0, "MEET").otherwise("GAP").alias("ai_verdict"), F.lit("").alias("evidence_state"), F.concat(F.lit("="), F.format_number(size * 1000, 0), F.lit(" lm")).alias("our_value"), F.lit("r").alias("rationale"), effect.alias("side_effects"))
    found = p.select("clause_no", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"), F.lit("c").alias("content"), size.alias("s")).withColumn("model_tags", F.array(F.when((F.col("rank") == 1) == (F.col("s") % 4 == 0), "LT-200").otherwise("LT-150")))
    issues = p.filter("p_size % 6 > 0").select(F.array(F.lit("9.9"), "clause_no").alias("clause_nos"), F.lit("high").alias("severity"), F.lit("8 kg over").alias("description"))
    return evaluation.traps(evaluation.trap_checks(checks, answers, found, issues))


@query("run_traps", """
WITH a AS (SELECT p_partkey AS k, p_partkey // 9 AS trap_id, p_partkey % 9 AS kind, p_size, r FROM part, range(1, 3) t(r)),
c AS (SELECT *, p_size % (r + 1) = 0 AS good, p_size % 5 <> 0 AS there FROM a),
x AS (SELECT r AS run_id, trap_id, there AND CASE kind WHEN 5 THEN good OR r = 2 WHEN 6 THEN good OR r = 1 WHEN 8 THEN true ELSE good END AS passed FROM c)
SELECT run_id, trap_id, bool_and(passed) AS passed FROM x GROUP BY 1, 2""")
def run_traps(spark, sf):
    """Every kind of check in traps of nine, over two runs that answer differently; a fifth of the clauses has no answer."""
    k, size, run = F.col("p_partkey"), F.col("p_size"), F.col("run_id")
    p = table(spark, sf, "part").withColumn("clause_no", F.concat(F.lit("1."), D.s(k)))
    names = ("verdict", "evidence_state", "our_value", "text", "text_any", "no_top_evidence_model", "cross_issue", "side_effect", "evidence_contains")
    kind = F.element_at(F.array(*[F.lit(x) for x in names]), (k % 9 + 1).cast("int"))
    wanted = F.when(k % 9 == 2, "1000").when(k % 9 == 3, "reason").when(k % 9 == 6, "kg")
    equals = F.when(k % 9 == 1, "found_sufficient").otherwise("MEET")
    clauses = F.when(k % 9 == 6, F.array("clause_no", F.lit("9.9"))).otherwise(F.array("clause_no"))
    texts = lambda *x: F.array(*[F.lit(y) for y in x])
    checks = p.select(F.floor(k / 9).alias("trap_id"), (k % 9).alias("check_no"), kind.alias("kind"), clauses.alias("clause_nos"), equals.alias("equals"), wanted.alias("contains"), F.lit("2,000").alias("not_contains"), texts("no such", "1,000").alias("any_of"), texts("first", "second").alias("all_of"), F.when(k % 9 == 7, "weight").when(k % 9 == 3, "rationale").alias("field"), F.lit(1.5).alias("value"), F.lit("LT-200").alias("model"), F.lit("high").alias("severity"))
    runs = p.filter("p_size % 5 <> 0").withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("good", size % (run + 1) == 0)
    pick = lambda a, b: F.when(F.col("good"), a).otherwise(b)
    effect = F.array(F.struct(F.lit("weight").alias("field"), pick(F.lit(1.5), F.lit(2.5)).alias("value")))
    answers = runs.select("run_id", "clause_no", pick(F.lit("MEET"), F.lit("GAP")).alias("ai_verdict"), pick(F.lit("found_sufficient"), F.lit("not_found")).alias("evidence_state"), pick(F.lit("1,000 lm"), F.lit("2,000 lm")).alias("our_value"), pick(F.lit("a reason"), F.lit("none")).alias("rationale"), effect.alias("side_effects"))
    found = runs.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(2)))).select("run_id", "clause_no", "rank", F.when(F.col("rank") == 1, "the first").otherwise("the second").alias("content"), F.array(F.when(F.col("good") | (run == 2), "LT-150").otherwise("LT-200")).alias("model_tags"))
    issues = runs.filter(F.col("good") | (run == 1)).select("run_id", F.array(F.lit("9.9"), "clause_no").alias("clause_nos"), F.lit("high").alias("severity"), F.lit("8 kg over").alias("description"))
    return evaluation.traps(evaluation.trap_checks(checks, answers, found, issues, answers))


@query("eligibility_checklist", """
SELECT s_suppkey % 7 AS project_id, CAST(s_suppkey AS VARCHAR) AS seq, s_name AS text, CASE WHEN s_suppkey % 3 = 0 THEN 'uncertain' ELSE 'have' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN '확인 필요' ELSE '보유' END AS status_label,
  CASE WHEN s_suppkey % 3 > 0 THEN s_name || ' 1' END AS evidence_text FROM supplier""")
def eligibility_checklist(spark, sf):
    k = F.col("s_suppkey")
    clauses = table(spark, sf, "supplier").select((k % 7).alias("project_id"), D.s(k).alias("seq"), F.col("s_name").alias("text"))
    hits = table(spark, sf, "supplier").filter(k % 3 > 0).select((k % 7).alias("project_id"), D.s(k).alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"), "s_name").withColumn("quote", F.concat_ws(" ", "s_name", D.s("rank")))
    return deliverables.eligibility_checklist(clauses, hits)


@query("run_conditions", """
SELECT doc_id // 50 AS run_id, 'm-' || (doc_id // 50) AS model, 'p' || doc_id AS name, 'sha1:' || substr(sha1(text), 1, 12) AS value FROM documents
UNION ALL SELECT r.range, 'm-' || r.range, n, CASE n WHEN 'top_k' THEN '5.0' ELSE '0.' || (r.range % 9 + 1) END FROM (SELECT DISTINCT doc_id // 50 AS range FROM documents) r, (VALUES ('top_k'), ('threshold')) v(n)""")
def run_conditions(spark, sf):
    prompts = table(spark, sf, "documents").select(F.expr("doc_id div 50").alias("run_id"), F.concat(F.lit("p"), D.s("doc_id")).alias("name"), "text")
    k = F.col("run_id")
    params = F.create_map(F.lit("top_k"), F.lit(5.0), F.lit("threshold"), (k % 9 + 1) / 10)
    return deliverables.run_conditions(prompts.select("run_id").distinct().select(k, F.concat(F.lit("m-"), D.s(k)).alias("model"), params.alias("rag_params")), prompts)


@query("inquiry_texts", """
WITH i AS (SELECT p_partkey, p_size, p_size % 10 <> 0 AND p_size + p_size % 5 > p_size % 7 + 20 AS clash FROM part)
SELECT p_partkey AS run_id, 1 AS seq, CASE WHEN p_size % 3 = 0 THEN 'r' || CASE WHEN clash THEN chr(10) ELSE '' END ELSE '' END
  || CASE WHEN clash THEN p_size || ' + ' || (p_size % 5) || ' = ' || (p_size + p_size % 5) || ' kg / ' || (p_size % 7 + 20) || ' kg 이하' WHEN p_size % 3 > 0 THEN 'housing' ELSE '' END AS body FROM i""")
def inquiry_texts(spark, sf):
    """One inquiry for each run here: an open clause, a conflict, both together, or a remedy."""
    a = D.part_assessments(spark, sf)
    return deliverables.inquiries(a, conflicts.side_effect_issues(a)[0].withColumn("is_dismissed", F.lit(False))).select("run_id", "seq", "body")


