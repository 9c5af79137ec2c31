"""Summaries, accuracy against an answer key, traps and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

# Display labels of codes.
LABELS = {
    "verdict": {"MEET": "충족", "GAP": "보완 필요", "CHECK": "확인 필요"},
    "category": {"dimension": "제품 치수", "filter_grade": "등급", "efficiency": "효율", "pressure_drop": "차압", "test_standard": "시험규격", "certification": "인증", "delivery": "납기", "submission": "제출서류", "performance": "성능", "material": "재질·구조", "track_record": "실적", "other": "기타"},
    "severity": {"high": "높음", "medium": "보통", "low": "낮음"},
    "submission_status": {"have": "보유", "need": "발급 필요", "uncertain": "확인 필요"},
    "doc_type": {"announcement": "입찰공고문", "techspec": "기술사양서"},
}
# End of fixed values.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def label(c: Column, kind: str) -> Column:
    """A code's display label; an unknown code stays."""
    pairs = [F.lit(x) for kv in LABELS[kind].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def severity_rank(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), c)


def run_summary(assessments: DataFrame) -> DataFrame:
    """Verdict counts of active requirements per run."""
    each = [F.count_if(F.col("verdict") == v).alias(v) for v in ("MEET", "GAP", "CHECK")]
    return assessments.filter("is_active").groupBy("run_id").agg(*each, F.count("*").alias("total"), F.count_if("is_graded").alias("graded_total"))


def token_usage(runs: DataFrame) -> DataFrame:
    """run_id, calls, prompt and completion tokens; missing counts are 0."""
    add = lambda f: F.aggregate("llm_calls", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[f], F.lit(0)))
    return runs.select("run_id", F.coalesce(F.size("llm_calls"), F.lit(0)).alias("calls"), F.coalesce(add("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(add("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def elapsed_ms(started: Column, finished: Column, updated: Column) -> Column:
    return F.unix_millis(F.coalesce(finished, updated).cast("timestamp")) - F.unix_millis(started.cast("timestamp"))


def project_list(projects: DataFrame, documents: DataFrame, requirements: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts and the latest run of each project, and whether one is active."""
    count = lambda df, n: df.groupBy("project_id").agg(F.count("*").alias(n))
    last = runs.groupBy("project_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run"), F.max_by("status", F.struct("created_at", "run_id")).alias("latest_status"), F.bool_or(F.col("status").isin("queued", "running")).alias("has_active"))
    out = projects.join(count(documents, "document_count"), "project_id", "left").join(count(requirements, "requirement_count"), "project_id", "left").join(last, "project_id", "left")
    return out.fillna(0, ["document_count", "requirement_count"]).fillna(False, ["has_active"])


def requirement_counts(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("is_graded").alias("graded"))


#: Parts of a key or of a list of checks; each run meets each part by an equi-join.
GRID_PARTS = 16


def for_each_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Every row for every run (run_id): the grid in which a run's missing answers show."""
    part = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(GRID_PARTS)).cast("int")
    each = runs.select("run_id").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))))
    return rows.withColumn("_part", part).join(each, "_part").drop("_part")


def graded(key: DataFrame, assessments: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Key rows with the frozen verdict; a clause without one counts as wrong ("missing").

    Where assessments have runs and the key has none, every run is graded on the whole key. ``runs`` (run_id): those to be
    graded; without it, all that have an assessment."""
    if "run_id" in assessments.columns and "run_id" not in key.columns:
        key = for_each_run(key, assessments if runs is None else runs)
    on = ["run_id", "clause_no"] if "run_id" in key.columns else ["clause_no"]
    a = assessments.groupBy(*on).agg(F.min("ai_verdict").alias("actual"))
    return key.join(a, on, "left").withColumns({"is_match": F.coalesce(F.col("expected_verdict") == F.col("actual"), F.lit(False)), "actual": F.coalesce("actual", F.lit("missing"))})


def _run(rows: DataFrame) -> list[str]:
    return ["run_id"] if "run_id" in rows.columns else []


def accuracy(rows: DataFrame) -> DataFrame:
    """correct, total, ratio of graded rows; for each run where they have runs."""
    return rows.groupBy(*_run(rows)).agg(F.count_if("is_match").alias("correct"), F.count("*").alias("total")).withColumn("ratio", F.try_divide("correct", "total"))


def per_verdict(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_run(rows), "expected_verdict").agg(F.count("*").alias("expected"), F.count_if("is_match").alias("correct"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT is_match").groupBy(*_run(rows), "expected_verdict", "actual").agg(F.count("*").alias("n"))


def normal_value(c: Column) -> Column:
    """A value without commas and spaces."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[, ]", "")


def contains_any(value: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda x: normal_value(value).contains(normal_value(x)))


def contains_none(value: Column, banned: Column) -> Column:
    return ~contains_any(value, banned)


def trap_checks(checks: DataFrame, assessments: DataFrame, evidences: DataFrame, issues: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """trap_id, check_no, kind, passed; for each run (run_id) where assessments have runs. Evidences and issues
    without runs count for all of them. One branch for each kind, all on one clause row. A clause without an assessment
    passes no check but "cross_issue", which asks for an issue; one without evidence has no top evidence.

    ``checks``: trap_id, check_no, kind, clause_nos, equals, contains, not_contains, any_of, all_of, field, value, model, severity.
    ``assessments``: clause_no, ai_verdict, evidence_state, our_value, rationale, side_effects; ``evidences``: clause_no, rank, content, model_tags; ``issues``: clause_nos, severity, description."""
    run = _run(assessments)
    if run and "run_id" not in checks.columns:
        checks = for_each_run(checks, assessments if runs is None else runs)
    on, seen = [*run, "clause_no"], [*_run(evidences), "clause_no"]
    each = checks.select("*", F.explode("clause_nos").alias("clause_no"))
    first = evidences.groupBy(*seen).agg(F.min_by("model_tags", "rank").alias("top_models"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("evidence"))
    rows = each.join(assessments.withColumn("_answered", F.lit(True)), on, "left").join(first, seen, "left")
    has = lambda text, needle: needle.isNull() | F.coalesce(text.contains(needle), F.lit(False))
    both = lambda text: has(text, F.col("contains")) & ~F.coalesce(text.contains(F.col("not_contains")), F.lit(False))
    text = F.when(F.col("field") == "rationale", F.col("rationale")).when(F.col("field") == "our_value", F.col("our_value")).otherwise(F.concat_ws("\n", "rationale", "our_value"))
    value = normal_value(F.col("our_value"))
    kinds = {
        "verdict": F.col("ai_verdict") == F.col("equals"),
        "evidence_state": F.col("evidence_state") == F.col("equals"),
        "our_value": has(value, normal_value(F.col("contains"))) & (F.col("not_contains").isNull() | ~value.contains(normal_value(F.col("not_contains")))),
        "text": both(text),
        "text_any": F.exists("any_of", lambda x: text.contains(x)),
        "evidence_contains": F.forall("all_of", lambda x: F.coalesce(F.col("evidence").contains(x), F.lit(False))),
        "no_top_evidence_model": ~F.coalesce(F.array_contains("top_models", F.col("model")), F.lit(False)),
        "side_effect": F.exists("side_effects", lambda e: (e["field"] == F.col("field")) & (F.abs(e["value"] - F.col("value")) < 1e-9)),
    }
    passed = F.lit(None).cast("boolean")
    for kind, rule in kinds.items():
        passed = F.when(F.col("kind") == kind, F.coalesce(rule, F.lit(False))).otherwise(passed)
    passed = F.col("_answered").isNotNull() & passed
    plain = rows.filter("kind <> 'cross_issue'").groupBy(*run, "trap_id", "check_no", "kind").agg(F.coalesce(F.bool_and(passed), F.lit(False)).alias("passed"))
    i = issues.select(*_run(issues), F.array_sort("clause_nos").alias("pair"), F.col("severity").alias("i_severity"), "description")
    crossed = checks.filter("kind = 'cross_issue'").withColumn("pair", F.array_sort("clause_nos")).join(i, [*_run(issues), "pair"], "left")
    hit = F.coalesce((F.col("severity").isNull() | (F.col("severity") == F.col("i_severity"))) & has(F.col("description"), F.col("contains")) & F.col("description").isNotNull(), F.lit(False))
    return plain.unionByName(crossed.groupBy(*run, "trap_id", "check_no", "kind").agg(F.bool_or(hit).alias("passed")))


def traps(results: DataFrame) -> DataFrame:
    """A trap passes when all its checks pass, in each run where results have runs."""
    return results.groupBy(*_run(results), "trap_id").agg(F.bool_and("passed").alias("passed"))


def evidence_rate(assessments: DataFrame, evidences: DataFrame) -> DataFrame:
    """Share of MEET and GAP rows with evidence, and MEET rows without."""
    e = evidences.select("run_id", "requirement_id").distinct().withColumn("has", F.lit(1))
    rows = assessments.filter("verdict IN ('MEET', 'GAP')").join(e, ["run_id", "requirement_id"], "left")
    return rows.groupBy("run_id").agg(F.avg(F.coalesce("has", F.lit(0)).cast("double")).alias("evidence_rate"), F.count_if((F.col("verdict") == "MEET") & F.col("has").isNull()).alias("bare_meets"))


def inconsistent_pairs(assessments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clauses given twice (pairs: clause_a, clause_b) with different verdicts in a run."""
    a, b = (assessments.select("run_id", F.col("clause_no").alias(f"clause_{x}"), F.col("verdict").alias(f"verdict_{x}")) for x in "ab")
    return pairs.join(a, "clause_a").join(b, ["run_id", "clause_b"]).filter("verdict_a <> verdict_b")


def run_history(runs: DataFrame, summaries: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Runs with duration, verdict counts and, with ``scores`` (what ``accuracy`` gives by run), their accuracy; newest first."""
    out = runs.withColumn("duration_ms", elapsed_ms(F.col("started_at"), F.col("finished_at"), F.col("updated_at"))).join(summaries, "run_id", "left")
    if scores is not None:
        out = out.join(scores.select("run_id", "correct", F.col("total").alias("scored"), F.col("ratio").alias("accuracy")), "run_id", "left")
    return out.orderBy(F.desc("created_at"), F.desc("run_id"))


def ordered_issues(issues: DataFrame, as_text: bool = False) -> DataFrame:
    """Issues by severity, by rank or as text."""
    return issues.orderBy(F.col("severity") if as_text else severity_rank(F.col("severity")), "clause_nos")


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "no") -> DataFrame:
    """Adds 1..n in ``order``, in the whole table or within each value of the columns ``by``, however many rows one has.

    Rows are dealt to ranges of (by, order) and written; each range numbers its own rows behind the counts of those before
    it. ``order`` should leave no ties, else numbers among ties are arbitrary."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    if by:
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    else:  # one row: as many pairs as there are ranges
        all_sizes = sizes.agg(F.collect_list(F.struct("_part", "_n")).alias("s"))
        one = all_sizes.select("s", F.explode("s").alias("x"))
        before = F.aggregate("s", F.lit(0).cast("long"), lambda t, y: t + F.when(y["_part"] < F.col("x._part"), y["_n"]).otherwise(0))
        starts = one.select(F.col("x._part").alias("_part"), before.alias("_before"))
    starts = starts.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_part")})
    joined = ranged.join(starts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_part")]).select(*ranged.columns, "_before")
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return joined.withColumn(name, (place + F.col("_before")).cast("int")).drop("_part", "_before")
