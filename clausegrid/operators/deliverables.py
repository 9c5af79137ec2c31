"""Tables handed over: compliance matrix, issue block, checklists, inquiries, run conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .conflicts import FIELD_LABELS
from .evaluation import label, severity_rank
from .retrieval import Settings, TrigramIndex, search

# Documents that no knowledge base holds.
NEEDED_DOCUMENTS = ("입찰참가신청서", "사업자등록증", "기술규격 대응표")
# End of fixed values.


def effects_text(side_effects: Column) -> Column:
    """Side effects as words: label, sign, number, unit."""
    names = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    one = lambda e: F.concat(F.coalesce(F.try_element_at(names, e["field"]), e["field"]), F.lit(" "), F.when((e["op"] == "add") & (e["value"] >= 0), "+").when(e["op"] == "multiply", "×").otherwise(""), T.short_number(e["value"]), F.coalesce(e["unit"], F.lit("")))
    return F.array_join(F.transform(side_effects, one), ", ")


def compliance_matrix(requirements: DataFrame, assessments: DataFrame, evidences: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per active requirement in clause order; '-' for what is missing; evidence of the best rank; issues in the notes."""
    first = evidences.groupBy("run_id", "requirement_id").agg(F.min_by(F.struct("doc_title", "doc_no", "location"), "rank").alias("e"))
    notes = numbered_issues(issues).select("run_id", F.explode("clause_nos").alias("clause_no"), F.concat(F.lit("이슈 "), F.col("no").cast("string")).alias("note"))
    notes = notes.groupBy("run_id", "clause_no").agg(F.array_join(F.array_sort(F.collect_set("note")), ", ").alias("issue_note"))
    rows = assessments.join(requirements.filter("is_active"), "requirement_id").join(first, ["run_id", "requirement_id"], "left").join(notes, ["run_id", "clause_no"], "left")
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    effects = F.coalesce(effects_text(F.col("side_effects")), F.lit(""))
    remedy = F.when(F.col("verdict") == "MEET", "").otherwise(F.concat(F.coalesce("remedy", F.lit("")), F.when(effects != "", F.concat(F.lit(" ("), effects, F.lit(")"))).otherwise("")))
    edited = F.when(F.col("is_edited"), "수정됨")
    document = F.when(F.col("e.doc_no") != "", F.concat("e.doc_title", F.lit(" ("), F.col("e.doc_no"), F.lit(")"))).otherwise(F.col("e.doc_title"))
    out = rows.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy(T.clause_key(F.col("clause_no")), "item")).alias("no"), "clause_no", "chapter", label(F.col("category"), "category").alias("category"), "item", "requirement_text", dash(F.col("our_value")).alias("our_value"), label(F.col("verdict"), "verdict").alias("verdict"), F.coalesce(F.nullif("gap_detail", F.lit("")), "rationale", F.lit("")).alias("reason"), remedy.alias("remedy"), dash(document).alias("evidence_document"), dash(F.col("e.location")).alias("evidence_location"), F.concat_ws(", ", edited, "issue_note").alias("notes"))
    return out


def numbered_issues(issues: DataFrame) -> DataFrame:
    """Undismissed issues with no, by severity."""
    order = Window.partitionBy("run_id").orderBy(severity_rank(F.col("severity")), "clause_nos", "title")
    return issues.filter("NOT is_dismissed").withColumn("no", F.row_number().over(order))


def issue_block(issues: DataFrame) -> DataFrame:
    """run_id, no, line: the block under the matrix."""
    text = F.format_string("[%d] 조항 %s — %s\n    %s", "no", F.array_join("clause_nos", ", "), "title", "description")
    return numbered_issues(issues).select("run_id", "no", text.alias("line"))


def needed(name: Column) -> Column:
    """Documents that no knowledge base holds: they are made or issued for the tender."""
    fixed = F.lit(False)
    for x in NEEDED_DOCUMENTS:
        fixed = fixed | name.contains(x)
    return fixed


def search_each(rows: DataFrame, text: str, chunks: DataFrame, s: Settings = Settings(), index: TrigramIndex | None = None) -> DataFrame:
    """project_id, seq, rank, quote: one search for each submission item or eligibility clause (project_id, seq and the
    column ``text``). Rows with the same text share one search; documents that no knowledge base holds ask nothing."""
    asked = rows.filter(~F.coalesce(needed(F.col(text)), F.lit(True))).select("project_id", "seq", F.col(text).alias("_text")).withColumn("query_id", F.xxhash64("_text"))
    queries = asked.select("query_id", F.col("_text").alias("text")).distinct()
    queries = queries.withColumns({"probes": F.array("text"), "model_filter": F.lit(None).cast("string")})
    hits = search(queries, chunks, None, s, index=index).select("query_id", "rank", F.col("content").alias("quote"))
    return asked.join(hits, "query_id").select("project_id", "seq", "rank", "quote")


def submission_checklist(items: DataFrame, hits: DataFrame, assessments: DataFrame) -> DataFrame:
    """Status of each document: need for those no knowledge base holds, uncertain without hits or where a named chapter has an open clause, else have.

    ``items``: project_id, run_id, seq, name, note; ``hits``: query_id = seq, project_id, rank, quote; ``assessments``: run_id, clause_no, verdict."""
    fixed = needed(F.col("name"))
    chapters = assessments.groupBy("run_id", F.regexp_extract("clause_no", r"^(\d+)", 1).alias("chapter")).agg(F.bool_or(F.col("verdict") == "CHECK").alias("open"), F.bool_or(F.col("verdict") == "GAP").alias("short"))
    top = hits.groupBy("project_id", "seq").agg(F.min_by("quote", "rank").alias("evidence_text"))
    rows = items.withColumn("chapter", F.regexp_extract(F.coalesce("note", F.lit("")), r"제(\d+)장", 1)).join(chapters, ["run_id", "chapter"], "left").join(top, ["project_id", "seq"], "left")
    status = F.when(fixed, "need").when(F.col("evidence_text").isNull() | F.coalesce(F.col("open") | F.col("short"), F.lit(False)), "uncertain").otherwise("have")
    return rows.select("project_id", "run_id", "seq", "name", "note", status.alias("status"), label(status, "submission_status").alias("status_label"), F.when(~fixed, F.col("evidence_text")).alias("evidence_text"))


def eligibility_checklist(clauses: DataFrame, hits: DataFrame) -> DataFrame:
    """Status of each eligibility clause: have with evidence, else uncertain; nothing is guessed.

    ``clauses``: project_id, seq, text; ``hits``: project_id, seq, rank, quote."""
    top = hits.groupBy("project_id", "seq").agg(F.min_by("quote", "rank").alias("evidence_text"))
    status = F.when(F.col("evidence_text").isNotNull(), "have").otherwise("uncertain")
    return clauses.join(top, ["project_id", "seq"], "left").select("project_id", "seq", "text", status.alias("status"), label(status, "submission_status").alias("status_label"), "evidence_text")


def schedule(projects: DataFrame, as_of: Column) -> DataFrame:
    """project_id, event, due, left: D-n until a date, closed after it."""
    events = F.array(*[F.struct(F.lit(n).alias("event"), F.col(n).cast("timestamp").alias("due")) for n in ("inquiry_due_at", "bid_due_at", "opening_at")])
    rows = projects.select("project_id", F.explode(events).alias("x")).select("project_id", "x.event", "x.due").filter("due IS NOT NULL")
    n = F.datediff(F.to_date("due"), as_of)
    return rows.withColumn("left", F.when(n < 0, "마감").otherwise(F.concat(F.lit("D-"), n.cast("string"))))


def inquiries(assessments: DataFrame, issues: DataFrame) -> DataFrame:
    """Inquiry candidates numbered: open clauses, then conflicts, then remedies.

    What shares clauses is one inquiry: an open clause of a conflict joins the first conflict that names it, which then
    stands among the open clauses with both texts; a remedy of a clause in conflict is left to the conflict."""
    live = issues.filter("NOT is_dismissed").select("run_id", "clause_nos", "title", "description")
    named = live.select("run_id", "clause_nos", "title", F.explode("clause_nos").alias("clause_no"))
    checks = assessments.filter("verdict = 'CHECK'").select("run_id", "clause_no", F.coalesce("rationale", F.lit("")).alias("body"))
    joined = checks.join(named, ["run_id", "clause_no"]).groupBy("run_id", "clause_no").agg(F.min(F.struct("clause_nos", "title")).alias("issue"), F.first("body").alias("body"))
    added = joined.groupBy("run_id", "issue.clause_nos", "issue.title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_no", "body"))), lambda x: x["body"]), "\n").alias("open"))
    crossed = live.join(added, ["run_id", "clause_nos", "title"], "left")
    crossed = crossed.select("run_id", F.col("clause_nos").alias("clause_refs"), F.lit("cross_clause").alias("source_kind"), F.when(F.col("open").isNull(), 1).otherwise(0).alias("tier"), F.concat_ws("\n", "open", "description").alias("body"))
    one = lambda df, kind, tier, body: df.join(named.select("run_id", "clause_no").distinct(), ["run_id", "clause_no"], "left_anti").select("run_id", F.array("clause_no").alias("clause_refs"), F.lit(kind).alias("source_kind"), F.lit(tier).alias("tier"), F.col(body).alias("body"))
    gaps = assessments.filter("verdict = 'GAP' AND coalesce(remedy, '') <> ''")
    every = one(checks, "check", 0, "body").unionByName(crossed).unionByName(one(gaps, "gap_remedy", 2, "remedy"))
    order = Window.partitionBy("run_id").orderBy("tier", T.clause_key(F.get("clause_refs", F.lit(0))), "body")
    return every.withColumn("seq", F.row_number().over(order)).select("run_id", "seq", "clause_refs", "source_kind", "body")


def prompt_version(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def run_conditions(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """run_id, model, name, value: parameters and prompt versions of each run."""
    params = runs.select("run_id", "model", F.explode("rag_params").alias("name", "v")).select("run_id", "model", "name", F.col("v").cast("string").alias("value"))
    versions = runs.select("run_id", "model").join(prompts.select("run_id", "name", prompt_version(F.col("text")).alias("value")), "run_id")
    return params.unionByName(versions.select("run_id", "model", "name", "value"))
