"""Repair of verdicts and choice of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts, evidence states that rule out a verdict, and the notes put before a rationale.
VERDICTS = ("MEET", "GAP", "CHECK")
ABSENT_STATES = ("not_found", "found_absent")
REPAIR_NOTE = "[자동 보정] 근거가 없어 확인 필요로 조정함. "
FAILED_NOTE = "판정 실패: "
# End of fixed values.
MAX_FAILED = 0.3


def repair(assessments: DataFrame, hit_counts: DataFrame) -> DataFrame:
    """The rules in order: unknown verdict, no hits, no citation, contradicting state, confidence outside [0, 1]; then freezes ai_verdict and ai_our_value.

    ``hit_counts``: run_id, requirement_id, hits."""
    rows = assessments.join(hit_counts, ["run_id", "requirement_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rows = rows.withColumn("verdict", F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("CHECK"))
    bare = (F.col("verdict") == "MEET") & (F.col("hits") == 0)
    rows = rows.withColumns({"evidence_state": F.when(bare, "not_found").otherwise(F.col("evidence_state")), "rationale": F.when(bare, F.concat(F.lit(REPAIR_NOTE), F.coalesce("rationale", F.lit("")))).otherwise(F.col("rationale")), "verdict": F.when(bare, "CHECK").otherwise(F.col("verdict"))})
    uncited = (F.col("verdict") == "MEET") & (F.coalesce(F.size("cited_ranks"), F.lit(0)) <= 0)
    rows = rows.withColumn("verdict", F.when(uncited | F.coalesce(F.col("evidence_state").isin(*ABSENT_STATES), F.lit(False)), "CHECK").otherwise(F.col("verdict")))
    rows = rows.withColumn("confidence", F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")))
    return rows.withColumns({"ai_verdict": F.col("verdict"), "ai_our_value": F.col("our_value")})


def cited_evidence(assessments: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose rank is cited; the first one where a verdict other than CHECK cites none."""
    a = assessments.select("run_id", "requirement_id", "verdict", F.coalesce("cited_ranks", F.array().cast("array<int>")).alias("cited_ranks"))
    cited: Column = F.array_contains("cited_ranks", F.col("rank").cast("int"))
    first = (F.col("verdict") != "CHECK") & (F.size("cited_ranks") == 0) & (F.col("rank") == 1)
    return hits.join(a, ["run_id", "requirement_id"]).filter(cited | first).drop("verdict", "cited_ranks")


def fail_items(assessments: DataFrame) -> DataFrame:
    """Items whose call failed (column error) become CHECK with the reason."""
    failed = F.col("error").isNotNull()
    return assessments.withColumns({"verdict": F.when(failed, "CHECK").otherwise(F.col("verdict")), "rationale": F.when(failed, F.concat(F.lit(FAILED_NOTE), F.col("error"))).otherwise(F.col("rationale"))})


def run_status(assessments: DataFrame) -> DataFrame:
    """run_id, failed_share, status: a run fails when over 30 % of its items failed."""
    return assessments.groupBy("run_id").agg(F.avg(F.col("error").isNotNull().cast("double")).alias("failed_share")).withColumn("status", F.when(F.col("failed_share") > MAX_FAILED, "failed").otherwise("done"))


def meet_without_evidence(assessments: DataFrame, evidences: DataFrame) -> DataFrame:
    """MEET rows without evidence; must be empty."""
    return assessments.filter("verdict = 'MEET'").join(evidences, ["run_id", "requirement_id"], "left_anti")


def scoped_counts(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Delivery records counted per sector (last part of their path); only the asked sector is held against the minimum.

    ``records``: section_path; ``wanted``: requirement_id, sector, minimum."""
    sector = F.element_at(F.split("section_path", " > "), -1)
    counts = records.groupBy(sector.alias("sector")).agg(F.count("*").alias("n"))
    rows = wanted.join(counts, "sector", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("verdict", F.when(F.col("n") >= F.col("minimum"), "MEET").otherwise("GAP"))
