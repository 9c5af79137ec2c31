"""Model responses into clean requirements, submission items, eligibility clauses and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluation import numbered

# Requirement categories, header fields and their lengths.
CATEGORIES = ("dimension", "filter_grade", "efficiency", "pressure_drop", "test_standard", "certification", "delivery", "submission", "performance", "material", "track_record", "other")
HEADER_TEXT = {"title": 200, "bid_no": 100, "org": 200, "item_name": 200, "quantity": 100, "estimated_price": 100, "delivery_place": 200, "delivery_term": 200, "spec_doc_no": 100}
HEADER_DATES, HEADER_TIMES = ("announced_on",), ("inquiry_due_at", "bid_due_at", "opening_at")
ANNOUNCEMENT = "announcement"
# End of fixed values.

#: Documents of a project in reading order: the announcement first.
DOC_ORDER = "CASE WHEN doc_type = 'announcement' THEN 0 ELSE 1 END"


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses with column r, rejects that hold no JSON object). ``responses``: project_id, document_id, doc_type, response.

    r has requirements, submission_items, participation_reqs, warnings (arrays of variant) and bid_info (map to variant).
    A text is parsed once, and every field stands for itself: one of the wrong type is null and costs nothing else."""
    # the generator keeps the parsed value: no filter or projection behind it parses again
    rows = responses.withColumn("v", F.explode(F.array(F.try_parse_json("response")))).withColumn("doc_order", F.expr(DOC_ORDER))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    many = {x: F.try_variant_get("v", f"$.{x}", "array<variant>") for x in ("requirements", "submission_items", "participation_reqs", "warnings")}
    fields = F.struct(*[c.alias(x) for x, c in many.items()], F.try_variant_get("v", "$.bid_info", "map<string,variant>").alias("bid_info"))
    return rows.filter(good).withColumn("r", fields).drop("v"), rows.filter(~good).select("project_id", "document_id", "response")


def _text(c: Column, n: int | None = None) -> Column:
    out = T.strip(F.coalesce(c, F.lit("")))
    return F.substring(out, 1, n) if n else out


def scalar(v: Column, path: str = "$") -> Column:
    """A JSON scalar (inside a variant) as text; false, zero, null, arrays and objects are none."""
    text = F.try_variant_get(v, path, "string")
    string = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(~text.rlike(r"^[\[{]|^(?:0|0\.0|false)$") | string, text)


def objects(many: Column) -> Column:
    """The JSON objects among the values of an array."""
    return F.filter(many, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))


def integer(c: Column) -> Column:
    """A JSON number (a variant) without a fraction; texts and other kinds are null."""
    return F.when(F.schema_of_variant(c) == "BIGINT", F.try_variant_get(c, "$", "int"))


def clamp_category(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise("other")


def requirement_rows(parsed: DataFrame) -> DataFrame:
    """All extracted rows, stripped and cut, with their place in the project."""
    rows = parsed.select("project_id", "document_id", "doc_order", F.posexplode(objects(F.col("r.requirements"))).alias("pos", "x"))
    return rows.select(
        "project_id", "document_id", "doc_order", "pos", _text(scalar(F.col("x"), "$.clause_no"), 30).alias("clause_no"), _text(scalar(F.col("x"), "$.item"), 200).alias("item"),
        _text(scalar(F.col("x"), "$.chapter"), 100).alias("chapter"), clamp_category(F.coalesce(scalar(F.col("x"), "$.category"), F.lit(""))).alias("category"),
        _text(scalar(F.col("x"), "$.requirement_text")).alias("requirement_text"), _text(scalar(F.col("x"), "$.context_text")).alias("context_text"), integer(F.try_variant_get("x", "$.source_page", "variant")).alias("source_page"),
    )


def first_wins(rows: DataFrame, existing: DataFrame | None, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows dropped because an earlier or an existing one has their keys). To replace the existing rows, give none."""
    marked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if existing is not None:
        marked = marked.join(existing.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left")
    else:
        marked = marked.withColumn("_old", F.lit(None).cast("boolean"))
    stays = (F.col("_n") == 1) & F.col("_old").isNull()
    return marked.filter(stays).drop("_n", "_old"), marked.filter(~stays).drop("_n", "_old")


def save_requirements(rows: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(requirements with the frozen ai_ columns, warnings (project_id, clause_no, item, kind))."""
    blank = (F.col("clause_no") == "") | (F.col("item") == "")
    good, again = first_wins(rows.filter(~blank), existing, ["project_id", "clause_no", "item"], ["doc_order", "document_id", "pos"])
    made = good.withColumns({"ai_item": F.col("item"), "ai_requirement_text": F.col("requirement_text"), "ai_category": F.col("category"), "is_active": F.lit(True), "is_graded": F.lit(False), "is_edited": F.lit(False)})
    warn = lambda df, kind: df.select("project_id", "clause_no", "item", F.lit(kind).alias("kind"))
    return made, warn(rows.filter(blank), "blank").unionByName(warn(again, "duplicate")).unionByName(warn(made.filter("requirement_text = ''"), "no text"))


def save_submissions(parsed: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(submission items, rows whose seq is no integer); announcements only."""
    rows = parsed.filter(F.col("doc_order") == 0).select("project_id", "document_id", "doc_order", F.posexplode(objects(F.col("r.submission_items"))).alias("pos", "x"))
    rows = rows.select("project_id", "document_id", "doc_order", "pos", integer(F.try_variant_get("x", "$.seq", "variant")).alias("seq"), _text(scalar(F.col("x"), "$.name"), 200).alias("name"), _text(scalar(F.col("x"), "$.note"), 300).alias("note"))
    good, _ = first_wins(rows.filter("seq IS NOT NULL AND name <> ''"), existing, ["project_id", "seq"], ["document_id", "pos"])
    return good.select("project_id", "seq", "name", "note"), rows.filter("seq IS NULL").select("project_id", "name", F.lit("seq").alias("kind"))


def save_participation(parsed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Eligibility clauses of announcements; blank ones go, the first of a seq stays."""
    rows = parsed.filter(F.col("doc_order") == 0).select("project_id", "document_id", F.posexplode(objects(F.col("r.participation_reqs"))).alias("pos", "x"))
    rows = rows.select("project_id", "document_id", "pos", _text(scalar(F.col("x"), "$.seq"), 20).alias("seq"), _text(scalar(F.col("x"), "$.text")).alias("text")).filter("seq <> '' AND text <> ''")
    return first_wins(rows, existing, ["project_id", "seq"], ["document_id", "pos"])[0].select("project_id", "seq", "text")


def strict_time(c: Column) -> Column:
    """A date with or without a time in one of three forms; anything else is null."""
    text = T.strip(c)
    forms = {r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$": "yyyy-M-d H:m", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$": "yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d"}
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in forms.items()])


def fill_header(projects: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects with blank header fields filled, warnings (project_id, field, value) for dates that do not parse).

    Announcements fill any blank field; other documents only a blank spec_doc_no. The first value in reading order wins."""
    info = F.col("r.bid_info")
    value = lambda f: F.nullif(_text(scalar(F.try_element_at(info, F.lit(f)))), F.lit(""))
    at = F.struct("doc_order", "document_id")
    first = lambda f, c: F.min_by(c, F.when(c.isNotNull(), at)).alias(f)
    announced = F.col("doc_order") == 0
    picks = [first(f"new_{f}", F.when(F.lit(True) if f == "spec_doc_no" else announced, F.substring(value(f), 1, n))) for f, n in HEADER_TEXT.items()]
    times = [first(f"new_{f}", F.when(announced, strict_time(value(f)))) for f in (*HEADER_DATES, *HEADER_TIMES)]
    new = parsed.groupBy("project_id").agg(*picks, *times)
    out = projects.join(new, "project_id", "left")
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"new_{f}"), F.lit("")) for f in HEADER_TEXT}
    filled |= {f: F.coalesce(f, F.to_date(f"new_{f}")) for f in HEADER_DATES} | {f: F.coalesce(f, F.col(f"new_{f}")) for f in HEADER_TIMES}
    # A date that does not parse is reported while its field is blank: not where the project has one, nor behind a good one.
    dated = (*HEADER_DATES, *HEADER_TIMES)
    said = parsed.filter(announced).select("project_id", at.alias("at"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value"), strict_time(value(f)).alias("t")) for f in dated])).alias("x")).filter("x.value IS NOT NULL").select("project_id", "at", "x.*")
    good = said.groupBy("project_id", "field").agg(F.min(F.when(F.col("t").isNotNull(), F.col("at"))).alias("since"))
    blank = projects.select("project_id", F.explode(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in dated])).alias("field")).filter("field IS NOT NULL")
    warned = said.filter("t IS NULL").join(good, ["project_id", "field"]).filter("since IS NULL OR at < since").join(blank, ["project_id", "field"]).select("project_id", "field", "value")
    return out.withColumns(filled).drop(*[f"new_{f}" for f in (*HEADER_TEXT, *dated)]), warned


def document_warnings(documents: DataFrame, pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """project_id, message: documents without pages, and each model warning behind its file's name."""
    skipped = documents.join(pages.select("document_id").distinct(), "document_id", "left_anti").select("project_id", F.concat("original_name", F.lit(": no extracted pages")).alias("message"))
    said = parsed.select("document_id", F.explode(F.transform("r.warnings", lambda x: scalar(x))).alias("w")).filter("w IS NOT NULL").join(documents, "document_id").select("project_id", F.concat("original_name", F.lit(": "), F.col("w")).alias("message"))
    return skipped.unionByName(said)


def number_clauses(requirements: DataFrame) -> DataFrame:
    """Adds order: 1..n in a project by clause number as numbers, 2.10 after 2.2."""
    ties = [c for c in ("doc_order", "document_id", "pos", "requirement_id") if c in requirements.columns]
    keyed = requirements.withColumn("_clause", T.clause_key(F.col("clause_no")))
    return numbered(keyed, ["project_id"], ["_clause", *ties], "order").drop("_clause")


def project_summary(projects: DataFrame, requirements: DataFrame, submissions: DataFrame, participation: DataFrame) -> DataFrame:
    """Counts per project and whether nothing was extracted.

    Where extraction replaces, the saving steps get no existing rows and only the new ones are counted."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = projects.select("project_id")
    for df, name in ((requirements, "requirements"), (submissions, "submissions"), (participation, "participations")):
        out = out.join(count(df, name), "project_id", "left").fillna(0, [name])
    return out.withColumn("nothing_extracted", F.col("requirements") == 0)


def after_extraction(existing: DataFrame, made: DataFrame, projects: DataFrame, replace: bool = False) -> DataFrame:
    """The stored rows after an extraction for ``projects`` (project_id). With ``replace`` their old rows go first, and
    ``made`` comes from a saving step that was given no existing rows; else old rows stay and have won there already."""
    if replace:
        existing = existing.join(projects.select("project_id").distinct(), "project_id", "left_anti")
    return existing.unionByName(made, allowMissingColumns=True)


def overlay_edits(requirements: DataFrame, edits: DataFrame, fields: tuple[str, ...] = ("item", "requirement_text", "category", "is_active")) -> DataFrame:
    """Human edits over requirements; is_edited where content changes, the ai_ columns stay."""
    e = edits.select("requirement_id", *[F.col(f).alias(f"e_{f}") for f in fields])
    out = requirements.join(e, "requirement_id", "left")
    changed = F.lit(False)
    for f in fields:
        if f != "is_active":
            changed = changed | F.coalesce(F.col(f"e_{f}") != F.col(f), F.lit(False))
    return out.withColumns({"is_edited": F.col("is_edited") | changed} | {f: F.coalesce(f"e_{f}", f) for f in fields}).drop(*[f"e_{f}" for f in fields])


def mark_graded(requirements: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requirements with is_graded set for the key's clauses, key clauses that match none)."""
    k = key.select("clause_no").distinct().withColumn("in_key", F.lit(True))
    out = requirements.join(k, "clause_no", "left").withColumn("is_graded", F.coalesce("in_key", F.lit(False))).drop("in_key")
    return out, key.join(requirements.select("clause_no"), "clause_no", "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; must be empty."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows with the given values; None means any."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows
