"""Documents into lines, sections, tables and rows.

All window steps share one partitioning by document. A document is bounded (megabytes), so
one document per task is safe; documents spread over tasks by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectorized import table_rows

# Labels of document numbers and dates, headings and rules, texts for what is missing.
DOC_NO = r"(?mU)^\s*문서\s*번호\s*[:：]\s*(\S+)"
REVISION_DATE = r"(?mU)^\s*(?:개정일|기준일|작성일)\s*[:：]\s*(\d{4}-\d{2}-\d{2})"
PAGE_DOC_NO = r"(?U)(?:문서\s*번호|공고\s*번호)\s*[:：]?\s*([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)"
TABLE_LABEL, COLUMN_LABEL = "표", "열"
HEADING = r"(?U)^(#{1,6})\s+(.*)$"
RULE_LINE = r"(?U)^\s*([-*_])\1{2,}\s*$"
NO_NUMBER, NO_BODY, NO_TABLES = "(없음)", "(표 밖 본문 없음)", "(표 없음)"
# End of fixed values.


def document_lines(docs: DataFrame) -> DataFrame:
    """document_id, line_no, line, level (0: no heading), name, table_no, row_no of (document_id, text)."""
    split = docs.select("document_id", T.lines(F.col("text")).alias("lines"))
    rows = split.withColumn("places", table_rows("lines")).select("document_id", F.posexplode(F.arrays_zip("lines", "places")).alias("line_no", "x"))
    line = F.col("x.lines")
    level = F.length(F.regexp_extract(line, HEADING, 1))
    return rows.select("document_id", "line_no", line.alias("line"), level.alias("level"), T.strip(F.regexp_extract(line, HEADING, 2)).alias("name"), F.col("x.places.table_no").alias("table_no"), F.col("x.places.row_no").alias("row_no"))


def with_sections(rows: DataFrame) -> DataFrame:
    """Adds section_id and heading_path: a heading replaces its level and clears the deeper ones."""
    in_doc = Window.partitionBy("document_id").orderBy("line_no")
    so_far = in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda k: F.max(F.when(F.col("level") == k, F.struct("line_no", "name"))).over(so_far)
    rows = rows.withColumn("section_id", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    rows = rows.withColumns({f"h{k}": at(k) for k in range(1, 7)})
    title = F.first(F.when(F.col("level") == 1, F.col("name")), ignorenulls=True).over(in_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    valid = []
    for k in range(1, 7):
        above = [F.col(f"h{j}.line_no") for j in range(1, k)]
        last = F.coalesce(F.greatest(*above) if len(above) > 1 else above[0], F.lit(-1)) if above else F.lit(-1)
        valid.append(F.when(F.col(f"h{k}.line_no") > last, F.col(f"h{k}.name")))
    path = F.array_compact(F.array(*valid))
    preamble = F.array_compact(F.array(title))
    return rows.withColumn("heading_path", F.when(F.col("section_id") == 0, preamble).otherwise(path)).drop(*[f"h{k}" for k in range(1, 7)])


def sections(rows: DataFrame) -> DataFrame:
    """document_id, section_id, heading, level, heading_path, text; sections with nothing in them are left out."""
    plain = (F.col("level") == 0) & F.col("table_no").isNull() & ~F.col("line").rlike(RULE_LINE)
    out = rows.groupBy("document_id", "section_id").agg(
        F.max("name").alias("heading"), F.max("level").alias("level"), F.first("heading_path").alias("heading_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(plain, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("text"),
        F.count("table_no").alias("table_lines"),
    )
    out = out.withColumn("text", T.strip(F.col("text")))
    return out.filter("heading <> '' OR text <> '' OR table_lines > 0").drop("table_lines")


def row_cells(line: Column) -> Column:
    """Cells of a pipe line."""
    bare = T.strip(line)
    bare = F.when(bare.startswith("|"), F.substring(bare, 2, 1 << 30)).otherwise(bare)
    bare = F.regexp_replace(bare, r"\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: T.cell(c))


def tables(rows: DataFrame) -> DataFrame:
    """document_id, section_id, table_index, heading_path, rows (array of cell arrays; the header first)."""
    body = rows.filter("row_no >= 0").withColumn("cells", row_cells(F.col("line")))
    return body.groupBy("document_id", "section_id", F.col("table_no").alias("table_index")).agg(
        F.first("heading_path").alias("heading_path"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"),
    )


def tables_under(tables: DataFrame, part: str) -> DataFrame:
    """Tables with a heading that contains ``part``."""
    return tables.filter(F.exists("heading_path", lambda p: p.contains(part)))


def first_section(sections: DataFrame, part: str) -> DataFrame:
    """Each document's first section whose heading contains ``part``."""
    return sections.filter(F.col("heading").contains(part)).groupBy("document_id").agg(F.min_by("section_id", "section_id").alias("section_id"), F.min_by("heading", "section_id").alias("heading"))


def metadata(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, title, doc_no, revision_date (null where the text has none)."""
    title = rows.filter("level = 1").groupBy("document_id").agg(F.min_by("name", "line_no").alias("title"))
    found = docs.select("document_id", F.regexp_extract("text", DOC_NO, 1).alias("doc_no"), F.try_to_date(F.nullif(F.regexp_extract("text", REVISION_DATE, 1), F.lit("")), "yyyy-MM-dd").alias("revision_date"))
    return found.join(title, "document_id", "left").select("document_id", F.coalesce("title", F.lit("")).alias("title"), "doc_no", "revision_date")


def fill_blank_metadata(documents: DataFrame, found: DataFrame, stem: str = "stem") -> DataFrame:
    """Blank title, doc_no and revision_date of ``documents`` from ``found``; a title falls back to column ``stem``."""
    f = found.select("document_id", F.col("title").alias("f_title"), F.col("doc_no").alias("f_no"), F.col("revision_date").alias("f_date"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    out = documents.join(f, "document_id", "left")
    return out.withColumns({"title": F.coalesce(blank("title"), blank("f_title"), F.col(stem)), "doc_no": F.coalesce(blank("doc_no"), F.col("f_no"), F.lit("")), "revision_date": F.coalesce("revision_date", "f_date")}).drop("f_title", "f_no", "f_date")


def table_markdown(rows: Column, has_header: bool = True) -> Column:
    """A table as pipe lines: blank rows go, short rows are padded, pipes escaped."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: T.strip(c) != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    escaped = lambda r: F.transform(r, lambda c: F.when(c == "", " ").otherwise(F.replace(c, F.lit("|"), F.lit("\\|"))))
    padded = F.transform(full, lambda r: F.concat(escaped(r), F.array_repeat(F.lit(" "), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    if has_header:
        out = F.concat(F.array(line(F.get(padded, F.lit(0))), rule), F.transform(F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0))), line))
    else:
        names = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit(COLUMN_LABEL), i.cast("string")))
        out = F.concat(F.array(line(names), rule), F.transform(padded, line))
    return F.when(F.size(full) > 0, F.array_join(out, "\n")).otherwise("")


def page_sections(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted pages as sections (path: title > p.N) and tables numbered on through the document.

    ``pages``: document_id, title, page_no, text, tables array<struct<index, rows>>."""
    name = F.concat(F.lit("p."), F.col("page_no").cast("string"))
    path = F.array(F.col("title"), name)
    secs = pages.select("document_id", F.col("page_no").alias("section_id"), name.alias("heading"), F.lit(2).alias("level"), path.alias("heading_path"), "text")
    flat = pages.select("document_id", F.col("page_no").alias("section_id"), path.alias("heading_path"), F.posexplode("tables").alias("pos", "t"))
    order = Window.partitionBy("document_id").orderBy("section_id", "pos")
    return secs, flat.select("document_id", "section_id", (F.row_number().over(order) - 1).alias("table_index"), "heading_path", F.col("t.rows").alias("rows"))


def page_doc_no(pages: DataFrame) -> DataFrame:
    """document_id, doc_no: the first labelled number, in page texts first, then in table rows."""
    texts = pages.select("document_id", F.lit(0).alias("prio"), "page_no", F.lit(0).alias("t"), F.lit(0).alias("r"), F.col("text").alias("line"))
    rows = pages.select("document_id", "page_no", F.posexplode("tables").alias("t", "table")).select("document_id", "page_no", "t", F.posexplode("table.rows").alias("r", "row"))
    rows = rows.select("document_id", F.lit(1).alias("prio"), "page_no", "t", "r", F.array_join("row", " ").alias("line"))
    found = texts.unionByName(rows).withColumn("doc_no", F.regexp_extract("line", PAGE_DOC_NO, 1))
    best = found.filter("doc_no <> ''").groupBy("document_id").agg(F.min_by("doc_no", F.struct("prio", "page_no", "t", "r")).alias("doc_no"))
    return pages.select("document_id").distinct().join(best, "document_id", "left").select("document_id", F.coalesce("doc_no", F.lit("")).alias("doc_no"))


def pages_markdown(pages: DataFrame) -> DataFrame:
    """document_id, tables_markdown: all tables, labelled by page and number."""
    flat = pages.select("document_id", "page_no", F.posexplode("tables").alias("pos", "t")).withColumn("md", table_markdown(F.col("t.rows"))).filter("md <> ''")
    block = F.concat(F.lit("[p."), F.col("page_no").cast("string"), F.lit(f" {TABLE_LABEL} "), (F.col("t.index") + 1).cast("string"), F.lit("]\n"), F.col("md"))
    return flat.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "pos", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("tables_markdown"))


def prompt_rows(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One extraction-prompt row per document: body text, tables, type label and number (documents: document_id, doc_type_label, doc_no)."""
    text = pages.filter(T.strip(F.col("text")) != "").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.concat(F.lit("[p."), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text")).alias("block")))), lambda x: x["block"]), "\n\n").alias("body_text"))
    out = documents.join(text, "document_id", "left").join(pages_markdown(pages), "document_id", "left")
    return out.select("document_id", "doc_type_label", F.coalesce(F.nullif("doc_no", F.lit("")), F.lit(NO_NUMBER)).alias("doc_no"), F.coalesce("body_text", F.lit(NO_BODY)).alias("body_text"), F.coalesce("tables_markdown", F.lit(NO_TABLES)).alias("tables_markdown"))
