"""Checks of extracted pages and tables: they report, never repair.

``tables``: document_id, page_no, table_index, rows (array of cell arrays, header first).
Every check returns document_id, page_no, table_index, row_no, clause_no, kind, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAUSE = r"^\d+\.\d+$"
MIN_CHARS, PAGE_LIMIT = 50, 50
PLACE = ["document_id", "page_no", "table_index"]


def is_clause_table(rows: Column) -> Column:
    """Whether a body row's first cell is a clause number."""
    return F.exists(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(CLAUSE), F.lit(False)))


def _body(tables: DataFrame) -> DataFrame:
    rows = tables.withColumns({"header": F.get("rows", F.lit(0)), "clauses": is_clause_table(F.col("rows"))}).select(*PLACE, "header", "clauses", F.posexplode("rows").alias("row_no", "row"))
    return rows.filter("row_no > 0")


def _warnings(df: DataFrame, kind: str, row_no: Column, clause: Column, message: Column) -> DataFrame:
    return df.select(*PLACE, row_no.cast("int").alias("row_no"), clause.cast("string").alias("clause_no"), F.lit(kind).alias("kind"), message.alias("message"))


def empty_tables(tables: DataFrame) -> DataFrame:
    return _warnings(tables.filter(F.size("rows") <= 0), "empty", F.lit(None), F.lit(None), F.lit("table has no rows"))


def ragged_rows(tables: DataFrame) -> DataFrame:
    rows = _body(tables).filter(F.size("row") != F.size("header"))
    return _warnings(rows, "width", F.col("row_no"), F.lit(None), F.format_string("row has %d cells, header has %d", F.size("row"), F.size("header")))


def blank_cells(tables: DataFrame) -> DataFrame:
    """Blank cells of clause tables; the message names the column."""
    rows = _body(tables).filter(F.col("clauses") & (F.coalesce(F.get("row", F.lit(0)), F.lit("")) != ""))
    cells = rows.select("*", F.posexplode("row").alias("col_no", "cell")).filter(F.trim("cell") == "")
    name = F.coalesce(F.get("header", F.col("col_no")), F.concat(F.lit("column "), (F.col("col_no") + 1).cast("string")))
    return _warnings(cells, "blank", F.col("row_no"), F.get("row", F.lit(0)), F.concat(F.lit("blank cell in "), name))


def clause_gaps(tables: DataFrame) -> DataFrame:
    """Clause numbers that do not follow on within a chapter of one table."""
    rows = _body(tables).withColumn("clause", F.get("row", F.lit(0))).filter(F.col("clause").rlike(CLAUSE))
    part = lambda i: F.element_at(F.split("clause", r"\."), i).cast("int")
    order = Window.partitionBy(*PLACE).orderBy("row_no")
    rows = rows.withColumns({"major": part(1), "minor": part(2)}).withColumns({"p_major": F.lag("major").over(order), "p_minor": F.lag("minor").over(order)})
    rows = rows.filter("major = p_major AND minor <> p_minor + 1")
    return _warnings(rows, "gap", F.col("row_no"), F.col("clause"), F.format_string("%d.%d is followed by %d.%d", "p_major", "p_minor", "major", "minor"))


def table_warnings(tables: DataFrame) -> DataFrame:
    """All checks of tables."""
    return empty_tables(tables).unionByName(ragged_rows(tables)).unionByName(blank_cells(tables)).unionByName(clause_gaps(tables))


def document_stats(pages: DataFrame) -> DataFrame:
    """Per document: pages, tables, characters in texts and cells (without spaces), and whether it is admitted.

    ``pages``: document_id, page_no (null: no page), text, tables array<struct<index, rows>>."""
    chars = lambda c: F.length(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    cells = F.aggregate(F.flatten(F.flatten(F.transform("tables", lambda t: t["rows"]))), F.lit(0), lambda s, c: s + chars(c))
    out = pages.groupBy("document_id").agg(F.count("page_no").alias("page_count"), F.sum(F.coalesce(F.size("tables"), F.lit(0))).alias("table_count"), F.sum(chars(F.col("text")) + F.coalesce(cells, F.lit(0))).alias("chars"))
    reason = F.when(F.col("page_count") == 0, "no pages").when(F.col("page_count") > PAGE_LIMIT, "too many pages").when(F.col("chars") < MIN_CHARS, "no text")
    return out.withColumn("reason", reason)


def table_at(tables: DataFrame, page_no: int, index: int) -> DataFrame:
    """The table at a place in each document."""
    return tables.filter((F.col("page_no") == page_no) & (F.col("table_index") == index))
