"""Sections and tables into parent and child chunks (narrow steps over the parse result)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectorized import group_sentences
from .markdown import table_markdown

PARENT_MAX_TOKENS, PATH_CHARS = 1200, 300
CHUNK_COLUMNS = ["document_id", "section_id", "kind_order", "table_index", "part", "row_no", "is_parent", "chunk_type", "content", "section_path", "heading", "keywords", "model_tags"]


def joined_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def table_parents(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """One parent for each table."""
    rows = tables.join(sections.select("document_id", "section_id", "heading"), ["document_id", "section_id"], "left")
    content, path = table_markdown(F.col("rows")), joined_path(F.col("heading_path"))
    heading = F.coalesce(F.nullif("heading", F.lit("")), F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    out = rows.withColumns({"content": content, "section_path": path, "heading": heading})
    return out.select("document_id", "section_id", F.lit(1).alias("kind_order"), "table_index", F.lit(0).alias("part"), F.lit(0).alias("row_no"), F.lit(True).alias("is_parent"), F.lit("table").alias("chunk_type"), "content", "section_path", "heading", T.keywords(F.col("content"), F.col("section_path")).alias("keywords"), T.model_tags(F.col("heading_path"), F.col("content")).alias("model_tags"), "heading_path", "rows")


def row_sentence(heading: Column, header: Column, row: Column) -> Column:
    """A table row as one searchable sentence: heading, then label and cell."""
    label = lambda i: F.coalesce(F.get(header, i), F.lit(""))
    pairs = F.transform(row, lambda c, i: F.when(c == "", F.lit(None)).when(label(i) == "", c).otherwise(F.concat(label(i), F.lit(": "), c)))
    body = F.array_join(F.array_compact(pairs), ", ")
    return F.when(heading != "", F.concat(heading, F.lit(" — "), body)).otherwise(body)


def table_children(parents: DataFrame) -> DataFrame:
    """One child for each body row that is not blank."""
    rows = parents.withColumn("header", F.get("rows", F.lit(0))).select("*", F.posexplode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("pos", "row"))
    rows = rows.filter(F.exists("row", lambda c: T.strip(c) != "")).withColumn("content", row_sentence(F.col("heading"), F.col("header"), F.col("row")))
    return rows.withColumns({"row_no": F.col("pos") + 1, "is_parent": F.lit(False), "chunk_type": F.lit("table_row"), "keywords": T.keywords(F.col("content")), "model_tags": T.model_tags(F.col("heading_path"), F.col("content"))}).select(*CHUNK_COLUMNS)


def text_parents(sections: DataFrame) -> DataFrame:
    """Sections with text as parents with their children; an over-long one in two halves at the middle paragraph."""
    rows = sections.filter("text <> ''").withColumn("path", joined_path(F.col("heading_path")))
    rows = rows.withColumn("children", group_sentences(T.sentences(F.col("text")))).withColumn("children", F.when(F.size("children") > 0, F.col("children")).otherwise(F.array("text")))
    rows = rows.withColumn("tags", T.model_tags(F.col("heading_path"), F.col("text")))
    paragraphs = F.filter(F.split("text", "\n\n"), lambda p: T.strip(p) != "")
    mid = F.floor(F.size("paragraphs") / 2).cast("int")
    rows = rows.withColumn("paragraphs", paragraphs).withColumn("halves", F.when((T.token_estimate(F.col("text")) > PARENT_MAX_TOKENS) & (F.size("paragraphs") > 1), F.array(F.array_join(F.slice("paragraphs", F.lit(1), mid), "\n\n"), F.array_join(F.slice("paragraphs", mid + 1, F.size("paragraphs") - mid), "\n\n"))))
    rows = rows.select("*", F.posexplode(F.coalesce("halves", F.array("text"))).alias("part", "content"))
    halved = F.col("halves").isNotNull()
    inside = F.filter("children", lambda c: F.col("content").contains(c))
    own = F.when(~halved, F.col("children")).when(F.size(inside) > 0, inside).otherwise(F.array("content"))
    path = F.when(halved, F.concat("path", F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit("/2)"))).otherwise(F.col("path"))
    words = F.when(halved, T.keywords(F.col("content"))).otherwise(T.keywords(F.col("content"), F.col("path")))
    # Children keep the whole section's path unless the half has none of them.
    child_path = F.when(halved & (F.size(inside) == 0), path).otherwise(F.col("path"))
    return rows.select("document_id", "section_id", F.lit(0).alias("kind_order"), F.lit(-1).alias("table_index"), "part", F.lit(0).alias("row_no"), F.lit(True).alias("is_parent"), F.lit("text").alias("chunk_type"), "content", path.alias("section_path"), "heading", words.alias("keywords"), F.col("tags").alias("model_tags"), own.alias("children"), child_path.alias("child_path"))


def text_children(parents: DataFrame) -> DataFrame:
    rows = parents.withColumn("whole", (F.size("children") == 1) & (F.get("children", F.lit(0)) == F.col("content")))
    rows = rows.select("*", F.posexplode("children").alias("pos", "child"))
    words = F.when(F.col("whole") & (F.size(T.sentences(F.col("content"))) == 0), F.col("keywords")).otherwise(T.keywords(F.col("child")))
    return rows.withColumns({"keywords": words, "row_no": F.col("pos") + 1, "is_parent": F.lit(False), "content": F.col("child"), "section_path": F.col("child_path")}).select(*CHUNK_COLUMNS)


def chunk_key(is_parent: Column) -> Column:
    """Stable ids from a chunk's place, so indexing again gives the same ids."""
    return F.xxhash64("document_id", "section_id", "kind_order", "table_index", "part", F.when(is_parent, F.lit(0)).otherwise(F.col("row_no")))


def build_chunks(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """All chunks with chunk_id, parent_id and token_count; parents come before their rows, texts before tables."""
    tp, xp = table_parents(tables, sections), text_parents(sections)
    every = tp.select(*CHUNK_COLUMNS).unionByName(table_children(tp)).unionByName(xp.select(*CHUNK_COLUMNS)).unionByName(text_children(xp))
    cut = lambda c: F.substring(c, 1, PATH_CHARS)
    return every.withColumns({"chunk_id": chunk_key(F.col("is_parent")), "parent_id": F.when(~F.col("is_parent"), chunk_key(F.lit(True))), "token_count": T.token_estimate(F.col("content")), "section_path": cut("section_path"), "heading": cut("heading")})


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """document_id, parents, children."""
    return chunks.groupBy("document_id").agg(F.count_if("is_parent").alias("parents"), F.count_if(~F.col("is_parent")).alias("children"))


def embedding_input(path: Column, content: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(path, F.lit("\n"), content)).otherwise(content)
