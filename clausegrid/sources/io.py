"""Readers and writers of the library's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_counts

PAGES = "document_id long, title string, page_no int, text string, tables array<struct<index:int,rows:array<array<string>>>>"
ANSWER_KEY = """graded_total int,
items array<struct<clause_no:string,item:string,requirement:string,expected_verdict:string,expected_our_value_contains:array<string>,forbidden_our_value_contains:array<string>,expected_evidence_state:string,expected_evidence_keywords:array<string>,expected_side_effect_fields:array<string>>>,
reference_items array<struct<clause_no:string,expected_verdict:string>>,
traps array<struct<id:string,name:string,checks:array<struct<kind:string,clause_no:string,clause_nos:array<string>,equals:string,contains:string,not_contains:string,any_of:array<string>,all_of:array<string>,field:string,value:double,model:string,severity:string,description_contains:string>>>>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(markdown files as document_id, name, bytes, text; rejected files with their suffix)."""
    path = F.col("_metadata.file_path")
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.xxhash64(path).alias("document_id"), F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B")).alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))
    markdown = F.lower("name").endswith(".md")
    return rows.filter(markdown), rows.filter(~markdown).select("name", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("suffix"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted pages as JSON lines."""
    return spark.read.schema(PAGES).json(path)


def read_answer_key(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graded items, reference items, trap checks numbered within their trap)."""
    key = spark.read.schema(ANSWER_KEY).json(path, multiLine=True)
    items = key.select(F.explode("items").alias("x")).select("x.*")
    reference = key.select(F.explode("reference_items").alias("x")).select("x.*")
    checks = key.select(F.explode("traps").alias("t")).select(F.col("t.id").alias("trap_id"), F.posexplode("t.checks").alias("check_no", "c")).select("trap_id", "check_no", "c.*")
    checks = checks.withColumns({"clause_nos": F.coalesce("clause_nos", F.array("clause_no")), "contains": F.coalesce("contains", "description_contains")}).drop("clause_no", "description_contains")
    return items, reference, checks


def reindexed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after a batch: its documents' old chunks go, the new ones come. Indexing again changes nothing."""
    return existing.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def admit_numbers(existing: DataFrame, new: DataFrame, replace: bool = False, order: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(documents after loading, rejected new ones), loaded one after another by ``order``.

    A known doc_no is rejected, be it an old document's or one that came earlier in the batch; with ``replace`` every
    document replaces what has its number, so the last of the batch stays. Documents without a number never meet."""
    numbered = F.col("doc_no") != ""
    stays = F.max if replace else F.min
    chosen = new.filter(numbered).groupBy("doc_no").agg(stays(order).alias("_stays"))
    marked = new.join(chosen, "doc_no", "left").withColumn("_own", F.coalesce(F.col(order) == F.col("_stays"), F.lit(True))).drop("_stays")
    if replace:
        kept = existing.join(new.filter(numbered).select("doc_no").distinct(), "doc_no", "left_anti")
        return kept.unionByName(marked.filter("_own").drop("_own"), allowMissingColumns=True), new.limit(0)
    known = existing.filter(numbered).select("doc_no").distinct().withColumn("_known", F.lit(True))
    marked = marked.join(known, "doc_no", "left")
    fresh = F.col("_own") & F.col("_known").isNull()
    return existing.unionByName(marked.filter(fresh).drop("_own", "_known"), allowMissingColumns=True), marked.filter(~fresh).drop("_own", "_known").select(new.columns)


def index_status(documents: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """document_id, status, chunk_count, embedding_model, error_message; a document without chunks has failed and keeps its old ones."""
    out = documents.select("document_id").join(chunk_counts(chunks), "document_id", "left").withColumn("n", F.coalesce(F.col("parents") + F.col("children"), F.lit(0)))
    done = F.col("n") > 0
    return out.select("document_id", F.when(done, "indexed").otherwise("failed").alias("status"), F.col("n").alias("chunk_count"), F.when(done, model).otherwise("").alias("embedding_model"), F.when(done, "").otherwise("no chunks: the document is empty").alias("error_message"))


def chunk_listing(chunks: DataFrame, document_id: int, is_parent: bool | None = None) -> DataFrame:
    """A document's chunks in order of id."""
    rows = chunks.filter(F.col("document_id") == document_id)
    return (rows if is_parent is None else rows.filter(F.col("is_parent") == is_parent)).orderBy("chunk_id")


def flat(df: DataFrame) -> DataFrame:
    """Every column as text: arrays, structs and maps as JSON, others by cast; null stays null."""
    nested = lambda kind: kind.startswith(("array", "struct", "map"))
    return df.select(*[(F.to_json(F.col(f"`{c}`")) if nested(kind) else F.col(f"`{c}`").cast("string")).alias(c) for c, kind in df.dtypes])


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A deliverable as parquet, csv or markdown. In csv and markdown nested values are JSON texts. A markdown file has a
    header and one pipe line a row: pipes are escaped and line ends become ``<br>``; every file of a folder is a table."""
    if form == "markdown":
        cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n|[\r\n]", "<br>")
        lines = flat(df).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |")).alias("value"))
        head = ["| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |", "|" + "---|" * len(df.columns)]

        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun = False
            for batch in batches:
                if batch.num_rows and not begun:
                    begun = True
                    yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                yield batch

        lines.mapInArrow(headed, "value string").write.text(path)
    elif form == "csv":
        flat(df).write.csv(path, header=True)
    else:
        df.write.parquet(path)
