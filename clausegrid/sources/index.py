"""The chunk index as a table: laid out by document, updated bucket by bucket.

A folder holds ``chunks`` and ``status``, and for the trigram pools ``texts`` and ``postings`` of the children, all
partitioned by a hash bucket of the document, and ``layout`` with the number of buckets. An update writes the buckets of
its documents anew (their other documents' rows and the new ones) and leaves the files of all other buckets alone. The data
come first and the status after them: a job that dies in between leaves documents that say what they were, and running it
again gives the same table. Documents that yield no chunk have failed; they keep their old chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import TrigramIndex, trigram_index, trigram_postings, trigram_texts
from .io import index_status
from .store import stored

BUCKETS = 64


@dataclass(frozen=True)
class ChunkIndex:
    chunks: DataFrame
    status: DataFrame
    texts: DataFrame
    postings: DataFrame

    def trigrams(self) -> TrigramIndex:
        """What ``retrieval.search`` takes as its ``index``: nothing is derived from the chunks again."""
        return trigram_index(self.chunks, self.texts, self.postings)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One of the tables, or None where it does not stand yet."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return None


def open_index(spark: SparkSession, path: str) -> ChunkIndex:
    return ChunkIndex(*(spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("chunks", "status", "texts", "postings")))


def _replace(rows: DataFrame, path: str, name: str, sort: list[str]) -> None:
    """Overwrites the partitions that ``rows`` have. They are staged first, as they come from the table itself."""
    staged = stored(rows, name)
    laid = staged.repartition("bucket").sortWithinPartitions("bucket", *sort)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")


def update_index(spark: SparkSession, path: str, documents: DataFrame, chunks: DataFrame, model: str, buckets: int = BUCKETS) -> None:
    """Index ``documents`` (document_id) anew with their ``chunks`` (chunk rows with is_parent, content, section_path, ...).

    Chunks of documents that are not asked for are left out. ``buckets`` counts for a new table only."""
    layout = _table(spark, path, "layout")
    if layout is None:  # before all else: what follows depends on it
        layout = spark.range(1).select(F.lit(buckets).alias("buckets"))
        layout.write.parquet(f"{path}/layout")
    n = layout.first()["buckets"]
    bucket: Column = F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int")
    documents = documents.select("document_id").distinct()
    chunks = stored(chunks.join(documents, "document_id", "left_semi").withColumn("bucket", bucket), "chunks")
    done = chunks.select("document_id", "bucket").distinct()
    said = stored(index_status(documents, chunks, model).withColumn("bucket", bucket), "said")
    # at most ``n`` numbers each reach the driver
    touched = [r["bucket"] for r in documents.select(bucket.alias("bucket")).distinct().collect()]
    written = [r["bucket"] for r in done.select("bucket").distinct().collect()]
    rows, status = chunks, said
    if (old := _table(spark, path, "chunks")) is not None:
        rows = old.filter(F.col("bucket").isin(written)).join(done, "document_id", "left_anti").unionByName(chunks, allowMissingColumns=True)
    if (before := _table(spark, path, "status")) is not None:
        before = before.filter(F.col("bucket").isin(touched))
        was = before.select("document_id", F.col("chunk_count").alias("_count"), F.col("embedding_model").alias("_model"))
        failed = F.col("status") == "failed"
        count = F.when(failed, F.coalesce("_count", F.lit(0))).otherwise(F.col("chunk_count"))
        used = F.when(failed, F.coalesce("_model", F.lit(""))).otherwise(F.col("embedding_model"))
        kept = said.join(was, "document_id", "left").withColumns({"chunk_count": count, "embedding_model": used})
        status = before.join(said, "document_id", "left_anti").unionByName(kept.drop("_count", "_model"))
    _replace(rows, path, "chunks", ["document_id", "chunk_id"])
    children = spark.read.parquet(f"{path}/chunks").filter(~F.col("is_parent") & F.col("bucket").isin(written))
    texts = stored(trigram_texts(children, "bucket"), "texts")
    _replace(texts, path, "texts", ["chunk_id"])
    _replace(trigram_postings(texts, "bucket"), path, "postings", ["gram", "chunk_id"])
    _replace(status, path, "status", ["document_id"])
