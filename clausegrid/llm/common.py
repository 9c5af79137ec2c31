"""Shared helpers: reading tables, durable intermediate results, text and batch utilities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' contracts define it: space and \x09-\x0D.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1
#: Spark's setting that removes a finished query's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Without one, a session whose tasks all run in the driver's
    own process (master ``local``) takes a temporary folder; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def save(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, any executor can
    be lost afterwards, and the shuffle files that led to it are removed. ``codec``: other than the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*saved: DataFrame) -> None:
    """Empty the tables that ``save`` gave back; nothing may read them any more."""
    for df in saved:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(_PATHS.pop(df))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators use, so that extra or clashing names never matter; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def digest(text: Column) -> Column:
    """32 bytes that name a text."""
    return F.unhex(F.sha2(text, 256))


def without(docs: DataFrame, decided: DataFrame, doc_id: Column, name: Column) -> DataFrame:
    """``docs`` with all its columns and without the rows that ``decided`` (doc_id, digest, kept, n: one row for each
    pair of id and digest) drops; of ``n`` rows that it keeps as one, one stays.

    ``decided`` is a stored table. It is broadcast only if it has at most 300,000 rows (some 30 MB); beyond that both sides shuffle."""
    decided = decided.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("__id__"), F.col("digest").alias("__digest__"), F.col("kept").alias("__kept__"))
    right = F.broadcast(decided) if decided.count() <= 300_000 else decided
    same = doc_id.eqNullSafe(right["__id__"]) & (name == right["__digest__"])
    out = docs.join(right, same, "left_anti")
    once = decided.filter("__kept__")
    if once.isEmpty():
        return out
    again = docs.withColumns({"__id__": doc_id, "__digest__": name})
    match = again["__id__"].eqNullSafe(once["__id__"]) & (again["__digest__"] == once["__digest__"])
    return out.unionByName(again.join(once, match, "left_semi").dropDuplicates(["__id__", "__digest__"]).select(docs.columns))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id; the largest long for null), rid (hash of the text), doc_id, text: key and rid name a
    document alike in every scan. Rows with equal id and text are one document."""
    return documents(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("rid"), "doc_id", "text")


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows holding about ``limit`` bytes of ``column`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(cuts)) + 1
    for a, b in zip([0, *edges], [*edges, n], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every run, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def distinct_runs(raw: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the different byte strings, which of them each is) of strings of ``lengths`` that lie end to end in
    ``raw`` (uint8); told apart by their bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    every = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = every.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()
