"""Token-id files: documents' ids in ascending id order, as Re-Pair grammars a shard (see ``grammar``).

A folder holds two tables. ``shards``: one row a shard with its place (part, shard), the ids of its part
before it, how many documents and ids it has, and its bytes; parts are ranges of ids in order, so a reader needs no other order.
``offsets``: one row a part with the number of ids before it. Texts are dealt to parts by ranges of
(id, hash of the text, row), sorted, encoded and compressed where they lie: one shuffle of the texts.
A shard holds about ``shard_ids`` ids and at least one document.

Any document's ids are read through the expansion lengths without expanding the rest of its shard:
``read_spans`` sends each wish to the shard of its document.

Defined results: null and empty texts are documents of the end id alone; null ids come last and stay
null; rows with equal ids are documents of their own, ordered by a hash of their texts; a very long text
is one document of one shard; other columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grammar
from .bpe import default_path, encoder
from .common import byte_texts, documents, slices

END_ID, SHARD_IDS = 1, 1 << 20
_SHARD = "part long, shard long, first long, n_docs long, n_ids long, payload binary"


def _shards(vocabulary: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        context = TaskContext.get()
        base = max(*enc.library.get_vocab(with_added_tokens=True).values(), end_id) + 1
        part, shard, first = context.partitionId() if context else 0, 0, 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            names = pa.concat_arrays(keys)
            n = np.concatenate(counts)
            made = grammar.compress(np.concatenate(ids), n, base)
            raw = made.to_bytes(names.fill_null(0).to_numpy(zero_copy_only=False), names.is_valid().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, shard, first, len(n), int(n.sum()))] + [pa.array([raw], pa.binary())], ["part", "shard", "first", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                found, n = enc.encode(byte_texts(piece))
                ids.append(np.insert(found, np.cumsum(n), end_id))
                counts.append(n + 1)
                keys.append(piece.column("doc_id"))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
                    first += held
                    ids, counts, keys, held, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write the two tables into the folder ``path``."""
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).withColumns({"rid": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("rid"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(_shards(vocabulary or default_path(), end_id, shard_ids), _SHARD).write.parquet(f"{path}/shards")
    sizes = spark.read.schema(_SHARD).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row a written file: the running sum over them is bounded by the number of tasks, not of documents
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{path}/offsets")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(_SHARD).parquet(f"{path}/shards"), spark.read.schema("part long, start long").parquet(f"{path}/offsets")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, first, raw in zip(*(batch.column(x).to_pylist() for x in ("part", "shard", "first", "payload")), strict=True):
            made, doc_ids, has_id = grammar.from_bytes(raw)
            n = made.tokens.astype(np.int64)
            ends = np.cumsum(n)
            ids = memoryview(made.ids().astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(np.full(len(n), part)), pa.array(np.full(len(n), shard)), pa.array(np.arange(len(n))), pa.array(doc_ids, mask=~has_id), pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "place", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the folder, from its files, with part, shard and place in it."""
    shards, offsets = _tables(spark, path)
    docs = shards.select("part", "shard", "first", "payload").mapInArrow(_checked, "part long, shard long, place long, doc_id long, at long, n_tokens long, ids_crc32 long")
    begins = offsets.withColumnRenamed("start", "before")
    return docs.join(begins, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "place")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, wishes in zip(batch.column("payload").to_pylist(), batch.column("wishes").to_pylist(), strict=True):
            made, doc_ids, has_id = grammar.from_bytes(raw)
            rows = [(int(doc_ids[w["place"]]) if has_id[w["place"]] else None, w["start"], made.span(w["place"], w["start"], w["n"]).astype(np.int64)) for w in wishes]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])


def read_spans(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, ids: for each row (doc_id, start, n) of ``wanted`` so many ids of the document from its own place
    ``start`` on (fewer at its end). Ids that the folder does not hold give no row, ids it holds twice give two; a wish asked twice is answered once."""
    shards, _ = _tables(spark, path)
    index = shards.select("part", "shard", "payload").mapInArrow(_places, "part long, shard long, place long, doc_id long")
    found = index.join(wanted.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("n").cast("long")).distinct(), "doc_id")
    # a shard's wishes are dealt to piles, so that a document that all ask for is no single group
    pile = F.pmod(F.xxhash64("place", "start", "n"), F.lit(64))
    wishes = found.groupBy("part", "shard", pile.alias("pile")).agg(F.collect_list(F.struct("place", "start", "n")).alias("wishes"))
    return shards.select("part", "shard", "payload").join(wishes, ["part", "shard"]).select("payload", "wishes").mapInArrow(_spans, "doc_id long, start long, ids array<long>")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, raw in zip(*(batch.column(x).to_pylist() for x in ("part", "shard", "payload")), strict=True):
            doc_ids, has_id = grammar.from_bytes(raw)[1:]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, shard)), pa.array(np.arange(n)), pa.array(doc_ids, mask=~has_id)], ["part", "shard", "place", "doc_id"])
