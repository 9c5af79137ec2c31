"""Exact top-k search by distributed histogram selection.

Vectors become integers and scores are integer inner products. Queries and candidates
are dealt to blocks by hash; every candidate block meets every query block, as matrices.

Every round scores everything and counts, for each query, the scores per bin of the range
that still holds its k-th value; the counts are summed over all blocks, and the bin with
the k-th value becomes the next range, until it is one integer wide (three rounds of 1024
bins for unit vectors). A block sends only the bins of its own k highest scores in the
range, which is all that can matter. At last scores at or above the k-th value are kept
and ranked, ties to the smaller id.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part; vectors meet only vectors of their length; a null id takes no part; a query meets
every row but itself, rows of its own id too; repeated rows are queries and candidates of
their own; components beyond 64 bits after scaling are the nearest 64-bit number and scores
beyond a long count as its limit; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SCALE, BINS = 1024, 1024
#: Greatest score either way.
LIMIT = (1 << 63) - 1
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Scores held at once: a block of candidates times so many queries.
QUERIES_AT_ONCE = 64


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """row, id, v (array of long) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(packed: pa.StructArray, exact: bool) -> np.ndarray:
    lists = packed.field("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(packed), -1)
    return flat.astype(np.float64) if exact else flat.astype(object)


def _scores(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, candidate ids, scores, own) of bounded pieces of every pair of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            queries, candidates = batch.column("queries")[k].values, batch.column("candidates")[k].values
            ids, c = candidates.field("id").to_numpy(), _matrix(candidates, exact).T
            for i in range(0, len(queries), QUERIES_AT_ONCE):
                part = queries.slice(i, QUERIES_AT_ONCE)
                found = _matrix(part, exact) @ c
                score = found.astype(np.int64) if exact else np.clip(found, -LIMIT, LIMIT).astype(np.int64)
                yield part, ids, score, part.field("row").to_numpy()[:, None] == candidates.field("row").to_numpy()


def _count_bins(width: int, span: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, _, score, own in _scores(batches, exact):
            lo, need = queries.field("lo").to_numpy(), queries.field("need").to_numpy()
            if not exact:  # differences of two longs need more than 64 bits
                score, lo = score.astype(object), lo.astype(object)
            score = score - lo[:, None]
            bins = np.where(own | (score < 0) | (score >= span), -1, score // width).astype(np.int64)
            most = min(int(need.max()), bins.shape[1])
            top = -np.sort(-np.partition(bins, bins.shape[1] - most, axis=1)[:, bins.shape[1] - most :], axis=1)
            keep = (top >= 0) & (np.arange(most) < need[:, None])
            q, col = np.nonzero(keep)
            pairs, n = np.unique(q * BINS + top[q, col], return_counts=True)
            yield pa.RecordBatch.from_arrays([queries.field("row").take(pa.array(pairs // BINS)), pa.array(pairs % BINS), pa.array(n, pa.int64())], ["row", "bin", "n"])

    return run


def _take(k: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, ids, score, own in _scores(batches, exact):
            q, col = np.nonzero((score >= queries.field("lo").to_numpy()[:, None]) & ~own)
            order = np.lexsort((ids[col], -score[q, col], q))
            q, col = q[order], col[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, col = q[place < k], col[place < k]
            yield pa.RecordBatch.from_arrays([queries.field("row").take(pa.array(q)), queries.field("id").take(pa.array(q)), pa.array(ids[col]), pa.array(score[q, col])], ["row", "query_id", "vec_id", "score"])

    return run


def _pairs(queries: DataFrame, candidates: DataFrame, query_blocks: int, candidate_blocks: int) -> DataFrame:
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    dim = F.size("v")
    q = queries.groupBy(dim.alias("dim"), block(query_blocks).alias("qb")).agg(F.collect_list(F.struct("row", "id", "v", "lo", "need")).alias("queries"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))
    c = candidates.groupBy(dim.alias("dim"), block(candidate_blocks).alias("cb")).agg(F.collect_list(F.struct("row", "id", "v")).alias("candidates"))
    # by a shuffle: stored vectors look small enough to broadcast, while their blocks, once for each of the other side, are not
    return q.join(c.hint("merge"), ["dim", "cb"]).select("queries", "candidates")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row with ``is_query`` (on column ``id``) the k highest scores among the other rows."""
    every = save(integers(vectors, id_col, vector_col, scale), "vectors")
    stats = every.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm2")).first()
    bound = int((stats["norm2"] or 0) * 1.000001) + 1  # Cauchy-Schwarz
    exact = bound < 1 << 52
    bound = min(bound, LIMIT)
    query_blocks, candidate_blocks = -(-stats["q"] // QUERY_BLOCK) or 1, -(-stats["n"] // CANDIDATE_BLOCK) or 1
    state = every.filter(is_query).withColumns({"lo": F.lit(-bound).cast("long"), "need": F.lit(k).cast("long")})
    width = 2 * bound + 1
    while width > 1:
        span, width = width, -(-width // BINS)
        counted = _pairs(state, every, query_blocks, candidate_blocks).mapInArrow(_count_bins(width, span, exact), "row long, bin long, n long")
        bins = counted.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        found = bins.withColumn("upto", F.sum("n").over(down)).join(state.select("row", "need"), "row").filter("upto >= need")
        found = found.groupBy("row").agg(F.max("bin").alias("bin"), F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("at"))
        wide = "decimal(38,0)"  # a bin's begin may be far from both its factors
        place = (F.col("lo").cast(wide) + F.coalesce("bin", F.lit(0)).cast("decimal(10,0)") * F.lit(str(width)).cast("decimal(20,0)")).cast("long")
        state = state.join(found, "row", "left").select("row", "id", "v", place.alias("lo"), (F.col("need") - F.coalesce("at.above", F.lit(0))).alias("need"))
        state = save(state, "ranges")
    hits = _pairs(state, every, query_blocks, candidate_blocks).mapInArrow(_take(k, exact), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
