"""Hard-negative mining by norm-bucketed exact search.

Vectors become integers and scores are integer inner products. Candidates are range-sorted by
norm, longest first, into blocks, and stored row by row; a round puts the rows of a block together
and cuts it into buckets that know the greatest norm in them. Anchors travel in blocks too, those
that need the longest candidates last, and every block of anchors meets every block of candidates that it cannot rule out.

What an anchor still needs is a least score: the lower limit of its windows, or the k-th score it
has already. By Cauchy-Schwarz no candidate shorter than (least score / anchor's norm) can reach
it, so blocks are left out of the join and buckets are skipped inside a block; the k-th score
runs along the buckets of a block, and between two rounds over all blocks: the first round takes
the blocks of the longest candidates (a sixteenth, ties included), the second all others under
the k-th scores that the first one found, and hands on no score below them. Equality never prunes, so ties stay exact.

First an anchor's positives are searched (same label, no window), then for each positive the
negatives of other labels in the window that its score sets.

Defined results: rows with a null id, a null label, or a vector that is null, empty or holds a
null or non-finite component take no part; vectors meet only vectors of their length; an anchor
meets every row but itself, rows of its own id too; repeated rows are anchors and candidates of
their own; ties go to the smaller id; components beyond 64 bits after scaling are the nearest
64-bit number, scores beyond a long come out as its limit; windows of negative positives are
empty; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, save

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The window of a positive's score in which its negatives lie, in hundredths.
LOW, HIGH = 30, 90
#: Candidates whose norm bound is looked at together, and anchors scored at once.
BUCKET, ANCHORS_AT_ONCE = 1024, 128
#: Most rows and most components of a block.
BLOCK_ROWS, BLOCK_SIZE = 8192, 1 << 20
#: Blocks of candidates that a block of anchors is sent to together.
BLOCKS_TOGETHER = 16
#: Norms are doubles; so much longer counts as equal.
SLACK = 1.0 + 1e-9
_LONG = (1 << 63) - 1

_ANCHOR = "row long, id long, label long, norm double, v array<long>, windows array<struct<pid:long,score:long,least:double>>"
_HIT = "row long, id long, pid long, pscore long, vec_id long, score long"


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """row, id, label, v (array of long), dim, norm of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.withColumns({"dim": F.size("v"), "norm": norm})


def _packed(names: list[str], key: str):
    """Sorted rows to blocks: dim, the first row's ``key`` and the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), batch.column(key).to_numpy()
            members = pa.StructArray.from_arrays([batch.column(x) for x in names], names)
            a = 0
            while a < len(dims):
                most = min(BLOCK_ROWS, max(BLOCK_SIZE // int(dims[a]), 1))
                same = dims[a : a + most] == dims[a]
                b = a + (len(same) if same.all() else int(same.argmin()))
                lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), members.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([dims[a]], pa.int32()), pa.array([keys[a]], pa.float64()), lists], ["dim", "first", "members"])
                a = b

    return run


def _blocks(rows: DataFrame, schema: str, key: str, order: list[Column], parts: int) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    ranged = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order).select(*names, "dim", *([] if key in names else [key]))
    members = ",".join(x.replace(" ", ":", 1) for x in schema.split(", "))
    return ranged.mapInArrow(_packed(names, key), f"dim int, first double, members array<struct<{members}>>")


def _matrix(lists: pa.ListArray, kind: type) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(kind)


def _limits(score: np.ndarray, windowed: bool, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    if not windowed:
        return np.full(len(score), -_LONG, score.dtype), np.full(len(score), _LONG, score.dtype)
    return -((-low * score) // 100), (high * score) // 100


def _search(k: int, same: bool, kind: type, low: int, high: int):
    """Each pair of blocks to the k best of every anchor's window in it. ``kind``: float32 or float64 where products of
    this size are exact, object (Python integers) beyond."""
    exact = kind is not object
    whole = np.int64 if exact else object

    def window_hits(anchors: pa.StructArray, of: np.ndarray, pid: np.ndarray, pscore: np.ndarray, least: np.ndarray, tops: np.ndarray, c: dict) -> Iterator[pa.RecordBatch]:
        """``of``: the anchor (place in ``anchors``) of each window."""
        norm = anchors.field("norm").to_numpy()[of]
        label, row = anchors.field("label").to_numpy()[of], anchors.field("row").to_numpy()[of]
        vectors = _matrix(anchors.field("v"), kind)
        lo, hi = _limits(pscore.astype(whole), not same, low, high)
        best_s, best_i = np.full((len(of), k), -_LONG, whole), np.full((len(of), k), _LONG)
        need = np.maximum(least, np.array(lo, np.float64) if not same else -np.inf)
        floor = np.maximum(least, -_LONG).astype(whole) if exact else lo  # a double may lie above a greater score
        for b, top in enumerate(tops.tolist()):
            open_ = np.flatnonzero((norm * top * SLACK >= need) & (lo <= hi))
            if not len(open_):
                break  # buckets get shorter, needs only grow
            at = slice(b * BUCKET, (b + 1) * BUCKET)
            mine, place = np.unique(of[open_], return_inverse=True)
            score = (vectors[mine] @ c["v"][at].T).astype(whole)[place]
            fits = (label[open_, None] == c["label"][at]) == same
            fits &= (row[open_, None] != c["row"][at]) & (score >= lo[open_, None]) & (score <= hi[open_, None])
            w, col = np.nonzero(fits & (score >= np.maximum(best_s[open_, k - 1], floor[open_])[:, None]))
            if not len(w):
                continue
            owner = np.r_[w, np.repeat(np.arange(len(open_)), k)]
            s, i = np.r_[score[w, col], best_s[open_].ravel()], np.r_[c["id"][at][col], best_i[open_].ravel()]
            order = np.lexsort((i, -s, owner)) if exact else np.array(sorted(range(len(s)), key=lambda x: (owner[x], -s[x], i[x])))
            owner = owner[order]
            keep = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < k]
            best_s[open_], best_i[open_] = s[keep].reshape(-1, k), i[keep].reshape(-1, k)
            full = best_i[open_, k - 1] != _LONG
            need[open_[full]] = np.maximum(need[open_[full]], best_s[open_[full], k - 1].astype(np.float64))
        w, col = np.nonzero(best_i != _LONG)
        if len(w):
            out = np.clip(best_s[w, col], -_LONG, _LONG).astype(np.int64)
            ids = anchors.field("id").to_numpy()[of[w]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[w], ids, pid[w], pscore[w], best_i[w, col], out)], ["row", "id", "pid", "pscore", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                anchors, members = batch.column("anchors")[x].values, batch.column("candidates")[x].values
                norms = batch.column("norms")[x].values.to_numpy()
                c = {n: members.field(n).to_numpy() for n in ("row", "id", "label")} | {"v": _matrix(members.field("v"), kind)}
                for a in range(0, len(anchors), ANCHORS_AT_ONCE):
                    part = anchors.slice(a, ANCHORS_AT_ONCE)
                    lists = part.field("windows")
                    of = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                    windows = lists.flatten()
                    pid, pscore, least = (windows.field(n).to_numpy() for n in ("pid", "score", "least"))
                    yield from window_hits(part, of, pid, pscore, least, norms, c)

    return run


def _round(anchors: DataFrame, candidates: DataFrame, groups: int, run) -> DataFrame:
    """Meets blocks of anchors with the blocks of candidates that are long enough for one of them.

    Both sides shuffle: what is stored looks small enough to broadcast, while its blocks are not."""
    a = anchors.select("dim", F.col("first").alias("short"), F.col("members").alias("anchors"))
    a = a.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    member = F.struct((-F.col("norm")).alias("down"), "row", "id", "label", "v")
    c = candidates.groupBy("dim", "block").agg(F.max("norm").alias("long"), F.array_sort(F.collect_list(member)).alias("candidates"))
    bucket_tops = F.transform(F.filter("candidates", lambda _, i: i % BUCKET == 0), lambda x: -x["down"])
    c = c.withColumns({"norms": bucket_tops, "g": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")})
    met = a.join(c.hint("merge"), (a["dim"] == c["dim"]) & (a["g"] == c["g"]) & (c["long"] * SLACK >= a["short"]))
    return met.select("anchors", "norms", "candidates").mapInArrow(run, _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "pid", "pscore").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(anchors: DataFrame, candidates: DataFrame, sizes: dict, k: int, same: bool, low: int, high: int) -> DataFrame:
    """The k best of every window (array ``windows`` of pid, score) of ``anchors``, in two rounds."""
    run = _search(k, same, sizes["kind"], low, high)
    limit = F.lit(float("-inf")) if same else F.expr(f"cast(w.score as double) * {low} / 100")
    first = None
    for rows in (candidates.filter("long_ones"), candidates.filter("NOT long_ones")):
        state = anchors.select("row", "id", "label", "dim", "norm", "v", F.explode("windows").alias("w"))
        least = F.lit(float("-inf"))
        if first is not None:
            # rows in place of floors: one row a window that already has k hits
            kth = first.groupBy(F.col("row").alias("r"), F.col("pid").alias("p"), F.col("pscore").alias("s"))
            kth = kth.agg(F.min(F.col("score").cast("double")).alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
            state = state.join(kth, (F.col("row") == F.col("r")) & (F.col("w.pid") == F.col("p")) & (F.col("w.score") == F.col("s")), "left")
            least = F.coalesce(F.col("kth"), least)
        state = state.withColumn("w", F.struct("w.pid", "w.score", F.greatest(limit, least).alias("least")))
        state = state.groupBy("row").agg(
            *(F.first(x).alias(x) for x in ("id", "label", "dim", "norm", "v")),
            F.collect_list("w").alias("windows"),
            F.min(F.when(F.col("norm") > 0, F.col("w.least") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("short"),
        )
        met = _round(_blocks(state, _ANCHOR, "short", [F.col("dim"), F.col("short")], sizes["anchor_parts"]), rows, sizes["groups"], run)
        if first is None:
            first = save(_best(met, k).drop("rank"), "hits")
    out = save(_best(first.unionByName(met), k), "found")
    release(first)
    return out


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row with ``is_anchor`` (on
    column ``id``) and each of its ``positives`` best rows of its label, the best ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    every = save(prepared(vectors, id_col, vector_col, label, scale), "vectors")
    stats = every.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("dim").alias("dim"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    reach = (stats["norm"] or 0.0) ** 2 * 1.001
    rows_a_block = min(BLOCK_ROWS, max(BLOCK_SIZE // (stats["dim"] or 1), 1))
    blocks = -(-stats["n"] // rows_a_block) or 1
    # no more than keep all cores busy, and no blocks below a bucket: each group gets all anchors, each block hands on hits of its own
    least_parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-stats["n"] // BUCKET) or 1)
    sizes = {
        "kind": np.float32 if reach < 1 << 23 else np.float64 if reach < 1 << 52 else object,
        "anchor_parts": -(-stats["anchors"] // rows_a_block) or 1,
        "groups": max(-(-blocks // BLOCKS_TOGETHER), least_parts),
    }
    ranged = every.repartitionByRange(max(blocks, least_parts), "dim", F.desc("norm"), "row")
    ranged = save(ranged.withColumn("block", F.spark_partition_id()), "ranges")
    # the blocks of the longest sixteenth, for each length of vectors; one row a block
    tops = ranged.groupBy("dim", "block").agg(F.max("norm").alias("top"))
    cut = tops.groupBy("dim").agg(F.percentile_approx("top", 1 - 1 / 16).alias("cut"))
    tops = tops.join(cut, "dim").select("dim", "block", (F.col("top") >= F.col("cut")).alias("long_ones"))
    candidates = save(ranged.join(tops, ["dim", "block"]), "candidates")
    release(ranged)

    asked = every.filter(is_anchor)
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("pid"), F.lit(0).cast("long").alias("score")))
    near = _searched(asked.withColumn("windows", nothing), candidates, sizes, positives, True, low, high)
    windows = near.groupBy("row").agg(F.collect_set(F.struct(F.col("vec_id").alias("pid"), "score")).alias("windows"))
    far = _searched(asked.join(windows, "row"), candidates, sizes, negatives, False, low, high)
    # a positive that stands in the table twice is two positives
    times = near.groupBy(F.col("row"), F.col("vec_id").alias("pid"), F.col("score").alias("pscore")).agg(F.count("*").alias("times"))
    far = far.join(times, ["row", "pid", "pscore"]).withColumn("again", F.explode(F.expr("sequence(1L, times)")))
    return far.select(
        F.col("id").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score")
    )
