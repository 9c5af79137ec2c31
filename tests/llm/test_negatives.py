"""Hard negatives against brute force: norms of every size, ties, repeated ids, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, members string, dim int"


def brute(rows, scale=256, positives=5, negatives=10):
    import math

    use = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab, *_ in rows if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(use):
        if i % 100:
            continue
        others = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, w, other) in enumerate(use) if b != a and len(w) == len(v)]
        near = sorted(((s, j) for s, j, other in others if other == lab), key=lambda x: (-x[0], x[1]))[:positives]
        for ps, pid in near:
            fit = sorted(((s, j) for s, j, other in others if other != lab and 30 * ps <= 100 * s <= 90 * ps), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(i, pid, rank + 1, j, ps, s) for rank, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, **more)
    return sorted(tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(500):
        long = 2.0 ** r.randint(-6, 3)
        out.append((i * 10, [long * r.choice([-1, 0, 1, 1, 2]) * r.random() for _ in range(6)], r.choice([1, 1, 1, 2, 3])))
    out += [(100, [1.0] * 6, 1), (100, [1.0] * 6, 2), (7, [1.0] * 6, 2), (8, [1.0] * 6, 2), (8, [1.0] * 6, 2), (5, [1.0] * 6, 1), (5, [1.0] * 6, 1)]
    out += [(200, [0.0] * 6, 1), (300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1), (302, [0.5, 1.0], 2), (None, [1.0] * 6, 1), (400, None, 1), (500, [], 1)]
    return out + [(600, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (700, [float("nan")] * 6, 1), (800, [float("inf")] * 6, 1), (900, [1.0] * 6, None)]


def test_equals_brute_force_over_small_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 16)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 300


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(4)
    rows = [(i * 20, [float(r.randint(1 << 20, 1 << 22)) for _ in range(4)], i % 3) for i in range(40)]
    assert mined(spark, rows, scale=256) == brute(rows) != []


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_candidates_are_stored_row_by_row_and_meet_by_a_shuffle(spark, rows, monkeypatch):
    """No stored row holds a block (a reader's batch would hold thousands of them), and blocks are never broadcast."""
    stored, plans = {}, []
    save, met = hard_negatives.save, hard_negatives._round
    monkeypatch.setattr(hard_negatives, "save", lambda df, label: stored.setdefault(label, save(df, label)) if label == "candidates" else save(df, label))
    monkeypatch.setattr(hard_negatives, "_round", lambda *a: plans.append(met(*a)) or plans[-1])
    mined(spark, rows)
    assert stored["candidates"].dtypes and not any("struct" in kind for _, kind in stored["candidates"].dtypes)
    assert len(plans) == 4 and not any("BroadcastNestedLoop" in p or "BroadcastHashJoin [dim" in p for p in (x._jdf.queryExecution().executedPlan().toString() for x in plans))


def test_only_hits_that_reach_the_first_rounds_scores_are_handed_on():
    import numpy as np
    import pyarrow as pa

    members = pa.array([[{"row": i, "id": i, "label": 2, "v": [50 + i]} for i in range(20)]])
    anchors = pa.array([[{"row": 99, "id": 0, "label": 1, "norm": 10.0, "v": [10], "windows": [{"pid": 1, "score": 1000, "least": 670.0}]}]])
    batch = pa.RecordBatch.from_arrays([anchors, pa.array([[69.0]]), members], ["anchors", "norms", "candidates"])
    hits = [s for x in hard_negatives._search(10, False, np.float64, 30, 90)(iter([batch])) for s in x.column("score").to_pylist()]
    assert hits == [690, 680, 670]


def test_short_buckets_are_skipped(spark, monkeypatch):
    """Of buckets that fall in norm only those long enough for the windows are scored."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(hard_negatives, "BUCKET", 4)
    scored = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            scored.append(other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(hard_negatives, "_matrix", lambda lists, kind: lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(kind).view(Seen))
    lengths = [2.0 ** -(i // 4) * 100 for i in range(40)]
    members = pa.array([[{"row": i, "id": i, "label": 2, "v": [int(x), 0]} for i, x in enumerate(lengths)]])
    anchors = pa.array([[{"row": 99, "id": 0, "label": 1, "norm": 100.0, "v": [100, 0], "windows": [{"pid": 1, "score": 10000, "least": 3000.0}]}]])
    batch = pa.RecordBatch.from_arrays([anchors, pa.array([lengths[::4]]), members], ["anchors", "norms", "candidates"])
    hits = list(hard_negatives._search(10, False, np.float64, 30, 90)(iter([batch])))
    assert scored == [4, 4] and sum(x.num_rows for x in hits) == 4
