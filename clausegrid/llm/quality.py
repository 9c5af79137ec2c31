"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters of six bytes
slide over every position of a chunk; the maximum of each filter, with the chunk's length,
goes through a hidden layer; its mean and maximum over all chunks give one probability.

At most ``max_docs`` labelled texts of up to ``max_bytes`` bytes, half of each label as far
as there are, chosen by hash, train the network on the driver. Rows held out (CRC-32 of the
id as text modulo 4 is 2) are never learned from. Scoring is one narrow pass over whole
texts; the network's weights (about 110 kB, fixed) travel with the task.

Defined results: null and empty texts are scored as one chunk of padding; with labels of one
kind or none every score is that label's share, or 0.5; a null id stays null and is not held
out; ids with labels that contradict each other teach nothing; of several texts of a labelled id one
teaches, chosen by hash; repeated rows get equal scores; other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .common import byte_texts, documents, slices

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 512, 448, 6, 16, 16
MAX_DOCS, MAX_BYTES, STEPS, BATCH, THRESHOLD = 8000, 20_000, 600, 48, 0.7
#: Code of the padding behind a text.
PAD = 256
SPOTS = CHUNK - WIDTH + 1

Weights = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all chunks, bytes in each chunk, chunks per text)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    per = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    raw = np.r_[np.frombuffer(b"".join(texts), np.uint8), np.zeros(CHUNK, np.uint8)]
    text = np.repeat(np.arange(len(texts)), per)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    left = np.minimum(sizes[text] - place, CHUNK)
    begin = (np.cumsum(sizes) - sizes)[text] + place
    codes = np.lib.stride_tricks.as_strided(raw, (len(raw) - CHUNK + 1, CHUNK), (1, 1))[begin].astype(np.int32)
    codes[np.arange(CHUNK) >= left[:, None]] = PAD
    return codes, left, per


def _pair_tables(filters: np.ndarray) -> list[np.ndarray]:
    """Sums of two neighbouring byte weights, so a position takes three lookups."""
    return [(filters[j][:, None] + filters[j + 1][None]).reshape(-1, filters.shape[2]) for j in range(0, WIDTH, 2)]


def _convolved(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(position, chunk, filter)."""
    pairs = (codes[:, :-1] * (PAD + 1) + codes[:, 1:]).T
    out = tables[0][pairs[:SPOTS]]
    for j in range(1, len(tables)):
        out += tables[j][pairs[2 * j : 2 * j + SPOTS]]
    return out


def _head(w: Weights, most: np.ndarray, left: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, ...]:
    x = np.maximum(most + w["filter_bias"], 0)
    x = np.concatenate([x, np.log1p(left)[:, None].astype(np.float32) / 6], axis=1)
    hidden = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    first = np.cumsum(per) - per
    features = np.concatenate([np.add.reduceat(hidden, first, axis=0) / per[:, None], np.maximum.reduceat(hidden, first, axis=0)], axis=1)
    return x, hidden, features, features @ w["out"] + w["out_bias"]


def score(w: Weights, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 for every text."""
    if not texts:
        return np.zeros(0)
    tables = tables or _pair_tables(w["filters"])
    codes, left, per = chunks(texts)
    most = np.concatenate([_convolved(codes[i : i + 64], tables).max(axis=0) for i in range(0, len(codes), 64)])
    z = _head(w, most, left, per)[-1].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(w: Weights, texts: list[bytes], labels: np.ndarray) -> Weights:
    codes, left, per = chunks(texts)
    tables = _pair_tables(w["filters"])
    conv = [_convolved(codes[i : i + 64], tables) for i in range(0, len(codes), 64)]
    spot = np.concatenate([c.argmax(axis=0) for c in conv])
    most = np.concatenate([c.max(axis=0) for c in conv])
    x, hidden, features, z = _head(w, most, left, per)
    dz = ((1 / (1 + np.exp(-z)) - labels) / len(texts)).astype(np.float32)
    text = np.repeat(np.arange(len(texts)), per)
    df = dz[:, None] * w["out"]
    d_hidden = (df[:, :HIDDEN] / per[:, None])[text]
    top = features[:, HIDDEN:][text] == hidden
    d_hidden = (d_hidden + np.where(top, df[:, HIDDEN:][text], 0)) * (hidden > 0)
    dx = (d_hidden @ w["hidden"].T)[:, :FILTERS] * (x[:, :FILTERS] > 0)
    filters = np.zeros_like(w["filters"])
    row, column = np.arange(len(codes))[:, None], np.arange(FILTERS)
    for j in range(WIDTH):
        at = codes[row, spot + j] * FILTERS + column
        filters[j] = np.bincount(at.ravel(), dx.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
    return {"filters": filters, "filter_bias": dx.sum(0), "hidden": x.T @ d_hidden, "hidden_bias": d_hidden.sum(0), "out": features.T @ dz, "out_bias": dz.sum(keepdims=True)}


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> Weights:
    """Adam on batches with a third of texts of label 0."""
    rng = np.random.default_rng(seed)
    w: Weights = {
        "filters": rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)), "filter_bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)), "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["filters"][:, PAD] = 0
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(s, n) for s, n in zip(sides, (batch // 3, batch - batch // 3), strict=True)])
        for k, g in _gradients(w, [texts[i] for i in pick], labels[pick]).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            step = rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
            w[k] -= step.astype(np.float32)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> list[tuple[bytes, int]]:
    """At most ``max_docs`` texts with labels, none held out, in order of id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).filter("y = high").select("doc_id", "y")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [agreed.filter(F.col("y") == y).orderBy(*order).limit(max_docs // 2) for y in (0, 1)]
    short = docs.filter(F.octet_length("text") <= max_bytes)
    rows = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    return [(r["text"].encode(), r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def scorer(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES):
    """A function from texts to scores, trained on the labelled sample of ``docs`` (doc_id, text)."""
    sample = labelled_sample(docs, labels, max_docs, max_bytes)
    y = np.array([q for _, q in sample], np.float32)
    w = train([t for t, _ in sample], y) if len(set(y.tolist())) == 2 else None
    share = float(y.mean()) if len(y) else 0.5

    tables: list[np.ndarray] = []  # made where they are used: they are a hundred times the weights

    def scores(texts: list[bytes]) -> np.ndarray:
        if not w:
            return np.full(len(texts), share)
        tables.extend(_pair_tables(w["filters"]) if not tables else [])
        return score(w, texts, tables)

    return scores


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = documents(docs, id_col, text_col)
    scores = scorer(rows, labels, max_docs, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores(byte_texts(part)))], ["doc_id", "held_out", "score"])

    out = rows.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rows that the classifier rejects: one narrow pass."""
    scores = scorer(documents(docs, id_col, text_col), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text__", 1 << 20):
                yield part.select([0]).filter(pa.array(scores(byte_texts(part, "__text__")) >= threshold))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc__"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text__"))
    return rows.mapInArrow(run, Ty.StructType([Ty.StructField("__doc__", docs.schema)])).select("__doc__.*")
