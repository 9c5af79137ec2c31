"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network, trained in numpy on all documents, predicts every word from
two words on either side; a document's score is the sum of these log-probabilities.

1. Words: lower-cased, named by 64-bit hashes. The corpus's most frequent words (counted
   over all documents) get tokens of their own, others share tokens by hash. Token ids are
   written once (two bytes a word) and read for training and for scoring; with them stand
   the names of the words that share a token.
2. Network: an embedding table per window place, summed, tanh, then a two-step softmax
   (class, then word in class), so a prediction costs 2 * 32 logits instead of 1024.
   Output biases start at the corpus's log frequencies.
3. Training: documents are dealt by hash to shards of about ``SHARD_WORDS`` words, as many as the
   corpus fills. Adagrad runs once over each shard's words in order of the texts' hashes, from the
   same start, so weights do not depend on how the table is split. The shards' weights are averaged
   by words seen: summed in every task, then block by block over all tasks. The driver only ever
   holds one set of weights (about 84,000 numbers, fixed).
4. Scoring: one narrow pass with the averaged weights. A word that shares its token has
   P(token | both sides) * P(word | token), the second factor being its part of the token's
   count in the corpus. The table of these counts has a row for every distinct word and is
   joined in Spark, so every counted word has a probability of its own at any size.

Defined results: null and empty texts have no words, log_prob 0 and a null mean; a null id
stays null; repeated rows get equal scores (but for rounding), and those of one id teach once; other columns are
ignored; a very long text is scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, distinct_runs, documents, release, save, slices

VOCABULARY, SIDE, DIM, WINDOW = 1024, 32, 16, (-2, -1, 1, 2)
#: Tokens that rare words share; the last token stands for places outside the text.
SHARED = 63
OUTSIDE = VOCABULARY - 1
KNOWN = VOCABULARY - SHARED - 1
BATCH, RATE, BLOCK = 8192, 0.1, 4096
SHARD_WORDS = 1 << 22
#: Logarithms of counts are summed as integers of this unit, so that equal texts get equal sums.
UNIT = 1 << 24
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
SHAPES = {"embed": (len(WINDOW), VOCABULARY, DIM), "class": (DIM, SIDE), "class_bias": (SIDE,), "word": (SIDE, DIM, SIDE), "word_bias": (SIDE, SIDE)}

Weights = dict[str, np.ndarray]


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word as int64, words per text)."""
    raw = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    white = _WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    words, which = distinct_runs(raw[~white], end - start)
    name = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[which]
    begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return name.view(np.int64), np.diff(np.searchsorted(start, begins))


def tokens(names: np.ndarray, known: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Token of every word; ``known`` is sorted."""
    shared = KNOWN + (names.view(np.uint64) >> np.uint64(20)) % np.uint64(SHARED)
    if not len(known):
        return shared.astype(np.int64)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, token[at], shared.astype(np.int64))


def windows(ids: np.ndarray, per: np.ndarray) -> np.ndarray:
    """(place, word): the tokens around every word of its own text."""
    text = np.repeat(np.arange(len(per)), per)
    out = np.full((len(WINDOW), len(ids)), OUTSIDE, np.uint16)
    for k, d in enumerate(WINDOW):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        out[k, a] = np.where(text[a] == text[b], ids[b], OUTSIDE)
    return out


def start_weights(counts: np.ndarray, seed: int = 11) -> Weights:
    """``counts``: of every token in the corpus."""
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.05, s) for k, s in SHAPES.items()}
    p = (counts + 1.0).reshape(SIDE, SIDE)
    w["word_bias"] = np.log(p / p.sum(1, keepdims=True))
    w["class_bias"] = np.log(p.sum(1) / p.sum())
    return {k: v.astype(np.float32) for k, v in w.items()}


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its row sums; rows are shifted in place where exp would overflow."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e, e.sum(axis=1)


def log_probs(w: Weights, around: np.ndarray, ids: np.ndarray, gradients: Weights | None = None) -> np.ndarray:
    """Log-probability of every word. With ``gradients`` also the loss's gradients: sums for the
    output layers, and under "input" those of every word's summed embedding."""
    h = w["embed"][0][around[0]]
    for k in range(1, len(WINDOW)):
        h += w["embed"][k][around[k]]
    np.tanh(h, out=h)
    klass, word = (ids // SIDE).astype(np.uint8), ids % SIDE
    order = np.argsort(klass, kind="stable")
    edges = np.searchsorted(klass[order], np.arange(SIDE + 1))
    h, klass, word = h[order], klass[order], word[order]  # words of a class stand together
    row = np.arange(len(ids))
    z = h @ w["class"] + w["class_bias"]
    e, total = _exp(z)
    sorted_out = z[row, klass] - np.log(total)
    if gradients is not None:
        e /= total[:, None]
        e[row, klass] -= 1
        gradients["class"], gradients["class_bias"] = h.T @ e, e.sum(0)
        dh = e @ w["class"].T
        gradients["word"], gradients["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
    for c in range(SIDE):
        at = slice(edges[c], edges[c + 1])
        if at.start == at.stop:
            continue
        hc, wc, rc = h[at], word[at], row[: at.stop - at.start]
        z = hc @ w["word"][c] + w["word_bias"][c]
        e, total = _exp(z)
        sorted_out[at] += z[rc, wc] - np.log(total)
        if gradients is not None:
            e /= total[:, None]
            e[rc, wc] -= 1
            gradients["word"][c], gradients["word_bias"][c] = hc.T @ e, e.sum(0)
            dh[at] += e @ w["word"][c].T
    out = np.empty_like(sorted_out)
    out[order] = sorted_out
    if gradients is not None:
        dh *= 1 - h * h
        gradients["input"] = np.empty_like(dh)
        gradients["input"][order] = dh
    return out


def _step(w: Weights, squares: Weights, around: np.ndarray, ids: np.ndarray) -> None:
    g: Weights = {}
    log_probs(w, around, ids, g)
    for k in ("class", "class_bias", "word", "word_bias"):
        g[k] /= len(ids)
        squares[k] += g[k] * g[k]
        w[k] -= RATE * g[k] / (np.sqrt(squares[k]) + 1e-4)
    for k in range(len(WINDOW)):  # only the rows that occur
        order = np.argsort(around[k], kind="stable")
        found = around[k][order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        row, sums = found[first], np.add.reduceat(g["input"][order], first, axis=0) / np.float32(len(ids))
        squares["embed"][k][row] += sums * sums
        w["embed"][k][row] -= RATE * sums / (np.sqrt(squares["embed"][k][row]) + 1e-4)


def _tokenize(batches: Iterator[pa.RecordBatch], known: np.ndarray, token: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            names, per = word_names(byte_texts(part))
            ids = tokens(names, known, token)
            ends = np.cumsum(per)
            rare = ids >= KNOWN
            rare_ends = np.r_[0, np.cumsum(rare)][ends]
            columns = [_cut(ids.astype("<u2").tobytes(), 2 * ends), _cut(names[rare].astype("<i8").tobytes(), 8 * rare_ends)]
            keys = list(zip(part.column("doc_id").to_pylist(), part.column("hash").to_pylist(), strict=True))
            seen: set[tuple[int | None, int]] = set()
            teaches = pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "hash")), *columns, teaches], ["rid", "doc_id", "hash", "tokens", "rare", "teaches"])


def _cut(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.array([data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often every document has each of its words that share a token."""
    for batch in batches:
        for part in slices(batch, "rare", 1 << 22):
            texts = byte_texts(part, "rare")
            names, row = np.frombuffer(b"".join(texts), "<i8"), np.repeat(np.arange(len(texts)), [len(x) // 8 for x in texts])
            order = np.lexsort((names, row))
            names, row = names[order], row[order]
            first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (row[1:] != row[:-1])][: len(names)])
            rid = part.column("rid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array(rid[row[first]]), pa.array(np.diff(np.r_[first, len(names)]), pa.int64())], ["name", "rid", "times"])


def _token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "tokens", 1 << 19):
            texts = byte_texts(part, "tokens")
            yield part, np.frombuffer(b"".join(texts), "<u2").astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts)) // 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            names, n = np.unique(word_names(byte_texts(part))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], ["name", "n"])


class _Shard:
    """Training on one shard, in steps of BATCH words whatever pieces they come in."""

    def __init__(self, start: Weights):
        self.w = {k: v.copy() for k, v in start.items()}
        self.squares = {k: np.full(s, 1e-4, np.float32) for k, s in SHAPES.items()}
        self.ids, self.around, self.seen = np.zeros(0, np.int64), np.zeros((len(WINDOW), 0), np.uint16), 0

    def learn(self, ids: np.ndarray, per: np.ndarray, last: bool = False) -> None:
        ids, around = np.r_[self.ids, ids], np.concatenate([self.around, windows(ids, per)], axis=1)
        end = len(ids) if last else len(ids) // BATCH * BATCH
        for i in range(0, end, BATCH):
            _step(self.w, self.squares, around[:, i : min(i + BATCH, end)], ids[i : min(i + BATCH, end)])
        self.seen += end
        self.ids, self.around = ids[end:], around[:, end:]

    def close(self) -> tuple[int, np.ndarray]:
        """(words seen, weights times words seen)."""
        self.learn(np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)
        return self.seen, np.concatenate([self.w[k].ravel() for k in SHAPES]).astype(np.float64) * self.seen


def _train(batches: Iterator[pa.RecordBatch], start: Weights) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard, hash, id. The task's sum of its shards' weights."""
    seen, total = 0, np.zeros(sum(v.size for v in start.values()))
    shard, at, before = None, -1, None
    for batch in batches:
        for part in slices(batch, "tokens", 1 << 19):
            texts = byte_texts(part, "tokens")
            rows = list(zip(part.column("shard").to_pylist(), part.column("hash").to_pylist(), part.column("doc_id").to_pylist(), strict=True))
            fresh = [i for i, r in enumerate(rows) if r != (rows[i - 1] if i else before)]
            before = rows[-1]
            for s in dict.fromkeys(rows[i][0] for i in fresh):
                mine = [texts[i] for i in fresh if rows[i][0] == s]
                if s != at:
                    if shard:
                        n, flat = shard.close()
                        seen, total = seen + n, total + flat
                    shard, at = _Shard(start), s
                shard.learn(np.frombuffer(b"".join(mine), "<u2").astype(np.int64), np.fromiter(map(len, mine), np.int64, len(mine)) // 2)
    if shard:
        n, flat = shard.close()
        seen, total = seen + n, total + flat
    if seen:
        yield _weight_rows({i: (seen, total[i : i + BLOCK]) for i in range(0, len(total), BLOCK)})


def _weight_rows(blocks: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([n for n, _ in blocks.values()], pa.int64()), pa.array([x for _, x in blocks.values()], pa.list_(pa.float64()))], ["first", "seen", "part"])


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for first, seen, part in zip(batch.column("first").to_pylist(), batch.column("seen").to_pylist(), batch.column("part"), strict=True):
            n, x = sums.get(first, (0, 0.0))
            sums[first] = n + seen, x + part.values.to_numpy()
    yield _weight_rows(sums)


def _score(batches: Iterator[pa.RecordBatch], w: Weights, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``share``: added for every token; minus the log of its count where words share it."""
    for part, ids, per in _token_runs(batches):
        around = windows(ids, per)
        found = [log_probs(w, around[:, i : i + BATCH], ids[i : i + BATCH]) + share[ids[i : i + BATCH]] for i in range(0, len(ids), BATCH)]
        sums = np.r_[0, np.cumsum(np.concatenate(found), dtype=np.float64)] if found else np.zeros(1)
        ends = np.cumsum(per)
        total = sums[ends] - sums[ends - per]
        yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(per), pa.array(total)], ["rid", "doc_id", "n_words", "total"])


def _unflatten(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def tokenized(docs: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(rid, doc_id, tokens (binary, two bytes each), rare (names of the words that share a token, eight bytes each),
    written once; the corpus's count of every token; that of every word)."""
    texts = docs.select("text")
    counts = save(texts.mapInArrow(_count_words, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "name").limit(KNOWN).collect()
    shared = F.pmod(F.shiftrightunsigned("name", 20), F.lit(SHARED)).cast("int")
    rest = {r["shared"]: r["n"] for r in counts.groupBy(shared.alias("shared")).agg(F.sum("n").alias("n")).collect()}
    names = np.array([r["name"] for r in top], np.int64)
    order = np.argsort(names)
    known, token = names[order], order.astype(np.int64)
    every = np.zeros(VOCABULARY)
    every[: len(top)] = [r["n"] for r in top]
    for s, n in rest.items():
        every[KNOWN + s] = n
    for r in top:
        every[KNOWN + (r["name"] % (1 << 64) >> 20) % SHARED] -= r["n"]
    rows = docs.withColumns({"rid": F.monotonically_increasing_id(), "hash": F.xxhash64("text")}).mapInArrow(partial(_tokenize, known=known, token=token), "rid long, doc_id long, hash long, tokens binary, rare binary, teaches boolean")
    return save(rows, "tokens"), every, counts


def fit(rows: DataFrame, counts: np.ndarray) -> Weights:
    """Weights from all of ``rows`` (doc_id, hash, tokens, teaches)."""
    start = start_weights(counts)
    shards = max(1, -(-int(counts.sum()) // SHARD_WORDS))
    dealt = rows.filter("teaches").select(F.pmod(F.xxhash64("hash", "doc_id"), F.lit(shards)).alias("shard"), "hash", "doc_id", "tokens")
    trained = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "hash", "doc_id").mapInArrow(partial(_train, start=start), "first long, seen long, part array<double>")
    flat = np.concatenate([start[k].ravel() for k in SHAPES])
    blocks = save(trained.repartition(F.col("first")).mapInArrow(_add_weights, "first long, seen long, part array<double>"), "weights")  # the shuffled tokens go here
    for r in blocks.collect():
        flat[r["first"] : r["first"] + len(r["part"])] = np.array(r["part"]) / r["seen"]
    release(blocks)
    return _unflatten(flat)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over words), mean_log_prob."""
    rows, counts, words = tokenized(documents(docs, id_col, text_col))
    share = np.zeros(VOCABULARY)
    share[KNOWN:OUTSIDE] = -np.log(np.maximum(counts[KNOWN:OUTSIDE], 1))
    scored = rows.select("rid", "doc_id", "tokens").mapInArrow(partial(_score, w=fit(rows, counts), share=share), "rid long, doc_id long, n_words long, total double")
    logs = words.filter("n > 1").select("name", F.round(F.log("n") * UNIT).cast("long").alias("log_n"))  # the log of 1 adds nothing
    rare = rows.select("rid", "rare").mapInArrow(_rare_words, "name long, rid long, times long")
    more = rare.join(logs.hint("shuffle_hash"), "name").groupBy("rid").agg((F.sum(F.col("times") * F.col("log_n")) / UNIT).alias("more"))
    out = scored.join(more, "rid", "left").withColumn("log_prob", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
