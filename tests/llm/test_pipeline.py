"""The classifier's network and the whole pipeline against plain versions that share no code with them."""

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from clausegrid.llm import bpe, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_score(w, text):
    """Probability of label 1, chunk by chunk and position by position."""
    size, hidden, at = len(text), [], 0
    while True:
        chunk = text[at : at + quality.CHUNK]
        codes = list(chunk) + [quality.PAD] * (quality.CHUNK - len(chunk))
        most = np.max([sum(w["filters"][j][codes[p + j]] for j in range(quality.WIDTH)) for p in range(quality.SPOTS)], axis=0)
        x = np.append(np.maximum(most + w["filter_bias"], 0), math.log1p(len(chunk)) / 6)
        hidden.append(np.maximum(x @ w["hidden"] + w["hidden_bias"], 0))
        if at + quality.CHUNK >= size:
            break
        at += quality.STRIDE
    z = float(np.r_[np.mean(hidden, axis=0), np.max(hidden, axis=0)] @ w["out"] + w["out_bias"][0])
    return 1 / (1 + math.exp(-z))


def some_weights(seed):
    r = np.random.default_rng(seed)
    shapes = {"filters": (quality.WIDTH, quality.PAD + 1, quality.FILTERS), "filter_bias": (quality.FILTERS,), "hidden": (quality.FILTERS + 1, quality.HIDDEN), "hidden_bias": (quality.HIDDEN,), "out": (2 * quality.HIDDEN,), "out_bias": (1,)}
    return {k: r.normal(0, 0.2, s) for k, s in shapes.items()}


def some_texts(seed, sizes):
    r = random.Random(seed)
    return [bytes(r.choice(b"abc \n#\xc3\xa9") for _ in range(n)) for n in sizes]


def test_scores_equal_a_plain_network():
    w = some_weights(3)
    texts = some_texts(4, (0, 1, 5, 6, 511, 512, 513, 960, 961, 3000, 40_000))
    assert quality.score(w, texts) == pytest.approx([plain_score(w, t) for t in texts], abs=1e-6)


def test_classifier_gradients():
    w, texts, y = some_weights(5), some_texts(6, (0, 40, 600, 1500)), np.array([1.0, 0.0, 1.0, 0.0])
    g = quality._gradients(w, texts, y)

    def loss():
        p = quality.score(w, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k in w:
        for i in [np.unravel_index(np.abs(g[k]).argmax(), g[k].shape), tuple(0 for _ in g[k].shape)]:
            w[k][i] += 1e-5
            up = loss()
            w[k][i] -= 2e-5
            down = loss()
            w[k][i] += 1e-5
            assert g[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-5), k


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_survivors(rows):
    prints = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if x == old else x for x in group]
    keep = {}
    for g, row in zip(group, rows, strict=True):
        keep[g] = min(keep.get(g, row), row, key=lambda x: x[0])
    return list(keep.values())


def copies_taken(rows):
    """How often every document is taken: targets filled step by step, sources read one after another."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    have = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target, left, still = {}, sum(have.values()), set(names)
    while still:
        level = left / sum(weight[s] for s in still)
        full = {s for s in still if weight[s] * level > 3 * have[s]}
        for s in full or still:
            target[s] = 3 * have[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        still = still - full if full else set()
    out = Counter()
    for s in names:
        before = 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:8], i)):
            if size[i]:
                out[i] = min(3, max(0, math.floor((target[s] - before - size[i] / 2) / have[s]) + 1))
            before += size[i]
    return +out


def test_pipeline_equals_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf, r = tempfile.mkdtemp(prefix="spark-"), random.Random(17)
    word = lambda: "".join(r.choice(["an", "the", "in", "or", "es", "Qu"]) for _ in range(r.randint(1, 4)))
    clean = [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(70)] + [" ".join(word() for _ in range(6000))]
    sources = ["web", "books", None, "a", "web"]
    rows = [(1000 + i, t, sources[i % 5]) for i, t in enumerate(clean)]
    rows += [(2000 + i, " ".join(x + "###" for x in t.split()), "web") for i, t in enumerate(clean[:40])]
    rows += [(500 + i, clean[3 * i].replace(" ", "\n\t"), "books") for i in range(6)] + [(3000 + i, clean[7].replace(" ", "  "), "a") for i in range(9)]
    rows += [(4000 + i, clean[70] + f" end{i}", "books") for i in range(4)] + [(5000, None, None), (5001, "", "a"), (5002, " \n", "a")]
    r.shuffle(rows)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t, _ in rows if t], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    sample = quality.labelled_sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    w = quality.train([t for t, _ in sample], np.array([y for _, y in sample], np.float32))
    good = [x for x in rows if plain_score(w, (x[1] or "").encode()) >= 0.7]
    assert {i for i, _, _ in good} >= set(range(1000, 1070)) and not {i for i, _, _ in good} & set(range(2000, 2040))
    firsts = {}
    for x in sorted(good, key=lambda x: x[0]):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or ""), x)
    left = near_survivors(list(firsts.values()))
    assert len(left) < len(firsts) < len(good) < len(rows)
    copies, texts = copies_taken(left), {i: t for i, t, _ in left}

    library = bpe.encoder(bpe.default_path()).library
    ids = {i: np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4") for i in copies}
    covered, sequences = {}, {}
    for x in pipeline.run(spark, sf).collect():
        i, a, n = x["doc_id"], x["start"], x["length"]
        assert x["doc_tokens"] == len(ids[i]) and x["ids_crc32"] == zlib.crc32(ids[i][a : a + n].tobytes())
        covered.setdefault(i, np.zeros(len(ids[i]), int))[a : a + n] += 1
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], n))
    assert {i: set(x.tolist()) for i, x in covered.items()} == {i: {n} for i, n in copies.items()}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = f"file://{tmp_path}"
    long = "word " * 60_000 + "end"
    rows = [(1, long), (1, long), (1, "another text of one"), (None, "x y z"), (None, None), (2, ""), (3, " \n "), (None, "x y z"), (4, "x  y z")]
    names = ["source", "lang", "kept", "digest", "size", "target", "key", "fp", "score", "row", "positions", "before", "n"]
    docs = spark.createDataFrame([(i, t, *["s"] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{x} string" for x in names))
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    counts = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        nothing = stage(spark, docs.limit(0), sf)
        assert nothing.count() == 0
        if name != "packing":
            assert out.columns == docs.columns == nothing.columns
            docs = out
            counts.append(sorted((x["doc_id"] is None, x["doc_id"] or 0, len(x["text"] or "")) for x in docs.collect()))
    assert len(counts[0]) == len(rows)  # labels of one kind: all are good
    # the long text once, "another", one of x y z (the smallest id stays), one empty text, one blank
    assert counts[1] == [(False, 1, 19), (False, 1, len(long)), (False, 2, 0), (False, 3, 3), (False, 4, 6)]
    assert counts[2] == [(False, 1, 19), (False, 1, len(long)), (False, 2, 0), (False, 4, 6)]  # no words at all: one fingerprint
    assert counts[3] == [(False, 1, 19), (False, 1, len(long)), (False, 4, 6)]  # what has no words is never taken
    assert {x["doc_id"] for x in out.collect()} == {1, 4} and sum(x["length"] for x in out.collect()) == 60_001 + 1 + 4 + 1 + 3 + 1
