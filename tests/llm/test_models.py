"""Token counts, packing, language model, classifier, search, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import bpe, lm_score, mixing, packing, quality, simhash, token_counts, topk_search

ODD = [
    "", None, " ", "Hello  World's <|endoftext|> don't a<|startoftext|>b  x\x1cy!\x1c! naïve café ΣΑΣ ÉCOLE 北京 123 ½²", "a b", "aaaaaaaaaaaaaaaa",
    "é ã", "I'LL WE'VE 'tis ''s !'s", "\t\r\n", "ſt ŉ ĳ ǆ İstanbul", "🙂🙂 a", "..!!??-- _x_", "à b", "x’s “quote” y", "don't 're rex 'l", "word " * 3000,
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["the", "in", "ing", "ér", "un", "Sch", "tion", ".", ",", "9"]) for _ in range(r.randint(1, 4)))
    return ODD + [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(40)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens string, n long")


def test_counts_equal_the_library(spark, texts):
    library = bpe.encoder(bpe.default_path()).library
    got = {x["doc_id"]: x for x in token_counts.count_tokens(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_ids_equal_the_library_in_small_blocks(texts, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 500)
    enc = bpe.Encoder(bpe.default_path())
    ids, counts = enc.encode([(t or "").encode() for t in texts])
    want = [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_ids_of_words_that_polynomial_hashes_confuse():
    enc = bpe.Encoder(bpe.default_path())
    for n, a, b in ((1024, "e", "x"), (2048, "e", "x"), (2048, "q", "i"), (1024, "t", "z")):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        pair = ["".join(a if x else b for x in bits), "".join(b if x else a for x in bits)]
        for texts in (pair, pair[::-1], [" ".join(pair)]):
            ids, counts = enc.encode([t.encode() for t in texts])
            want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_ids_of_texts_in_other_alphabets_equal_the_library():
    r = random.Random(31)
    letters = ["αβγδεΣςΰ", "абвгдЙй", "北京大学", "한국어", "देवनागरी", "אבגד", "éèêñß", "e\u0301a\u0308", "İıſŉ", "ΆΈ", "🙂🏽", "٣४①Ⅷ", "\u2028\x85\x1c", "'s<|", "_-—…", "ǅǲ", "ﬁﬂ"]
    enc = bpe.Encoder(bpe.default_path())
    texts = [" ".join("".join(r.choice(r.choice(letters)) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 12))) for _ in range(600)]
    ids, counts = enc.encode([t.encode() for t in texts])
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (7, "a b"), (7, "a b"), (7, "c " * 5000)]
    docs = spark.createDataFrame([(*x, 1, True, 0.5) for x in rows], "doc_id long, text string, start int, held_out boolean, score double")
    counted = [(x["doc_id"], x["n_tokens"]) for x in token_counts.count_tokens(docs).collect()]
    assert sorted(counted, key=str) == sorted([(None, 3), (None, 3), (None, 0), (7, 2), (7, 2), (7, 5000)], key=str)
    pieces = packing.pack(docs).collect()
    assert sum(x["length"] for x in pieces if x["doc_id"] is None) == 4 + 4 + 1 and sum(x["length"] for x in pieces if x["doc_id"] == 7) == 3 + 3 + 5001


def test_packing_is_an_exact_round_trip(spark, texts):
    library = bpe.encoder(bpe.default_path()).library
    rows = packing.pack(frame(spark, texts), with_ids=True).collect()
    docs, room = {}, {}
    for x in sorted(rows, key=lambda x: (x["doc_id"], x["start"])):
        assert x["start"] == len(docs.setdefault(x["doc_id"], [])) and x["length"] == len(x["ids"])
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        docs[x["doc_id"]] += x["ids"]
        room.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for i, t in enumerate(texts):
        assert docs[i] == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    for pieces in room.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # full or a power of two: nothing is padded
    assert all(x["doc_tokens"] == len(docs[x["doc_id"]]) for x in rows)


def test_costs_are_balanced():
    lengths = np.array([1 + i * 37 % 900 for i in range(400)])
    pieces = packing.assign(lengths)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    full = [c for s, c in cost.items() if s < lengths.sum() // 2048]
    assert max(full) < 1.4 * np.mean(full)


def test_language_model(spark):
    r = random.Random(3)
    fluent = lambda: " ".join(f"the {r.choice(['cat', 'dog'])} sat on the {r.choice(['mat', 'rug'])} ." for _ in range(40))
    rows = [fluent() for _ in range(60)]
    shuffled = rows[0].split()
    r.shuffle(shuffled)
    rows += [" ".join(shuffled), None, ""]
    got = {x["doc_id"]: x for x in lm_score.score(frame(spark, rows)).collect()}
    assert got[0]["mean_log_prob"] > got[60]["mean_log_prob"]
    assert got[61]["n_words"] == 0 and got[61]["log_prob"] == 0 and got[61]["mean_log_prob"] is None
    assert got[5]["n_words"] == len(rows[5].split()) and got[5]["log_prob"] < 0
    assert lm_score.score(frame(spark, [])).count() == 0


def test_scores_do_not_depend_on_how_the_table_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 3000)
    r = random.Random(13)
    texts = [" ".join(r.choice("one two three four five six seven".split()) for _ in range(r.randint(0, 90))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 20 + [(None, texts[7])] * 20 + [(None, None), (9, "long " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (str(x["doc_id"]), x["n_words"])
    two, eight = (sorted(lm_score.score(docs.repartition(n)).collect(), key=key) for n in (2, 8))
    assert len(two) == len(rows) == len(eight)
    assert all(a["log_prob"] == pytest.approx(b["log_prob"], rel=1e-5, abs=1e-6) for a, b in zip(two, eight))
    same = {x["log_prob"] for x in two if x["doc_id"] == 5}
    assert max(same) - min(same) < 1e-5


def test_scores_equal_a_plain_sum_over_words(spark):
    """The network's formula word by word, and the share of words that have a token together."""
    r = random.Random(14)
    vocabulary = [f"v{i}" for i in range(1200)]
    texts = [" ".join(r.choice(vocabulary[: 40 if k % 2 else 1200]) for _ in range(r.randint(1, 60))) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, counts, words = lm_score.tokenized(lm_score.documents(docs))
    w = {k: v.astype(float) for k, v in lm_score.fit(rows, counts).items()}
    n_of = {x["name"]: x["n"] for x in words.collect()}
    ids_of = {x["doc_id"]: np.frombuffer(x["tokens"], "<u2").astype(int) for x in rows.collect()}
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = {x["doc_id"]: x for x in lm_score.score(docs).collect()}
    for i in range(0, 200, 20):
        ids, names = ids_of[i], lm_score.word_names([texts[i].encode()])[0].tolist()
        total = 0.0
        for at, (t, name) in enumerate(zip(ids, names)):
            around = [ids[at + d] if 0 <= at + d < len(ids) else lm_score.OUTSIDE for d in lm_score.WINDOW]
            h = np.tanh(sum(w["embed"][k][a] for k, a in enumerate(around)))
            c, j = divmod(t, lm_score.SIDE)
            p = softmax(h @ w["class"] + w["class_bias"])[c] * softmax(h @ w["word"][c] + w["word_bias"][c])[j]
            total += np.log(p) + (np.log(n_of[name] / counts[t]) if t >= lm_score.KNOWN else 0)
        assert got[i]["n_words"] == len(ids) and got[i]["log_prob"] == pytest.approx(total, rel=1e-4)


def test_rare_words_have_their_own_probability(spark):
    names = [f"q{i}" for i in range(300)]
    shared = (lm_score.word_names([" ".join(names).encode()])[0].view(np.uint64) >> np.uint64(20)) % np.uint64(lm_score.SHARED)
    same = [x for x, s in zip(names, shared) if s == shared[0]][:3]  # three words of one token
    frequent = " ".join(f"w{i} " * 9 for i in range(1000))
    got = {x["doc_id"]: x for x in lm_score.score(frame(spark, [frequent, same[0], same[1], same[1], *[same[2]] * 5])).collect()}
    one, two, five = (got[i]["log_prob"] for i in (1, 2, 4))
    assert got[2]["log_prob"] == got[3]["log_prob"]
    assert two - one == pytest.approx(np.log(2), abs=1e-6) and five - one == pytest.approx(np.log(5), abs=1e-6)


def test_language_model_gradients():
    r = np.random.default_rng(0)
    w = {k: r.normal(0, 0.3, s) for k, s in lm_score.SHAPES.items()}
    ids = r.integers(0, lm_score.VOCABULARY, 50)
    around = lm_score.windows(ids, np.array([20, 30]))
    assert around[0, 20] == lm_score.OUTSIDE and around[2, 19] == lm_score.OUTSIDE
    g = {}
    lm_score.log_probs(w, around, ids, g)
    back = np.zeros_like(w["embed"])
    for k in range(len(lm_score.WINDOW)):
        np.add.at(back[k], around[k], g["input"])
    g["embed"] = back
    for k in ("class", "class_bias", "word", "word_bias", "embed"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][i] += 1e-5
        up = -lm_score.log_probs(w, around, ids).sum()
        w[k][i] -= 2e-5
        down = -lm_score.log_probs(w, around, ids).sum()
        w[k][i] += 1e-5
        assert g[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_classifier(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    texts, y = [], []
    for i in range(240):
        t = [word() for _ in range(r.randint(20, 200))]
        y.append(i % 3 != 0)
        texts.append(" ".join(t) if y[-1] else " ".join(x + "$$$" for x in t))
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)] + [(None, 1, 0), (7000, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values()) and len(got) == 242
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.5}
    # Labels that contradict each other teach nothing: with only such ones there is no model.
    both = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert {x["score"] for x in quality.classify(docs.unionByName(docs), both).collect()} == {0.5}
    kept = quality.keep_good(docs.unionByName(docs), labels)
    want = sorted(str(i) for i, x in got.items() if x["predicted"]) * 2
    assert kept.columns == docs.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(want)


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        codes, left, per = quality.chunks([b"x" * n])
        ends = [k * quality.STRIDE + m for k, m in enumerate(left.tolist())]
        assert per[0] == len(codes) and ends[-1] == n and (codes < quality.PAD).sum(1).tolist() == left.tolist()


def test_blocks_of_vectors_are_never_broadcast(spark, tmp_path):
    """Stored vectors are a small file; all their blocks, once for each block of the other side, are not."""
    path = str(tmp_path / "vectors")
    spark.range(50).selectExpr("id AS row", "id", "array(id, 1L) AS v", "0L AS lo", "10L AS need").write.parquet(path)
    rows = spark.read.parquet(path)
    plan = topk_search._pairs(rows, rows, 2, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_top_k(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(700, 8))
    m[300:420] = m[5]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(700, None), (800, [1.0, None] + [0.0] * 6), (900, [float("nan")] + [0.0] * 7), (1000, [float("inf")] + [0.0] * 7), (None, [0.0] * 8)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    ints = np.floor(m * 1024).astype(np.int64)
    want = set()
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        ids = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(ids)}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got} == want
    # Rows of one id are candidates of each other; empty vectors take no part; huge components have a result.
    odd = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [1e9, 1e9]), (2, [-1e300, 1.0]), (3, []), (4, [0.5, 0.5])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    exact = [[max(-(1 << 63), min((1 << 63) - 1, int(np.floor(1024 * c)) if abs(c) < 1e15 else (1 << 63) * (1 if c > 0 else -1))) for c in v] for _, v in odd]
    clip = lambda n: max(1 - (1 << 63), min((1 << 63) - 1, n))
    want = []
    for q in (0, 1):
        s = sorted(((-clip(sum(x * y for x, y in zip(exact[q], exact[i]))), odd[i][0]) for i in (0, 1, 2, 3, 5) if i != q and odd[i][1]))
        want += [(0, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    found = topk_search.top_k(table, F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    # Scores between 2^61 and 2^63 keep their value; columns of a table may be named like the operator's own.
    large = [(i, [float(x << 15), float(y << 15)]) for i, (x, y) in enumerate([(3, 1), (900, 5), (1000, 1), (-2000, 0), (1024, 2), (700, -9), (2, 2)])]
    wide = spark.createDataFrame([(i, v, 1, "x", 2, [3], 4) for i, v in large], "vec_id long, embedding array<double>, row int, id string, lo int, v array<int>, need int")
    got = topk_search.top_k(wide, F.col("id") % 100 == 0).orderBy("rank").collect()
    whole = sorted((-(sum(int(x) * 1024 * int(y) * 1024 for x, y in zip(large[0][1], v))), i) for i, v in large[1:])
    assert [(x["score"], x["vec_id"]) for x in got] == [(-n, i) for n, i in whole] and got[0]["score"] > 1 << 61
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert [(x["rank"], x["vec_id"]) for x in topk_search.top_k(few, F.col("id") % 100 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk_search.top_k(few.limit(0), F.col("id") % 100 == 0).count() == 0


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 60)) if i % 17 else None, "a" if i < 2000 else r.choice(["b", "c", None]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(docs).collect()
    total = sum(x["size"] for x in got)
    per = {}
    for x in got:
        s = per.setdefault(x["source"], [x["source_size"], x["target"], 0, 0])
        s[2] += x["taken"]
        s[3] = max(s[3], x["size"])
        assert x["taken"] in (0, x["size"], 2 * x["size"], 3 * x["size"]) and len(x["positions"]) == x["copies"]
        assert all(0 <= p <= 1 for p in x["positions"])
    assert abs(sum(s[1] for s in per.values()) - total) < 1e-6
    assert all(abs(s[2] - s[1]) <= s[3] and s[1] <= 3 * s[0] + 1e-9 for s in per.values())
    firsts = [x["positions"][0] for x in got if x["copies"]]
    assert firsts == sorted(firsts)
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(docs.repartition(3)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in got}
    assert mixing.training_order(docs).count() == sum(x["copies"] for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_training_order_takes_each_row_by_its_own_mix(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    r = random.Random(9)
    ids = [None] * 300 + [7] * 40 + [None, 8] * 10 + list(range(100, 300))
    same = {8: "eight eight", None: "none"}
    rows = [(i, same[i] if 340 <= k < 360 else " ".join([f"t{k}"] * r.randint(0, 40)), "abc"[k % 3], k) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    mixed = mixing.mix(docs).collect()
    got = mixing.training_order(docs).collect()
    want = Counter()
    for x in mixed:
        want[x["doc_id"], x["source"], x["size"]] += x["copies"]
    assert Counter((x["doc_id"], x["source"], len(x["text"].split())) for x in got) == +want
    assert all(n <= 3 for n in Counter(x["n"] for x in got).values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_pipeline(spark):
    """The stages one after another against the operators' own decisions."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import tempfile

    sf = tempfile.mkdtemp(prefix="spark-")
    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "the", "in", "or", "es"]) for _ in range(r.randint(1, 4)))
    clean = [" ".join(word() for _ in range(r.randint(30, 150))) for _ in range(80)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, " ".join(x + "###" for x in t.split()), "en", "src0", 1) for i, t in enumerate(clean[:40])]
    rows += [(200 + i, clean[i] + "  ", "en", "src1", 1) for i in range(5)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        kept.append(pipeline.save(stage(spark, kept[-1], sf), "t"))
        assert kept[-1].columns == docs.columns
    ids = [{x["doc_id"] for x in k.select("doc_id").collect()} for k in kept]
    assert len(ids[1] & set(range(80))) >= 78 and not ids[1] & set(range(100, 140))
    squeezed = lambda t: " ".join((t or "").split())
    firsts = {}
    for x in sorted(kept[1].collect(), key=lambda x: x["doc_id"]):
        firsts.setdefault(squeezed(x["text"]) + (" " if (x["text"] or "").endswith(" ") else ""), x["doc_id"])
    assert ids[2] == set(firsts.values()) and kept[2].count() == len(firsts)
    assert ids[3] <= ids[2] and ids[4] <= ids[3]
    near = {x["doc_id"] for x in simhash.near_duplicates(kept[2]).filter("kept").collect()}
    assert ids[3] == near
    copies = {x["doc_id"]: x["copies"] for x in mixing.mix(kept[3]).collect() if x["copies"]}
    assert {x["doc_id"]: x["count"] for x in kept[4].groupBy("doc_id").count().collect()} == copies
    out = pipeline.run(spark, sf).collect()
    assert {x["doc_id"] for x in out} == ids[4]
    lengths = {}
    for x in out:
        lengths[x["sequence_id"]] = lengths.get(x["sequence_id"], 0) + x["length"]
    assert all(n <= 2048 for n in lengths.values())


def test_pipeline_stages_on_unusual_tables(spark):
    """Empty tables, null and repeated ids, columns with the operators' own names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import tempfile

    sf = tempfile.mkdtemp(prefix="spark-")
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, rid string, size long, hash long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, "en", None, 1, "k", "r", 9, 9)] * 3 + [(7, text, "en", "a", 1, "k", "r", 9, 9), (7, text + " more", "en", "b", 1, "k", "r", 9, 9), (None, None, None, None, None, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, kind)
        for name, stage in pipeline.STAGES:
            out = pipeline.save(stage(spark, docs, sf), "t")
            assert name == pipeline.STAGES[-1][0] or out.columns == docs.columns
            assert (out.count() == 0) == (not data or name == "quality_classifier" and out.count() == 0)
