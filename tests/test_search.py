"""Pools by blocks, the whole search with vectors, and sources, against brute force on small cases."""

import json
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.functions.vectorized import packed_trigrams, word_similarity, word_similarity_of
from clausegrid.operators import requirements, retrieval
from clausegrid.sources import io

WORDS = ["led", "lamp", "housing", "IP66", "ring", "ringing", "a", "ab", "aba", "방수", "등급", "시험기", "é", "x1"]


def grams(text):
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]


def word_score(query, text):
    q, t = set(query), list(text)
    return max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0)


def set_score(query, text):
    q, t = set(query), set(text)
    return len(q & t) / len(q | t) if q | t else 0.0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    return [some(7) for _ in range(60)], ["", "—", *{some(4) for _ in range(25)}]


def frames(spark, texts):
    chunks = spark.createDataFrame([(i * 3 % 101, x, "led > ring") for i, x in enumerate(texts[0])], "chunk_id long, content string, section_path string")
    probes = spark.createDataFrame([(i % 4, x) for i, x in enumerate(texts[1])], "query_id long, probe string")
    return chunks, probes


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("first,matrix", [(1 << 12, 1 << 16), (12, 1 << 16), (12, 24), (5, 1)])
def test_pools_equal_brute_force_in_small_blocks_and_rounds(spark, texts, monkeypatch, words, first, matrix):
    """One round, several as matrices, the last ones by postings, all but the first by postings."""
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(retrieval, "PROBE_BLOCK", 7)
    monkeypatch.setattr(retrieval, "FIRST_ROUND", first)
    monkeypatch.setattr(retrieval, "ROUND_GROWTH", 2)
    monkeypatch.setattr(retrieval, "MATRIX_CHUNKS", matrix)
    monkeypatch.setattr(retrieval, "EXTRA_GRAMS", 2)
    chunks, probes = frames(spark, texts)
    got = {}
    for r in retrieval.trigram_top(probes, chunks, 5, words).collect():
        got.setdefault(r["probe"], []).append((-r["similarity"], r["chunk_id"]))
    for i, probe in enumerate(texts[1]):
        scored = []
        for k, content in enumerate(texts[0]):
            hay = grams(f"{content} led > ring")
            score = max(set_score(grams(probe), hay), word_score(grams(probe), hay) if words else 0)
            if score > 0:
                scored.append((-score, k * 3 % 101))
        assert sorted(got.get(probe, [])) == sorted(scored)[:5], probe


def test_postings_leave_most_pairs_out(spark, monkeypatch):
    """Of chunks whose words differ a probe's candidates are few, and their share falls with the number of chunks."""
    monkeypatch.setattr(retrieval, "FIRST_ROUND", 64)
    monkeypatch.setattr(retrieval, "MATRIX_CHUNKS", 64)
    share = []
    for n in (512, 4096):
        r = random.Random(n)
        word = lambda r=r: "".join(r.choice("abcdefghij") for _ in range(6))
        names = [f"{word()} {word()} {word()}" for _ in range(n)]
        chunks = spark.createDataFrame([(i, x, "") for i, x in enumerate(names)], "chunk_id long, content string, section_path string")
        index = retrieval.trigram_index(chunks)
        asked = spark.createDataFrame([(x,) for x in names[:8]], "probe string").select("probe", F.array_distinct(packed_trigrams(F.col("probe"))).alias("grams"), F.lit(0.3).alias("least"))
        share.append(retrieval.trigram_candidates(asked, index, True, 0.0, 1.0).count() / (8 * n))
    assert share[1] < 0.05 and share[0] < 0.05


def test_packed_trigrams_tell_all_letters_apart(spark):
    rows = spark.createDataFrame([("aé가😀b",), ("",), (None,)], "t string").select(packed_trigrams(F.col("t")).alias("p"), T.trigram_list(F.col("t")).alias("g")).collect()
    for r in rows:
        assert r["p"] == [sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=True)) for g in r["g"]]


def test_word_similarity_column(spark):
    r = random.Random(2)
    pairs = [(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 3))), " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))) for _ in range(40)]
    packed = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.array_distinct(packed_trigrams(F.col("a"))).alias("p"), packed_trigrams(F.col("b")).alias("q")).repartition(4)
    for x in packed.select("a", "b", word_similarity("p", "q").alias("w")).collect():
        assert x["w"] == pytest.approx(word_score(grams(x["a"]), grams(x["b"]))) == word_similarity_of(set(grams(x["a"])), grams(x["b"]))


def test_semantic_pool_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 9)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    r = np.random.default_rng(4)
    c, q = r.integers(-2, 3, (40, 4)).astype(float), r.integers(-2, 3, (5, 4)).astype(float)
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.maximum(unit(q) @ unit(c).T, 0).round(9)
    want = {(i, j) for i, row in enumerate(score) for j in np.lexsort((np.arange(40), -row))[:6].tolist()}
    got = retrieval.semantic_top(queries, chunks, 6).collect()
    assert {(x["query_id"], x["chunk_id"]) for x in got} == want
    assert all(x["semantic"] == pytest.approx(score[x["query_id"], x["chunk_id"]]) for x in got)


def search_frames(spark, text, model):
    rows = [(1, 10, "catalog", "방수 등급: IP65", ["LT-150"], [1.0, 0.0]), (2, 10, "catalog", "방수 등급: IP66", ["LT-200"], [0.6, 0.8]), (3, 11, "qa", "보증 기간: 2년", [], [0.0, 1.0]), (4, 12, "qa", "성적서", [], None)]
    chunks = spark.createDataFrame([(i, p, 1, k, c, "카탈로그", m, e) for i, p, k, c, m, e in rows], "chunk_id long, parent_id long, document_id long, doc_kind string, content string, section_path string, model_tags array<string>, embedding array<double>").withColumn("keywords", T.keywords(F.col("content")))
    queries = spark.createDataFrame([(1, text, [text], model)], "query_id long, text string, probes array<string>, model_filter string")
    return queries, chunks, spark.createDataFrame([(1, [0.0, 2.0])], "query_id long, embedding array<double>")


def found(spark, text, model=None, doc_kinds=None):
    queries, chunks, vectors = search_frames(spark, text, model)
    return {r["chunk_id"]: r for r in retrieval.search(queries, chunks, vectors, replace(retrieval.Settings(), threshold=0.0), doc_kinds).collect()}


def test_vectors_find_what_words_do_not(spark):
    got = found(spark, "guarantee")
    assert got[3]["semantic"] == 1.0 and got[3]["score"] == 0.6 and got[3]["rank"] == 1 and got[2]["semantic"] == 0.8
    assert 4 not in got or got[4]["semantic"] == 0.0


def test_vectors_meet_only_vectors_of_their_length(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 1.0, 1.0, 1.0]), (4, [0.0, None]), (5, None), (6, [])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0, 0.0]), (3, [1.0] * 5), (4, [1.0] * 4)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["chunk_id"]): r["semantic"] for r in retrieval.semantic_top(queries, chunks, 40).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 0.0, (4, 3): 1.0}


def test_a_text_is_its_own_probe_and_unknown_categories_take_the_hint(spark):
    queries, chunks, _ = search_frames(spark, "보증 기간", None)
    for probes in (F.array().cast("array<string>"), F.lit(None).cast("array<string>")):
        hits = retrieval.search(queries.withColumn("probes", probes), chunks, None, replace(retrieval.Settings(), threshold=0.0)).collect()
        assert hits[0]["chunk_id"] == 3
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "track_record"), (3, "a", "other")], "requirement_id long, item string, category string").withColumns({"is_active": F.lit(True), "requirement_text": F.lit("")})
    assert {r["query_id"]: r["model_filter"] for r in retrieval.requirement_queries(rows, "LT-150").collect()} == {1: "LT-150", 2: None, 3: "LT-150"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounded_tokens_rank_like_all_pairs_of_a_token(spark, seed):
    """The search with lists of tokens against the pools with every pair: models in several sets, few parents, kinds."""
    r = random.Random(seed)
    tags = [[], [], ["LT-101"], ["LT-102"], ["LT-101", "LT-102"], ["LT-103"], ["LT-102", "LT-103"]]
    rows = [(i, r.choice([None, *range(1000, 1006)]), 1, r.choice(["catalog", "qa"]), f"IP6{r.choice('556')} {r.choice(WORDS)}", "p", r.choice(tags), [r.random(), r.random()]) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id long, parent_id long, document_id long, doc_kind string, content string, section_path string, model_tags array<string>, embedding array<double>").withColumn("keywords", T.keywords(F.col("content")))
    asked = [(i, f"{r.choice(WORDS)} IP6{r.choice('567')}" + r.choice(["", " 2 kg", " IP65"]), [], r.choice([None, "LT-101", "LT-102", "LT-103", "LT-999"])) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, text string, probes array<string>, model_filter string")
    vectors = spark.createDataFrame([(i, [1.0, i / 5]) for i in range(0, 12, 2)], "query_id long, embedding array<double>")
    for s, kinds in ((replace(retrieval.Settings(), threshold=0.1, pool=3), None), (replace(retrieval.Settings(), pool=2, top_k=3, per_parent=1), ["qa"])):
        got = retrieval.search(queries, chunks, vectors, s, kinds)
        probes = queries.select("query_id", F.col("text").alias("probe"))
        keyword = retrieval.keyword_scores(retrieval.keyword_top(probes, chunks, s.pool), retrieval.exact_token_hits(queries, chunks))
        want = retrieval.diverse_top(retrieval.score_candidates(queries, chunks, retrieval.semantic_top(vectors, chunks, s.pool), keyword, s, kinds), s)
        keys = ["query_id", "rank", "chunk_id", "score", "semantic", "keyword"]
        assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))


def test_settings_at_once_give_what_each_gives_alone(spark):
    """Weights, limits and the model filter differ; the pools are made once."""
    r = random.Random(9)
    rows = [(i, r.choice([None, *range(1000, 1004)]), 1, "qa", f"IP6{r.choice('556')} {r.choice(WORDS)}", "p", r.choice([[], ["LT-101"], ["LT-102"], ["LT-101", "LT-102"]]), [r.random(), r.random()]) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id long, parent_id long, document_id long, doc_kind string, content string, section_path string, model_tags array<string>, embedding array<double>").withColumn("keywords", T.keywords(F.col("content")))
    queries = spark.createDataFrame([(i, f"{r.choice(WORDS)} IP6{r.choice('567')}", [], r.choice([None, "LT-101", "LT-102"])) for i in range(8)], "query_id long, text string, probes array<string>, model_filter string")
    vectors = spark.createDataFrame([(i, [1.0, i / 5]) for i in range(8)], "query_id long, embedding array<double>")
    base = replace(retrieval.Settings(), threshold=0.1, pool=4)
    settings = {"a": (base, True), "b": (replace(base, semantic_weight=0.2, keyword_weight=0.8, top_k=3, per_parent=1), True), "c": (replace(base, threshold=0.5), False)}
    got = retrieval.search_settings(queries, chunks, vectors, settings).collect()
    keys = ("query_id", "rank", "chunk_id", "score", "semantic", "keyword")
    for name, (s, models) in settings.items():
        one = queries if models else queries.withColumn("model_filter", F.lit(""))
        alone = retrieval.search(one, chunks, vectors, s).select(*keys).collect()
        assert sorted(tuple(x[k] for k in keys) for x in got if x["setting"] == name) == sorted(map(tuple, alone)) and alone
    with pytest.raises(ValueError):
        retrieval.search_settings(queries, chunks, vectors, {"a": (base, True), "b": (replace(base, pool=9), True)})


def test_lists_of_a_token_do_not_grow_with_its_chunks(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), (F.col("id") % 700).alias("parent_id"), F.array(F.lit("IP65")).alias("keywords"), F.array(F.concat(F.lit("LT-10"), (F.col("id") % 3).cast("string"))).alias("model_tags"))
    wide, matching = retrieval.token_lists(chunks, retrieval.Settings())
    assert wide.count() <= 3 * 10 and matching.count() <= 3 * 10


def test_a_single_named_model_becomes_the_filter(spark):
    plain, named = found(spark, "방수 등급"), found(spark, "LT-150 방수 등급")
    assert found(spark, "LT-150 방수 등급", "")[1]["score"] < named[1]["score"] and named[2]["score"] < plain[2]["score"]
    both = found(spark, "LT-150 LT-200 방수 등급")
    assert both[1]["score"] == found(spark, "LT-150 LT-200 방수 등급", "")[1]["score"]
    given = found(spark, "LT-150 방수 등급", "LT-200")
    assert given[2]["score"] > given[1]["score"] and plain[1]["rank"] > 0


def test_kinds_are_kept_after_the_pools(spark):
    assert set(found(spark, "방수 등급", doc_kinds=["qa"])) <= {3, 4}


def test_numbers_in_responses_are_told_from_texts(spark):
    response = {"requirements": [{"clause_no": "1.1", "item": str(i), "source_page": p} for i, p in enumerate([7, "7", 7.0, 7.5, None, True, 10**12, -3])], "submission_items": [{"seq": "3", "name": "text"}, {"seq": 3, "name": "number"}]}
    rows = spark.createDataFrame([(1, 1, "announcement", json.dumps(response))], "project_id long, document_id long, doc_type string, response string")
    parsed, _ = requirements.parse_responses(rows)
    got = {r["item"]: r["source_page"] for r in requirements.requirement_rows(parsed).collect()}
    assert [got[str(i)] for i in range(8)] == [7, None, None, None, None, None, None, -3]
    items, wrong = requirements.save_submissions(parsed)
    assert [(r["seq"], r["name"]) for r in items.collect()] == [(3, "number")] and [r["name"] for r in wrong.collect()] == ["text"]


def test_dates_are_reported_only_while_their_field_is_blank(spark):
    said = [(1, 1, "soon"), (1, 2, "2025-7-1"), (1, 3, "late"), (2, 4, "never"), (3, 5, "soon")]
    rows = spark.createDataFrame([(p, d, "announcement", json.dumps({"bid_info": {"bid_due_at": v}})) for p, d, v in said], "project_id long, document_id long, doc_type string, response string")
    blank = [f"'' AS {f}" for f in requirements.HEADER_TEXT] + ["CAST(NULL AS date) AS announced_on"] + [f"CAST(NULL AS timestamp) AS {f}" for f in requirements.HEADER_TIMES if f != "bid_due_at"]
    projects = spark.sql(f"SELECT id AS project_id, CASE WHEN id = 2 THEN timestamp'2025-01-01' END AS bid_due_at, {', '.join(blank)} FROM range(1, 4)")
    filled, warned = requirements.fill_header(projects, requirements.parse_responses(rows)[0])
    assert sorted((r["project_id"], r["value"]) for r in warned.collect()) == [(1, "soon"), (3, "soon")]
    assert {r["project_id"]: str(r["bid_due_at"])[:10] for r in filled.collect()} == {1: "2025-07-01", 2: "2025-01-01", 3: "None"}


def test_pages_answer_key_and_tables_are_read_and_written(spark, tmp_path):
    page = {"document_id": 1, "title": "t", "page_no": 2, "text": "x", "tables": [{"index": 0, "rows": [["a", "b"]]}]}
    (tmp_path / "pages.json").write_text(json.dumps(page) + "\n")
    got = io.read_pages(spark, str(tmp_path / "pages.json")).first()
    assert (got["page_no"], got["tables"][0]["rows"]) == (2, [["a", "b"]])
    key = {"graded_total": 1, "items": [{"clause_no": "1.1", "expected_verdict": "MEET"}], "reference_items": [{"clause_no": "2.1", "expected_verdict": "GAP"}], "traps": [{"id": "T1", "checks": [{"kind": "verdict", "clause_no": "1.1", "equals": "MEET"}, {"kind": "cross_issue", "clause_nos": ["1.1", "1.2"], "description_contains": "kg"}]}]}
    (tmp_path / "key.json").write_text(json.dumps(key, indent=1))
    items, reference, checks = io.read_answer_key(spark, str(tmp_path / "key.json"))
    assert items.first()["clause_no"] == "1.1" and reference.first()["expected_verdict"] == "GAP"
    assert [(r["check_no"], r["clause_nos"], r["contains"]) for r in checks.orderBy("check_no").collect()] == [(0, ["1.1"], None), (1, ["1.1", "1.2"], "kg")]
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, t string").coalesce(1)
    for form, want in (("markdown", ["| n | t |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]), ("csv", ["n,t", "1,a|b", "2,"])):
        io.write_table(df, str(tmp_path / form), form)
        assert [r["value"] for r in spark.read.text(str(tmp_path / form)).collect()] == want
    io.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_pairs_of_exact_tokens_come_once_and_are_never_shuffled(spark):
    """Several shared tokens, repeated tokens and ids, nothing shared; no exchange stands above the join."""
    asked = [(1, "LT-101 IP66 5 kg"), (2, "IP66, 5 kg"), (3, "plain"), (2, "IP67"), (4, "IP66")]
    held = [(10, ["IP66", "5KG", "IP66"]), (11, ["5KG"]), (12, ["LT-101"]), (13, []), (10, ["IP67"]), (14, ["IP67", "IP66"])]
    q = spark.createDataFrame(asked, "query_id long, text string")
    c = spark.createDataFrame(held, "chunk_id long, keywords array<string>")
    hits = retrieval.exact_token_hits(q, c)
    assert sorted(tuple(r) for r in hits.collect()) == [(q, c, 1.0) for q, c in ((1, 10), (1, 11), (1, 14), (2, 10), (2, 11), (2, 14), (4, 10), (4, 14))]
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_texts_that_chunks_share_are_scored_once(spark, texts, monkeypatch):
    """Each text in chunks that lie apart: the pool is that of all chunks, the index has a row for each different text."""
    counts, made = [], retrieval.trigram_index
    monkeypatch.setattr(retrieval, "trigram_index", lambda *a: counts.append(made(*a)) or counts[-1])
    shared = texts[0][:20] * 4 + [texts[0][0].upper() + " !"] * 9
    chunks, probes = frames(spark, (shared, texts[1]))
    held = {r["chunk_id"]: r["content"] for r in chunks.collect()}
    got = {}
    for r in retrieval.keyword_top(probes, chunks, 7).collect():
        got.setdefault(r["probe"], set()).add((r["chunk_id"], round(r["keyword"], 9)))
    for probe in {p for p in texts[1] if grams(p)}:
        score = {i: max(set_score(grams(probe), grams(x + " led > ring")), word_score(grams(probe), grams(x + " led > ring"))) for i, x in held.items()}
        want = sorted((-round(v, 9), i) for i, v in score.items() if v > 0)[:7]
        assert got.get(probe, set()) == {(i, -v) for v, i in want}
    assert counts[0].count == len({tuple(grams(x + " led > ring")) for x in held.values()}) < len(held)


@pytest.mark.parametrize("together", [1, 3, 16])
def test_semantic_rounds_equal_brute_force(spark, monkeypatch, together):
    """Several rounds, groups and lanes; ties, copies, negative cosines. Blocks are never broadcast."""
    for name, n in {"FIRST_ROUND": 12, "CHUNK_BLOCK": 9, "QUERY_BLOCK": 4, "BLOCKS_TOGETHER": together}.items():
        monkeypatch.setattr(retrieval, name, n)
    r = np.random.default_rng(6)
    c = r.normal(size=(150, 5))
    c[40:70] = c[3]
    v = np.vstack([r.normal(size=(20, 5)), -c[3]])
    chunks = spark.createDataFrame([(i * 7 % 151, x.tolist()) for i, x in enumerate(c)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "query_id long, embedding array<double>")
    hits = retrieval.semantic_top(queries, chunks, 6)
    cosine = np.maximum((v / np.linalg.norm(v, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 0).round(9)
    want = {(q, i) for q in range(21) for _, i in sorted((-cosine[q, j], j * 7 % 151) for j in range(150))[:6]}
    assert {(x["query_id"], x["chunk_id"]) for x in hits.collect()} == want
    assert "BroadcastHashJoin" not in retrieval._block_pairs(queries, chunks, "query_id", 6, 17)._jdf.queryExecution().executedPlan().toString()
