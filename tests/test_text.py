"""Text expressions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.functions.vectorized import grouped_sentences, table_rows_of, word_similarity_of


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("소비전력 140 W, 광속 20,000 lm", ["140W", "20000LM"]),
        ("IP66 이상 IP66", ["IP66"]),
        ("LT-150 (HB-CAT-2025-02)", ["LT-150", "HB-CAT-2025-02"]),
        ("KS C 7658 및 ISO 9001:2015", ["KSC7658", "ISO9001:2015"]),
        ("", []),
        (None, []),
    ],
)
def test_keywords(spark, text, expected):
    assert one(spark, T.keywords, text) == expected


def test_models_need_word_ends_in_texts_but_not_in_paths(spark):
    assert one(spark, T.models, "LT-150급 LT-200 x") == ["LT-200"]
    assert one(spark, T.path_models, ["LT-150급", "LT-200 사양", "LT-150"], "array<string>") == ["LT-150", "LT-200"]


def test_clause_order(spark):
    given = ["2.10", "2.2", "공고 3.3", "", "3.1", "공고 1.1", "none", "2.2.1"]
    rows = spark.createDataFrame([(x,) for x in given], "c string").orderBy(T.clause_key(F.col("c"))).collect()
    assert [r["c"] for r in rows] == ["2.2", "2.2.1", "2.10", "3.1", "공고 1.1", "공고 3.3", "", "none"]


def test_probes(spark):
    assert one(spark, T.item_probes, " 내진동 시험 ") == ["내진동 시험", "진동 시험"]
    assert one(spark, T.item_probes, "내부") == ["내부"]
    assert one(spark, T.item_probes, " ") == []


def test_sentences(spark):
    assert one(spark, T.sentences, "- 하나다. 둘이다.\n\n* Three! Four") == ["하나다.", "둘이다.", "Three!", "Four"]
    assert one(spark, T.sentences, None) == []


def test_location(spark):
    assert one(spark, T.location, "a > b > c") == "b c"
    assert one(spark, T.location, "a") == "a"


def grams(text):
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]


def brute_word_similarity(query, text):
    q, t = set(query), list(text)
    return max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0)


def test_trigrams_and_published_similarities(spark):
    row = "3. 시험 설비 보유 현황 — 염수분무 시험기: 미보유 인증·시험·실적 현황 > 3. 시험 설비 보유 현황"
    assert one(spark, T.trigram_list, "Ab c1") == grams("Ab c1")
    assert round(word_similarity_of(set(grams("내염수분무 시험")), grams(row)), 3) == 0.556
    assert round(word_similarity_of(set(grams("염수분무 시험")), grams(row)), 3) == 0.875


def test_word_similarity_equals_brute_force():
    import random

    r = random.Random(3)
    for _ in range(150):
        q = {r.choice("abcdef") for _ in range(r.randint(1, 5))}
        t = [r.choice("abcdefgh") for _ in range(r.randint(0, 14))]
        assert word_similarity_of(q, t) == pytest.approx(brute_word_similarity(q, t))


def brute_groups(sentences):
    size = lambda t: max(1, int(len(t) / 1.5))
    groups, held = [], []
    for s in sentences:
        held.append(s)
        if size(" ".join(held)) >= 250:
            groups.append(" ".join(held))
            n = next((k for k in range(1, len(held) + 1) if size(" ".join(held[-k:])) >= 40), len(held))
            held = held[-n:] if n < len(held) else []
    rest = " ".join(held)
    if held and groups and size(rest) < 60:
        groups[-1] += " " + rest
    elif held:
        groups.append(rest)
    return groups


def test_sentence_groups_equal_brute_force():
    import random

    r = random.Random(5)
    for _ in range(100):
        s = ["x" * r.choice((3, 30, 70, 200, 500)) for _ in range(r.randint(0, 20))]
        assert grouped_sentences(s) == brute_groups(s)


def test_table_lines():
    lines = ["| before |", "| a | b |", "|---|---|", "| 1 | 2 |", "|---|---|", "text", "| x | y |", "--- | ---", "# h"]
    found = [(x["table_no"], x["row_no"]) if x else None for x in table_rows_of(lines)]
    assert found == [None, (0, 0), (0, -1), (0, 1), (0, 2), None, (1, 0), (1, -1), None]
