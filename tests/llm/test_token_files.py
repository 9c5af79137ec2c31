"""Token-id files: the library's ids come back whole, by document and by span."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import bpe, grammar, token_files


def library_ids(text):
    return [*bpe.encoder(bpe.default_path()).library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("shape", ["random", "runs", "copies", "one", "nothing"])
def test_grammar_round_trip(shape):
    r = random.Random(8)
    docs = {
        "random": [[r.randint(0, 40) for _ in range(r.randint(0, 300))] for _ in range(60)],
        "runs": [[7] * n for n in (1, 2, 3, 4, 5, 1000, 4097)] + [[7, 8] * 500, [7, 7, 8] * 333],
        "copies": [[r.randint(0, 9999) for _ in range(500)]] * 40,
        "one": [[5]],
        "nothing": [[], []],
    }[shape]
    counts = np.array([len(x) for x in docs])
    flat = np.array([i for x in docs for i in x], np.uint32)
    for min_uses, base in ((2, 10_000), (8, 10_000), (8, 1 << 17)):
        made = grammar.compress(flat, counts, base, min_uses)
        back, doc_ids, has_id = grammar.from_bytes(made.to_bytes(np.arange(len(docs)), np.ones(len(docs), bool)))
        assert back.ids().tolist() == flat.tolist() and back.tokens.tolist() == counts.tolist() and doc_ids.tolist() == list(range(len(docs)))
        assert (np.bincount(back.pairs.ravel(), minlength=1)[back.base :] >= 0).all() and len(back.lengths) == len(back.pairs)
        for _ in range(50):
            d = r.randrange(len(docs))
            start, n = r.randint(0, len(docs[d]) + 2), r.randint(0, 60)
            assert back.span(d, start, n).tolist() == docs[d][start : start + n]
    if shape == "copies":
        assert len(made.symbols) < len(flat) / 20


def test_rules_are_used_and_a_cap_holds():
    r = random.Random(2)
    flat = np.array([r.randint(0, 5) for _ in range(20_000)], np.uint32)
    made = grammar.compress(flat, np.array([20_000]), 6, 8, max_rules=50)
    assert len(made.pairs) == 50 and made.ids().tolist() == flat.tolist()
    used = np.bincount(np.r_[made.symbols, made.pairs.ravel()].astype(np.int64), minlength=56)
    assert (used[6:] > 0).all()


ROWS = [
    (5, "the cat sat on the mat " * 40), (2, None), (2, "again"), (2, "again"), (9, ""), (None, "null id"), (None, None), (3, "naïve café 北京 <|endoftext|>"),
    (-4, "minus four"), (7, "word " * 30_000), (1, "a\r\n\tb"), (8, "the cat sat on the mat " * 40),
]


@pytest.mark.parametrize("shard_ids", [64, 1 << 20])
def test_files_hold_every_document_in_order(spark, tmp_path, shard_ids):
    path = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame([(*x, 1, 2, "s") for x in ROWS], "doc_id long, text string, part int, start int, ids string")
    token_files.write(docs, path, shard_ids=shard_ids)
    got = sorted(token_files.read(spark, path).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [-4, 1, 2, 2, 2, 3, 5, 7, 8, 9, None, None]
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, zlib.crc32(np.array(library_ids(t), "<u4").tobytes()), len(library_ids(t))) for i, t in ROWS]
    assert sorted(((x["doc_id"], x["ids_crc32"], x["n_tokens"]) for x in got), key=key) == sorted(want, key=key)

    wishes = [(7, 29_990, 40), (7, 5, 3), (7, 5, 3), (3, 0, 100), (9, 0, 5), (9, 1, 5), (77, 0, 5), (2, 0, 1)]
    spans = token_files.read_spans(spark, path, spark.createDataFrame(wishes, "doc_id long, start long, n long")).collect()
    whole = {i: library_ids(t) for i, t in ROWS if i not in (None, 2)}
    one = {(x["doc_id"], x["start"]): x["ids"] for x in spans if x["doc_id"] != 2}
    assert one == {(i, a): whole[i][a : a + n] for i, a, n in wishes if i in whole}
    assert sorted(x["ids"] for x in spans if x["doc_id"] == 2) == sorted(library_ids(t)[:1] for t in (None, "again", "again"))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.read(spark, path).count() == 0


def test_starts_are_running_sums_over_many_parts(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda x: F.col("id").cast("string"))).alias("text"))
    token_files.write(docs, path, shard_ids=500)
    got = token_files.read(spark, path).orderBy("doc_id").collect()
    assert len(got) == 3000 and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
