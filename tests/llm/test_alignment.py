"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from clausegrid.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute(rows):
    a_lib, b_lib = encoders()
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    docs = []
    for doc_id, text in rows:
        made = None
        if text:
            want = (" " + text).encode()
            ea = a_lib.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in t)) for i, t in zip(ea.ids, ea.tokens, strict=True)]
            b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                made = []
                for side in (a, b):
                    at, spans = 0, []
                    for i, x in side:
                        spans.append((i, at, at + len(x)))
                        at += len(x)
                    made.append(spans)
        docs.append((doc_id, made))
    holders, links_of = Counter(), []
    for _, made in docs:
        links = []
        if made:
            j = 0
            for i, s, e in made[0]:
                while made[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(made[1]) and made[1][k][1] < e:
                    links.append((i, made[1][k][0]))
                    k += 1
            holders.update(set(links))
        links_of.append(links)
    top = Counter()
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, made), links in zip(docs, links_of, strict=True):
        if not made:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = made
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, stacks = [], [a[::-1], b[::-1]]
        for e in cuts:
            taken = [[], []]
            for stack, mine in zip(stacks, taken, strict=True):
                while stack and stack[-1][2] <= e:
                    mine.append(str(stack.pop()[0]))
            groups.append("|".join(",".join(x) for x in taken))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(cuts), len(links), sum(holders[x] == top[x[0]] for x in links), sum(holders[x] for x in links), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "é", "é", " ", "　", " ", "▁", "北京", "🙂🏽", "don't", "'s", "12345", "½", "<s>", "</s>", "<unk>", "<|endoftext|>", "\x00", "\x85",
         "\x1c", "...", "--", "_", "ß", "​", "﻿", "한국어", "אב", "<0x0A>", "x" * 60, "ı", "ﬁ", "Å", "Internationalisierung", " weather", " Donau", "ing"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    fixed = [(1, None), (2, ""), (3, " "), (4, "a "), (5, "a▁b"), (None, "null id"), (None, None), (6, "same text"), (6, "same text"), (7, "same text"), (8, "<|endoftext|>"), (9, "  x  "), (10, "a" * 3000)]
    made = [(100 + i, "".join(r.choice(PARTS) for _ in range(r.randint(1, 25)))) for i in range(250)]
    prose = [(1000 + i, " ".join(r.choice(["the", "Haus", "maison", "unbelievable", "niño", "3.14", "re-do", "It's"]) for _ in range(r.randint(1, 80)))) for i in range(60)]
    return fixed + made + prose


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "s", 2) for x in rows], "doc_id long, text string, row long, side string, batch long")


def order(x):
    return (x[0] is None, x[0] or 0, *x[1:])


@pytest.mark.parametrize("run_bytes,batch_pairs", [(16 << 10, 1 << 22), (7, 40)])
def test_equals_the_plain_version(spark, rows, monkeypatch, run_bytes, batch_pairs):
    from clausegrid.llm import common

    monkeypatch.setattr(alignment, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(alignment, "slices", lambda batch, column, limit: common.slices(batch, column, 200 if run_bytes == 7 else limit))
    df = frame(spark, rows).repartition(3)
    if run_bytes == 7:  # the workers do not see the patch: the phases one after another in this process
        got = here(rows, batch_pairs)
    else:
        got = [tuple(x) for x in alignment.align(df, A, B, batch_pairs=batch_pairs).select(COLUMNS).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def here(rows, batch_pairs):
    """The operator's phases on one partition, with small runs, slices and batches."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t or "" for _, t in rows], "row": pa.array(range(len(rows)), pa.int64())})
    events = pa.Table.from_batches(list(alignment._events(A, B)(iter([texts])))).sort_by([("row", "ascending"), ("at", "ascending"), ("side", "ascending")])
    batches = pa.Table.from_batches(list(alignment._swept(A, B, batch_pairs)(iter(events.to_batches(max_chunksize=3)))))
    assert batches.num_rows > 5
    asked = pa.Table.from_batches(list(alignment._pairs(iter(batches.to_batches())))).to_pylist()
    n, top = Counter(), Counter()
    for x in asked:
        n[x["pair"]] += x["n"]
    for p, m in n.items():
        top[p // 32000] = max(top[p // 32000], m)
    said = []
    for b in batches.to_pylist():
        mine = sorted((x for x in asked if x["batch"] == b["batch"]), key=lambda x: x["place"])
        said += [{"n": n[x["pair"]], "best": n[x["pair"]] == top[x["pair"] // 32000], "docs": None, "places": None, "times": None} for x in mine]
        said.append({"n": None, "best": None, "docs": b["docs"], "places": b["places"], "times": b["times"]})
    kinds = pa.schema([("n", pa.int64()), ("best", pa.bool_()), batches.schema.field("docs"), ("places", pa.binary()), ("times", pa.binary())])
    out = pa.Table.from_batches(list(alignment._scored(iter(pa.Table.from_pylist(said, kinds).to_batches(max_chunksize=17)))))
    return [tuple(x[c] for c in COLUMNS) for x in out.to_pylist()]


def asked_rows(texts):
    """Rows that one batch of ``texts`` sends to the join by pair."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "row": pa.array(range(len(texts)), pa.int64())})
    events = pa.Table.from_batches(list(alignment._events(A, B)(iter([batch])))).sort_by([("row", "ascending"), ("at", "ascending"), ("side", "ascending")])
    return pa.Table.from_batches(list(alignment._pairs(alignment._swept(A, B, alignment.BATCH_PAIRS)(iter(events.to_batches())))))


def test_copies_add_no_rows_to_the_join():
    text = "The Haus is an unbelievable maison, don't re-do it. " * 5
    one = asked_rows([text])
    assert len(set(one.column("pair").to_pylist())) == one.num_rows > 10 and set(one.column("n").to_pylist()) == {1}
    many = asked_rows([text] * 400)
    assert many.column("pair").to_pylist() == one.column("pair").to_pylist() and set(many.column("n").to_pylist()) == {400}


def test_rows_of_the_join_do_not_follow_the_partitions(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {x: spark.conf.get(x) for x in names}
    saved, save = [], alignment.save
    monkeypatch.setattr(alignment, "save", lambda *x: saved.append(save(*x)) or saved[-1])
    asked = []
    try:
        for parts in ("4", "40"):
            for x, value in (names | {"spark.sql.shuffle.partitions": parts}).items():
                spark.conf.set(x, value)
            got = [tuple(x) for x in alignment.align(frame(spark, rows), A, B).select(COLUMNS).collect()]
            assert sorted(got, key=order) == sorted(brute(rows), key=order)
            batches = [x for x in saved if "places" in x.columns][-1]
            asked.append(batches.agg(F.sum(F.expr("length(pairs) div 8"))).first()[0])
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)
    assert asked[0] == asked[1] == saved[-1].count()  # one row a distinct pair, in one batch


@pytest.mark.parametrize("full", [1, 200, 1 << 19])
def test_batches_put_together_give_the_same(rows, monkeypatch, full):
    from clausegrid.llm import common

    swept, made = alignment._swept, []

    def filled(*x):
        def run(batches):
            for batch in alignment._merged(full)(swept(*x)(batches)):
                made.append(batch.column("held")[0].as_py())
                yield batch

        return run

    monkeypatch.setattr(alignment, "RUN_BYTES", 7)
    monkeypatch.setattr(alignment, "slices", lambda batch, column, limit: common.slices(batch, column, 200))
    alone = [x.column("held")[0].as_py() for x in swept_here(rows, 40)]
    if full == 1 << 19:  # one batch, where the helper looks for some
        assert [x.column("held")[0].as_py() for x in alignment._merged(full)(iter(swept_here(rows, 40)))] == [sum(alone)]
        return
    monkeypatch.setattr(alignment, "_swept", filled)
    assert sorted(here(rows, 40), key=order) == sorted(brute(rows), key=order)
    assert sum(made) == sum(alone) and (made == alone if full == 1 else len(made) < len(alone) / 2 and max(made) <= max(full, max(alone)))


def test_documents_without_tokens_take_room_in_a_batch():
    none = [(i, None) for i in range(100)]
    swept = swept_here(none, 160)
    assert [len(x.column("docs")[0].values) for x in swept] == [10] * 10
    merged = list(alignment._merged(480)(iter(swept)))
    assert [len(x.column("docs")[0].values) for x in merged] == [30, 30, 30, 10]
    some = [*none, (100, "12 kg")]  # the helper looks for pairs
    assert sorted(here(some, 160)) == brute(some)


def swept_here(rows, batch_pairs):
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t or "" for _, t in rows], "row": pa.array(range(len(rows)), pa.int64())})
    events = pa.Table.from_batches(list(alignment._events(A, B)(iter([texts])))).sort_by([("row", "ascending"), ("at", "ascending"), ("side", "ascending")])
    return list(alignment._swept(A, B, batch_pairs)(iter(events.to_batches(max_chunksize=3))))


def test_written_groups_give_the_digest(spark, rows):
    some = [x for x in rows if x[0] is not None and x[0] != 6]
    groups = {}
    for x in alignment.links(frame(spark, some), A, B).orderBy("doc_id", "grp").collect():
        groups.setdefault(x["doc_id"], []).append(",".join(map(str, x["a_ids"])) + "|" + ",".join(map(str, x["b_ids"])))
    for x in brute(some):
        assert x[-1] == (hashlib.sha256(";".join(groups[x[0]]).encode()).hexdigest() if x[3] else "") and x[3] == len(groups.get(x[0], []))


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "Die Kaffeemaschine weighs 12 kg. " * 4000), (2, "12 kg")]
    got = [tuple(x) for x in alignment.align(frame(spark, rows), A, B).select(COLUMNS).collect()]
    assert sorted(got) == brute(rows) and sorted(got)[0][1] > 30_000
    assert alignment.align(frame(spark, [(1, "x")]).filter("doc_id > 1"), A, B).count() == 0
