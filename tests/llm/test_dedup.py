"""Exact, near, span and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausegrid.llm import exact_dedup, simhash, span_dedup, suffix_dedup
from clausegrid.llm.components import components

KIND = "doc_id long, text string, rid string, n long"


def frame(spark, rows):
    """Extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], KIND)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    base = [words(r, r.randint(0, 120)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 7]) for i in range(30)]
    out += [(200 + i, base[i] + " tail") for i in range(10)]
    out += [(300, None), (301, ""), (302, " \t\n"), (303, " "), (304, "é" * 500 + " x"), (304, "é" * 500 + " x"), (None, base[3]), (305, words(r, 3000)), (306, "ab" * 400)]
    r.shuffle(out)
    return out


def test_exact(spark, rows):
    classes = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        classes.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in classes.items()}
    for x in got:
        ids = by_sha[x["text_sha256"]]
        assert x["group_size"] == len(ids) and x["keep_id"] == min(i for i in ids if i is not None)
    assert sum(x["kept"] for x in got) == len(classes)
    assert all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])
    kept = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "rid", "n"] and kept.count() == len(classes)


def test_exact_same_id_with_other_texts(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "x" * 80 + "a"), (1, "x" * 80 + "b"), (2, "x" * 80 + "a"), (3, "x" * 80 + "b")])).collect()
    assert sorted((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in got) == [(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 1, 2, False)]


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (exact_dedup.exact_dedup, exact_dedup.drop_exact_copies, simhash.near_duplicates, simhash.drop_near_copies, span_dedup.remove_repeated_spans, suffix_dedup.remove_repeats):
        assert f(none).count() == 0


def test_exact_dedup_where_scans_number_rows_differently(spark, monkeypatch):
    """The first round's counts come from a scan that numbers the rows from behind."""
    labels, save = [], exact_dedup.save

    def other_numbers(df, label):
        labels.append(label)
        return save(df.withColumn("first", 2 - F.col("first")) if labels.count("counts") == 1 and label == "counts" else df, label)

    monkeypatch.setattr(exact_dedup, "save", other_numbers)
    rows = [(0, "a"), (1, "a"), (2, "b" * 100), (3, "b" * 100)]
    got = exact_dedup.exact_dedup(frame(spark, rows).coalesce(1)).collect()
    assert sorted((x["doc_id"], x["keep_id"], x["kept"]) for x in got) == [(0, 0, True), (1, 0, False), (2, 2, True), (3, 2, False)]


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay():
    words23 = np.random.default_rng(2).integers(0, 1 << 23, 500)
    row, code = simhash.nearby(words23, 23)
    assert set(np.bincount(row)) == {1, 6}
    for w in words23[:50]:
        for a in range(23):
            b = (a * 7 + 3) % 23
            u = simhash.nearby(np.array([w]), 23)[1]
            v = simhash.nearby(np.array([w ^ (1 << a) ^ (1 << b)]), 23)[1]
            assert set(u) & set(v)


def test_every_pair_within_four_bits_shares_a_bucket():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 4):
        for _ in range(150):
            a = r.integers(0, 1 << 63, 1).astype(np.uint64)
            b = a.copy()
            for bit in r.choice(64, n, replace=False):
                b ^= np.uint64(1 << int(bit))
            assert set(simhash.bucket_keys(a)[0]) & set(simhash.bucket_keys(b)[0])


def test_near_duplicates(spark, rows):
    r = random.Random(9)
    text = words(r, 400)
    near = list(rows) + [(400 + i, text + f" end{i}") for i in range(40)]
    got = simhash.near_duplicates(frame(spark, near)).collect()
    prints = [brute_print(t) for _, t in near]
    parent = list(range(len(near)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(near)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(near):
        low[root(i)] = min(x for x in (low.get(root(i)), d) if x is not None) if (low.get(root(i)) is not None or d is not None) else None
    want = sorted((str(d), f"{p:016x}", str(low[root(i)])) for i, ((d, _), p) in enumerate(zip(near, prints)))
    assert sorted((str(x["doc_id"]), x["fingerprint"], str(x["component_id"])) for x in got) == want
    assert sum(x["kept"] for x in got) == len(low)
    assert simhash.drop_near_copies(frame(spark, near)).count() == len(low)


def test_hot_bucket_links():
    base = np.uint64(0x123456789ABCDEF0)
    prints = np.array(sorted({int(base ^ np.uint64(1 << a) ^ np.uint64(1 << b)) for a in range(20) for b in range(20)}), np.uint64)
    u, v = simhash.run_links(np.zeros(len(prints), np.int64), prints, 4)
    forest = simhash._forest(zip(u.tolist(), v.tolist()), {})
    assert len(forest) == len(prints) - 1


def test_split_buckets_lose_no_link(spark, monkeypatch):
    """A family of fingerprints that share most keys, among others: split at 30 rows a bucket and whole."""
    r = random.Random(3)
    base = 0x123456789ABCDEF0
    family = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(300)}
    others = {r.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(x),) for x in family | others], "fp long")

    def groups(links):
        parent = {}
        for a, b in links:
            simhash._forest([(a, b)], parent)
        find = lambda x: x if parent.get(x, x) == x else find(parent[x])
        out = {}
        for x in parent:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    every = sorted(family | others)
    want = groups((signed(a), signed(b)) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 4)
    for limit in (30, 20_000):
        monkeypatch.setattr(simhash, "HOT_BUCKET", limit)
        assert groups((x["u"], x["v"]) for x in simhash.links(prints).collect()) == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {x["node"]: x["root"] for x in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def brute_cut(rows, length):
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    r = random.Random(6)
    passage = words(r, 60)
    rows = [(i, words(r, r.randint(0, 40)) + passage[: r.randint(0, 300)] + words(r, r.randint(0, 40))) for i in range(40)]
    rows += [(50, "a" * 350), (51, "ab" * 200 + "a" * 150), (52, None), (53, "é" * 120), (54, passage * 3), (55, "x" * 99), (56, passage), (57, passage)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_cut(rows, 100)


def test_suffix_order():
    r = np.random.default_rng(0)
    for t in range(60):
        x = r.integers(97, 97 + r.integers(1, 5), r.integers(1, 150)).astype(np.uint8)
        order = suffix_dedup.suffix_order(x, 12)
        raw = x.tobytes()
        cut = [raw[i : i + 12] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(x))) and cut == sorted(cut)


def test_spans_remove_a_passage_but_not_clean_texts(spark):
    r = random.Random(8)
    sentence = lambda: words(r, r.randint(3, 14)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    texts = [" ".join(sentence() for _ in range(6)) for _ in range(12)]
    rows = [(i, f"{t}\n{passage}\n{t[::-1]}" if i % 2 else t) for i, t in enumerate(texts)] + [(20, None), (21, "")]
    got = {x["doc_id"]: x for x in span_dedup.remove_repeated_spans(frame(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["clean_text"] == rows[1][1]
    for i in (3, 5, 7, 9, 11):
        assert got[i]["removed_bytes"] > 0.75 * len(passage) and texts[i][:40] in got[i]["clean_text"]
    for i in (0, 2, 4, 20, 21):
        assert got[i]["n_removed"] == 0


def thue_morse(n, a, b):
    """The two words that polynomial hashes modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def shared_spans(passages, r):
    """Of passages set into two texts each, those that share a span there."""
    texts = [f"{words(r, r.randint(1, 30))} {p} {words(r, r.randint(1, 30))}".encode() for p in passages for _ in range(2)]
    who, _, name, _ = span_dedup.spans(span_dedup.Sentences(texts), span_dedup.SENTENCES)
    held = [set() for _ in texts]
    for w, h in zip(who.tolist(), name.tolist()):
        held[w].add(h)
    return [i for i in range(len(passages)) if held[2 * i] & held[2 * i + 1]]


def test_passages_share_spans():
    r = random.Random(21)
    sentence = lambda n: words(r, n) + r.choice(".!?")
    whole = [". " + " ".join(sentence(r.randint(1, 40)) for _ in range(3)) for _ in range(200)]
    assert len(shared_spans(whole, r)) == 200  # three whole sentences of any length
    assert len(shared_spans([f". {sentence(30)} {sentence(30)}" for _ in range(50)], r)) == 0  # two are no run of three
    assert len(shared_spans([words(r, 60) for _ in range(200)], r)) >= 180  # no full stop at all
    dotted = [" ".join(sentence(r.randint(3, 14)) for _ in range(8)) for _ in range(200)]
    assert len(shared_spans([" ".join(x.split()[2:53]) for x in dotted], r)) >= 180  # cut anywhere out of sentences


def test_short_whole_sentences_go_and_long_ones_stay_whole(spark):
    r = random.Random(5)
    three = " ".join(words(r, 15).capitalize() + "." for _ in range(3))
    rows = [(1, f"One begins. {three} One ends."), (2, f"Two begins. {three} Two ends."), (3, words(r, 40).capitalize() + ".")]
    got = {x["doc_id"]: x for x in span_dedup.remove_repeated_spans(frame(spark, rows)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 3, 0] and got[2]["clean_text"] == "Two begins. Two ends."
    assert [got[i]["n_sentences"] for i in (1, 2, 3)] == [5, 5, 1]


def brute_sentences(text, long, window):
    """(words, first word of each sentence) by the rules in the module's docstring."""
    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    starts = [i for i, (a, _) in enumerate(found) if i == 0 or raw[found[i - 1][1] - 1 : found[i - 1][1]] in (b".", b"!", b"?") or b"\n" in raw[found[i - 1][1] : a]]
    h = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in found]
    cut = set(starts)
    for a, b in zip(starts, starts[1:] + [len(found)]):
        for i in range(a, b - window + 1) if b - a > long else ():
            low = min(h[i : i + window])
            last = max(j for j in range(i, i + window) if h[j] == low)
            if last + 1 < len(found):
                cut.add(last + 1)
    return raw, found, sorted(cut) if found else []


def brute_spans(rows, k, long, window):
    texts = [brute_sentences(t, long, window) for _, t in rows]
    runs, first = [], {}
    for n, ((i, _), (raw, found, cuts)) in enumerate(zip(rows, texts)):
        edges = cuts + [len(found)]
        mine = [(a, a + k) for a in range(len(cuts) - k + 1)]
        runs.append([(a, b, tuple(raw[x:y] for x, y in found[edges[a] : edges[b]])) for a, b in mine])
        for _, _, run in runs[-1]:
            first[run] = min(first.get(run, (1 << 63, 0)), ((1 << 62) if i is None else i, n))
    out = []
    for n, ((i, _), (raw, found, cuts)) in enumerate(zip(rows, texts)):
        gone, seen = set(), set()
        for a, b, run in runs[n]:
            if run in seen or first[run][0] < ((1 << 62) if i is None else i):
                gone.update(range(a, b))
            seen.add(run)
        bounds = [found[c][0] for c in cuts] + [len(raw)]
        kept = raw[: bounds[0]] + b"".join(raw[bounds[c] : bounds[c + 1]] for c in range(len(cuts)) if c not in gone)
        out.append((i, len(cuts), len(gone), sum(c - 1 not in gone for c in gone), len(raw) - len(kept), kept.decode()))
    return out


def test_spans_are_removed_as_brute_force_says(spark):
    r = random.Random(12)
    sentence = lambda: words(r, r.choice([1, 2, 9, 30, 60])).capitalize() + r.choice([".", "!", "?", "\n", ". \n"])
    shared = [" ".join(sentence() for _ in range(r.randint(3, 8))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(sentence() for _ in range(r.randint(0, 4))) for _ in range(3)]
        rows.append((i, f"{parts[0]} {r.choice(shared)[r.randint(0, 9):]} {parts[1]} {r.choice(shared)} {parts[2]}"))
    one, other = thue_morse(2048, "e", "x")
    rows += [(60, "no. " * 40), (61, "no. " * 30), (62, rows[3][1]), (62, rows[3][1]), (63, None), (63, ""), (63, " \n "), (64, f"{one} " * 30), (65, f"{other} " * 30), (66, shared[0] * 40)]
    # One id with other texts: the later ones keep what only their own id has before them.
    rows += [(1000, shared[0]), (1000, "a b c"), (1001, shared[1] + " tail end"), (1001, shared[1]), (1001, "short")]
    rows += [(None, shared[2])]
    got = span_dedup.remove_repeated_spans(frame(spark, rows)).collect()
    want = brute_spans(rows, span_dedup.SENTENCES, span_dedup.LONG, span_dedup.WINDOW)
    key = lambda x: (str(x[0]), *map(str, x[1:]))
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)


def test_short_passages_of_long_sentences_go(spark):
    """51 words cut anywhere out of sentences of 20 to 38 words, where no three whole ones stand side by side."""
    r = random.Random(31)
    long = lambda: words(r, r.randint(20, 38)).capitalize() + "."
    rows, passages = [], []
    for i in range(60):
        source = " ".join(long() for _ in range(5))
        at = r.randint(0, 40)
        passages.append(source.split()[at : at + 51])
        rows += [(i, source), (100 + i, f"{long()} {words(r, 9)} {' '.join(passages[-1])} {words(r, 7)}. {long()}"), (200 + i, f"{long()} {long()} {long()}")]
    rows += [(300, " ".join(passages[0][:31]) + " " + long()), (301, " ".join(passages[1])), (302, " ".join(passages[1])), (303, long() + " " + " ".join(passages[2] * 2))]
    got = {x["doc_id"]: x for x in span_dedup.remove_repeated_spans(frame(spark, rows)).collect()}
    for i, text in rows:
        x, was = got[i], text.split()
        left = x["clean_text"].split()
        if 100 <= i < 200 or i > 300:
            assert x["n_removed"] > 0 and x["removed_bytes"] > 0 and len(was) - len(left) >= span_dedup.STRETCH
        else:
            assert x["n_removed"] == x["n_spans"] == 0 and x["clean_text"] == text
        if 100 <= i < 200:  # one run of the passage and nothing else
            a = next((n for n, (p, q) in enumerate(zip(was, left)) if p != q), len(left))
            b = len(was) - len(left)
            assert x["n_spans"] == 1 and was[:a] + was[a + b :] == left
            assert " ".join(was[a : a + b]) in " ".join(passages[i - 100]) or was[a - 1] == was[a + b - 1]


def runs_of(text, n):
    w = text.split()
    return [tuple(w[a : a + n]) for a in range(len(w) - n + 1)]


def test_every_long_repeat_loses_words_and_only_repeats_do(spark):
    r = random.Random(33)
    sentence = lambda: words(r, r.choice([1, 4, 12, 25, 38])).capitalize() + r.choice([".", "!", "\n", ""])
    shared = " ".join(sentence() for _ in range(40)).split()
    rows = []
    for i in range(150):
        at, n = r.randint(0, len(shared) - 130), r.choice([20, 31, 48, 49, 51, 60, 120])
        rows.append((i, f"{sentence()} {words(r, 60)}. {' '.join(shared[at : at + n])} {words(r, 60)} {sentence()}"))
    got = {x["doc_id"]: x for x in span_dedup.remove_repeated_spans(frame(spark, rows)).collect()}
    seen, short, three, hit = set(), set(), set(), 0
    for i, text in rows:
        repeat = any(x in seen for x in runs_of(text, span_dedup.REPEAT))
        hit += repeat
        _, found, cuts = brute_sentences(text, span_dedup.LONG, span_dedup.WINDOW)
        edges, w = [*cuts, len(found)], text.split()
        mine = {tuple(w[edges[a] : edges[a + 3]]) for a in range(len(cuts) - 2)}
        if repeat:
            assert got[i]["n_removed"] > 0
        elif not mine & three and not any(x in short for x in runs_of(text, span_dedup.STRETCH)):
            assert got[i]["n_removed"] == 0 and got[i]["clean_text"] == text
        seen.update(runs_of(text, span_dedup.REPEAT)), short.update(runs_of(text, span_dedup.STRETCH)), three.update(mine)
    assert hit > 30


def test_stretches_do_not_depend_on_what_stands_around():
    r = random.Random(35)
    passage = words(r, span_dedup.REPEAT)
    texts = [f"{words(r, r.randint(0, 60))} {passage} {words(r, r.randint(0, 60))}".encode() for _ in range(50)] + [b"", b"x", (" ".join(["a"] * 48)).encode(), passage.encode()]
    who, at, name, check = span_dedup.stretches(span_dedup.Sentences(texts))
    alone = set(zip(name[who == 53].tolist(), check[who == 53].tolist()))
    assert len(alone) == 1 and not {50, 51, 52} & set(who.tolist())
    for i in range(50):
        assert alone <= set(zip(name[who == i].tolist(), check[who == i].tolist()))
    held = {}
    for i, a, n in zip(who.tolist(), at.tolist(), name.tolist()):
        assert held.setdefault(n, run := tuple(texts[i].split()[a : a + span_dedup.STRETCH])) == run and len(run) == span_dedup.STRETCH


def test_suffix_dedup_where_names_are_hot(spark, monkeypatch):
    """A common line with other neighbours each time: its names are split twice, the results stay."""
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 2000)
    r = random.Random(17)
    line = words(r, 30)[:130]
    rows = [(i, words(r, r.randint(20, 30)) + line[: r.choice([30, 70, 99, 130])] + words(r, r.randint(20, 30))) for i in range(60)]
    rows += [(100 + i, rows[i][1][5:]) for i in range(0, 60, 3)] + [(200, "ab" * 700), (201, "ab" * 700), (202, "c" * 5000)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_cut(rows, 100)


def test_suffix_dedup_of_unusual_rows(spark):
    """Null ids come last, equal rows are one document, texts of one id follow by hash."""
    r = random.Random(18)
    passage, other = words(r, 60), words(r, 60)
    rows = [(5, passage), (5, passage), (None, passage + "!"), (None, None), (6, "tail " + other), (6, other), (7, "z" * 3_000_000)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    removed = {}
    for x in got:
        removed.setdefault(x["doc_id"], []).append((x["n_bytes"], x["n_removed"]))
    assert removed[5] == [(len(passage), 0)] * 2 and removed[7] == [(3_000_000, 2_999_999)]
    assert sorted(removed[None]) == [(0, 0), (len(passage) + 1, len(passage))]
    assert sorted(n for _, n in removed[6]) == [0, len(other)]


def test_null_and_repeated_rows_of_the_pipeline_stages(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (3, text + " x"), (3, text + " x"), (4, None), (4, ""), (5, text)]
    exact = exact_dedup.drop_exact_copies(frame(spark, rows)).collect()
    assert sorted((str(x["doc_id"]), x["text"]) for x in exact if x["text"]) == [("3", text + " x"), ("5", text)] and len(exact) == 3
    near = simhash.drop_near_copies(frame(spark, rows)).collect()
    # The two texts' fingerprints link, so one document of theirs stays, and one of the two without words.
    assert (brute_print(text) ^ brute_print(text + " x")).bit_count() <= 4 < brute_print(text).bit_count()
    assert sorted(bool(x["text"]) for x in near) == [False, True]


def test_suffix_order_of_wanted_starts():
    r = np.random.default_rng(8)
    for k in range(200):
        text = r.integers(0, int(r.integers(1, 4)), int(r.integers(1, 150))).astype(np.uint8)
        text[: len(text) // 2] = text[: len(text) // 2] if k % 4 else 0
        wanted, depth = r.random(len(text)) < r.random(), int(r.integers(1, 12))
        order = suffix_dedup.suffix_order(text, depth, wanted)
        order = order[wanted[order]]
        heads = [bytes(np.r_[text, np.zeros(depth, np.uint8)][i : i + depth]) for i in order.tolist()]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and heads == sorted(heads)


def test_repeated_starts_in_first_and_second_places():
    r = random.Random(14)
    for length in (4, 8, 13):
        for _ in range(60):
            contexts = list(dict.fromkeys(bytes(r.choice(b"ab") for _ in range(r.randint(length, length + 12))) for _ in range(r.randint(1, 6))))
            places = [(r.randint(-2, 3), i, 100 * i) for i in range(2 * len(contexts))]
            pairs = [sorted(p) if r.random() < 0.6 else [p[0], None] for p in zip(places[::2], places[1::2])]
            first = {}
            for context, pair in zip(contexts, pairs):
                for key, row, start in filter(None, pair):
                    for i in range(len(context) - length + 1):
                        window = context[i : i + length]
                        first[window] = min(first.get(window, (key, row, start + i)), (key, row, start + i))
            want = [[i for i in range(len(c) - length + 1) if p and first[c[i : i + length]] != (p[0], p[1], p[2] + i)] for c, pair in zip(contexts, pairs) for p in pair]
            got = suffix_dedup.repeated_starts(contexts, [p[0] for p in pairs], [p[1] for p in pairs], length)
            assert [x.tolist() for x in got] == want
