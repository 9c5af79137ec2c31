"""Substring dedup by sliding sentence spans.

Sentences end at . ! ? and at line ends. Every run of ``sentences`` consecutive sentences is a span, however
short they are. Spans are hashed over their words (white space does not count) and joined over all
documents; sentences under a span that a smaller document id, or the same document before, also has are removed.

Fallback for text without punctuation: a sentence of more than ``long`` words would hide any passage in
it, so it counts as several, cut behind the word of smallest hash in each window of ``window`` of its words. Those parts
line up wherever a passage begins, and none is longer than a window. Sentences up to ``long`` words are never cut.

What that means for a repeated passage: its whole sentences go if there are ``sentences`` of them side by side; a first and
last sentence that the passage only holds in part stays.

Fallback for passages of fewer whole sentences: of all runs of 32 words in any 49 words of a text the one of smallest hash is a
stretch, whatever sentences it lies in, so two texts that share 49 words share a stretch. Stretches are joined like spans. Where a
repeated one touches no sentence that its spans remove, its words go and count as one removed run; the sentences that lose
them count as removed. Of such a passage fewer than 18 words stay at either end.

A span's name has 96 bits from two chained hashes over 64-bit word hashes, each distinct word of a
slice hashed from its bytes. Two different spans meet only by an accident of all 96.

Hashes are summed before they shuffle, and the join of repeated hashes is one that adaptive
execution splits where a passage is everywhere.

Defined results: null and empty texts have no sentences; a null id comes after all others, by text;
a very long text is worked on whole; rows of one id count as one document for what is first, each keeping its own text; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, distinct_runs, documents, ragged, release, save, slices

SENTENCES, LONG, WINDOW = 3, 40, 13
#: Words of a stretch (a power of two), and of a repeat that surely holds one.
STRETCH, REPEAT = 32, 49
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_MIX = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def word_hashes(raw: np.ndarray, white: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of all words of ``raw``."""
    words, which = distinct_runs(raw[~white], end - start)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[which]


class Sentences:
    """Words and sentences of texts. Arrays: start, end (bytes of each word), word (its hash), text (which text it is in), first (word of
    each sentence, and the number of words at last), edges (first sentence of each text, and their number at last)."""

    def __init__(self, texts: list[bytes], long: int = LONG, window: int = WINDOW):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.begins = np.cumsum([1, *(len(x) + 1 for x in texts[:-1])]) if texts else np.zeros(0, np.int64)
        white = _WHITE[raw]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.start)
        text = np.searchsorted(self.begins, self.start, side="right")
        lines = np.cumsum(raw == 0x0A)
        new = np.ones(n, bool)
        new[1:] = (text[1:] != text[:-1]) | (lines[self.start[1:]] != lines[self.start[:-1]]) | _STOP[raw[self.end[:-1] - 1]]
        self.word = word_hashes(raw, white, self.start, self.end)
        if n >= window:  # in long sentences, behind the last smallest hash of every window
            sentence = np.cumsum(new) - 1
            size = np.bincount(sentence)
            inside = np.flatnonzero((sentence[: n - window + 1] == sentence[window - 1 :]) & (size[sentence[: n - window + 1]] > long))
            windows = np.lib.stride_tricks.sliding_window_view(self.word, window)[inside, ::-1]
            behind = inside + window - windows.argmin(axis=1)
            new[behind[behind < n]] = True
        cuts = np.flatnonzero(new)
        self.first = np.r_[cuts, n]
        self.text = text - 1
        self.edges = np.searchsorted(text[cuts], np.arange(1, len(texts) + 2))


def run_names(word: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name, 32 more bits) of the runs of words [first, last)."""
    state = [np.full(len(first), k, np.uint64) for k in _MIX]
    n = last - first
    live = np.arange(len(first))
    for j in range(int(n.max(initial=0))):
        if j and (n[live] <= j).any():
            live = live[n[live] > j]
        w = word[first[live] + j]
        for i in (0, 1):
            x = (state[i][live] ^ w) * _MIX[i]
            state[i][live] = x ^ (x >> np.uint64(29 + i))
    name = state[0] * _MIX[1]
    return (name ^ name >> np.uint64(32)).view(np.int64), (state[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans(s: Sentences, sentences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence in it, name, check) of all spans, in order."""
    m = len(s.first) - 1
    if m < sentences:
        return (np.zeros(0, np.int64),) * 4
    text = np.repeat(np.arange(len(s.edges) - 1), np.diff(s.edges))
    a = np.flatnonzero(text[: m - sentences + 1] == text[sentences - 1 :])
    return text[a], a - s.edges[:-1][text[a]], *run_names(s.word, s.first[a], s.first[a + sentences])


def _over(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` values in a row."""
    step = 1
    while 2 * step <= width:
        x, step = best(x[:-step], x[step:]), 2 * step
    return best(x[: len(x) - width + step], x[width - step :]) if step < width else x


def stretches(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, name, check) of all stretches, in order."""
    if len(s.word) < REPEAT:
        return (np.zeros(0, np.int64),) * 4
    name = check = s.word
    step = 1
    while step < STRETCH:  # two halves make a name
        name = name[:-step] * _MIX[0] ^ name[step:]
        name = (name ^ name >> np.uint64(32)) * _MIX[1]
        check = check[:-step] * _MIX[1] + check[step:]
        check = (check ^ check >> np.uint64(29)) * _MIX[0]
        step *= 2
    name |= np.uint64(1)
    width = REPEAT - STRETCH + 1
    least = _over(np.minimum, name, width)
    least[s.text[: len(least)] != s.text[REPEAT - 1 :]] = 0  # no 49 words of one text
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_over(np.maximum, np.concatenate([none, least, none]), width) == name)
    text = s.text[at]
    return text, at - s.first[s.edges[text]], name[at].view(np.int64), (check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _span_rows(sentences: int, long: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                s = Sentences(byte_texts(part), long, window)
                both = spans(s, sentences), stretches(s)
                who, first, name, check = (np.concatenate(x) for x in zip(*both, strict=True))
                first = first << 1 | np.repeat([0, 1], [len(x[0]) for x in both])
                order = np.lexsort((check, name, who))  # stable: the first one stays first
                again = np.zeros(len(who), bool)  # in its own document
                again[order[1:]] = (who[order[1:]] == who[order[:-1]]) & (name[order[1:]] == name[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
                take = lambda c: pa.array(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[who])
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(check, pa.int32()), take("key"), take("hash"), pa.array(first << 1 | again, pa.int64())], ["name", "check", "key", "hash", "span"])

    return run


def _cleaned(sentences: int, long: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = byte_texts(part)
                s = Sentences(texts, long, window)
                word_edges = s.first[s.edges]
                n_sent, n_gone, n_spans, gone_bytes, kept = np.diff(s.edges).tolist(), [], [], [], []
                for i, (text, held) in enumerate(zip(texts, part.column("spans"), strict=True)):
                    if not held.is_valid:
                        n_gone.append(0), n_spans.append(0), gone_bytes.append(0), kept.append(text)
                        continue
                    packed = held.values.to_numpy()
                    place, stretch = packed >> 2, (packed & 2) > 0
                    gone = np.zeros(n_sent[i], bool)
                    gone[ragged(place[~stretch], np.full((~stretch).sum(), sentences))] = True
                    first = s.first[s.edges[i] : s.edges[i + 1] + 1] - word_edges[i]
                    words = np.repeat(gone, np.diff(first))
                    if stretch.any():  # those that touch no removed sentence
                        place = place[stretch]
                        upto = np.r_[0, np.cumsum(gone)]
                        head, tail = (np.searchsorted(first, x, side="right") for x in (place, place + STRETCH - 1))
                        place = place[upto[tail] == upto[head - 1]]
                        words[ragged(place, np.full(len(place), STRETCH))] = True
                        gone = np.logical_or.reduceat(words, first[:-1])
                    flips = np.diff(np.r_[False, words, False].astype(np.int8))
                    bounds = np.r_[s.start[word_edges[i] : word_edges[i + 1]] - s.begins[i], len(text)]
                    a, b = bounds[np.flatnonzero(flips == 1)], bounds[np.flatnonzero(flips == -1)]
                    rest = b"".join(text[x:y] for x, y in zip(np.r_[0, b].tolist(), np.r_[a, len(text)].tolist(), strict=True))
                    n_gone.append(int(gone.sum())), n_spans.append(len(a)), gone_bytes.append(len(text) - len(rest)), kept.append(rest)
                columns = [pa.array(x, pa.int64()) for x in (n_sent, n_gone, n_spans, gone_bytes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "n_spans", "removed_bytes", "clean_text"])

    return run


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, long: int = LONG, window: int = WINDOW) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences removed, whole or in part), n_spans (removed runs), removed_bytes, clean_text."""
    hashed = F.xxhash64("text")
    key = F.coalesce("doc_id", F.lit(1 << 62) + hashed.bitwiseAND((1 << 61) - 1))  # null ids: behind the others, by text
    rows = documents(docs, id_col, text_col).select(key.alias("key"), hashed.alias("hash"), "doc_id", "text")
    found = rows.select("key", "hash", "text").mapInArrow(_span_rows(sentences, long, window), "name long, check int, key long, hash long, span long")
    again = F.col("span").bitwiseAND(1) == 1
    # Written before the join, so that adaptive execution can split a passage that is everywhere.
    firsts = save(found.filter(~again).groupBy("name", "check").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("name", "check", "first"), "firsts")
    # Repeats inside a document are known already; they spread by their place and not by their name.
    spread = found.withColumn("name", F.when(again, F.xxhash64("key", "span")).otherwise(F.col("name")))
    later = spread.join(firsts.hint("shuffle_hash"), ["name", "check"], "left").filter(again | (F.col("key") > F.col("first")))
    per = save(later.groupBy("key", "hash").agg(F.collect_set("span").alias("spans")), "spans")
    release(firsts)
    return rows.join(per, ["key", "hash"], "left").select("doc_id", "text", "spans").mapInArrow(_cleaned(sentences, long, window), "doc_id long, n_sentences long, n_removed long, n_spans long, removed_bytes long, clean_text string")
