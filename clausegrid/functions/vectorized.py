"""Order-dependent helpers that expressions cannot hold: small functions over Arrow batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import text as T

# The rule under a table's header.
_RULE = re.compile(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*")
# End of fixed values.
KIND = Ty.ArrayType(Ty.StructType([Ty.StructField("table_no", Ty.IntegerType()), Ty.StructField("row_no", Ty.IntegerType())]))


def table_rows_of(lines: list[str]) -> list[dict | None]:
    """For every line its place in a table (row 0 is the header, -1 the rule under it), or None.

    A table opens at a pipe line whose next line is a rule with a pipe, and runs on while
    pipe lines follow; headings close it because they are no pipe lines."""
    pipe = [x.strip().startswith("|") and x.count("|") >= 2 for x in lines]
    rule = ["|" in x and _RULE.fullmatch(x) is not None for x in lines]
    out: list[dict | None] = [None] * len(lines)
    table, row = -1, None
    for i in range(len(lines)):
        if row == 0:
            row, place = 1, -1
        elif row is not None and pipe[i]:
            place, row = row, row + 1
        elif pipe[i] and i + 1 < len(lines) and rule[i + 1]:
            table, row, place = table + 1, 0, 0
        else:
            row = None
            continue
        out[i] = {"table_no": table, "row_no": place}
    return out


@F.pandas_udf(KIND)
def table_rows(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: table_rows_of(list(x)))


def grouped_sentences(sentences: list[str], target: int = 250, smallest: int = 120, overlap: int = 40) -> list[str]:
    """Groups of sentences of about ``target`` estimated tokens. A full group hands its shortest tail of
    ``overlap`` tokens to the next, unless that is all of it; a last group under half of ``smallest`` joins
    the one before. Lengths are running sums, so the work is linear in the text."""
    size = lambda chars: max(1, int(chars / 1.5))
    groups: list[str] = []
    held: list[str] = []
    chars = -1
    for s in sentences:
        held.append(s)
        chars += len(s) + 1
        if size(chars) < target:
            continue
        groups.append(" ".join(held))
        keep, tail = 0, -1
        while keep < len(held) and (keep == 0 or size(tail) < overlap):
            keep += 1
            tail += len(held[-keep]) + 1
        held, chars = (held[-keep:], tail) if keep < len(held) else ([], -1)
    if held:
        rest = " ".join(held)
        if groups and size(len(rest)) < smallest // 2:
            groups[-1] += " " + rest
        else:
            groups.append(rest)
    return groups


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def group_sentences(sentences: pd.Series) -> pd.Series:
    return sentences.map(lambda x: grouped_sentences(list(x)))


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector that depends only on the text (SHA-256 seeds a Gaussian)."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dim)
    return v / (np.linalg.norm(v) or 1.0)


#: Cells of the arrays that ``extent_scores`` works on at once, trigrams that are counted at once, and steps of a run.
EXTENT_CELLS, GRAM_SLICE, STEPS = 1 << 19, 2048, 32


def packed_of(words: pa.Array) -> pa.ListArray:
    """Packed trigrams, in order, of texts whose words stand one space apart."""
    texts = [f"  {x.replace(' ', '   ')} " if x else "" for x in words.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(code) < 3:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int64()))
    ends = np.cumsum(size)
    # a trigram has a letter in the middle or behind it, and does not reach into the next text
    real = (code[1:-1] != 0x20) | (code[2:] != 0x20)
    over = (ends[size > 0, None] - [1, 2]).ravel()
    real[over[over < len(real)]] = False
    grams = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[real]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.r_[real, False, False])][np.r_[0, ends]].astype(np.int32)), pa.array(grams))


@F.arrow_udf(Ty.ArrayType(Ty.LongType()))
def _packed(words: pa.Array) -> pa.Array:
    return packed_of(words)


def word_text(c: Column) -> Column:
    """A text's words one space apart: all that its trigrams depend on."""
    return F.array_join(T.words(c), " ")


def packed_words(c: Column) -> Column:
    """Trigrams of a ``word_text`` in order, each as one number: three code points of 21 bits."""
    return _packed(c)


def packed_trigrams(c: Column) -> Column:
    """Trigrams of a text in order, packed."""
    return packed_words(word_text(c))


def lists(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values end to end, length of each list)."""
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def extent_scores(asked: np.ndarray, n: np.ndarray, member: np.ndarray, text: np.ndarray, code: np.ndarray, prev: np.ndarray, size: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
    """For each pair (asked, text) the best share of the asked trigrams against any run of the text's trigrams.

    ``n``: trigrams of each probe; ``member`` (probe, code): which they are; ``code`` and ``prev``: of every trigram of
    all texts end to end, its code and the place in its text where it stood last (-1: nowhere); ``size``: trigrams of
    each text; ``floor``: a score below which a pair's own does not matter (it then may come out lower).

    A best run begins at an asked trigram: every step takes the next such beginning of all pairs at once. Of h asked
    trigrams that are left a run reaches at most h / n, and a run of d different ones at most n / d, so beginnings and
    run lengths end where the best score so far, or the floor, is out of reach."""
    out = np.zeros(len(asked))
    begins = np.cumsum(size) - size
    by_size = np.argsort(size[text], kind="stable")
    floor = np.zeros(len(asked)) if floor is None else floor
    step = np.arange(STEPS)
    i = 0
    while i < len(by_size):
        rows = max(1, EXTENT_CELLS // max(1, int(size[text[by_size[min(i + 4096, len(by_size)) - 1]]])))
        pick = by_size[i : i + min(rows, 4096)]
        i += len(pick)
        t, p, least = text[pick], asked[pick], floor[pick]
        width = int(size[t].max(initial=0))
        if not width:
            continue
        place = np.arange(width)
        inside = place < size[t][:, None]
        at = np.where(inside, begins[t][:, None] + place, 0)
        hit = member[p[:, None], code[at]] & inside
        last = np.where(inside, prev[at], width)
        nth = np.cumsum(hit, axis=1)
        most = nth[:, -1]
        bound = (hit & (last < 0)).sum(1) / n[p]
        best = np.zeros(len(pick))
        for k in range(1, int(most.max()) + 1):
            reach = (most - k + 1) / n[p]
            live = np.flatnonzero((best < bound) & (reach > best) & (reach >= least))
            if not len(live):
                break
            first = (nth[live] >= k).argmax(1)
            come, d, h = first.copy(), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            while len(live):
                column = come[:, None] + step
                there = column < width
                column = np.minimum(column, width - 1)
                fresh = (last[live[:, None], column] < first[:, None]) & there
                shared = np.cumsum(fresh & hit[live[:, None], column], axis=1) + h[:, None]
                different = np.cumsum(fresh, axis=1) + d[:, None]
                best[live] = np.maximum(best[live], (shared / (n[p[live], None] + different - shared)).max(1))
                come, d, h = come + STEPS, different[:, -1], shared[:, -1]
                on = (come < size[t[live]]) & (d * np.maximum(best[live], least[live]) <= n[p[live]])
                live, first, come, d, h = live[on], first[on], come[on], d[on], h[on]
        out[pick] = best
    return out


def coded(vocabulary: np.ndarray, grams: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each trigram in the sorted vocabulary, its length for others; place of the same trigram before it in its
    text, or -1; text of each) of texts end to end."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
    code = np.searchsorted(vocabulary, grams)
    known = code < len(vocabulary)
    known[known] = vocabulary[code[known]] == grams[known]
    prev = np.full(len(grams), -1)
    order = np.lexsort((grams, owner))
    same = (grams[order[1:]] == grams[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    prev[order[1:][same]] = place[order[:-1][same]]
    return np.where(known, code, len(vocabulary)), prev, owner


def floors(score: np.ndarray, pool: int) -> np.ndarray:
    """The ``pool``-th greatest value of every row, 0 in shorter rows; as a column."""
    if score.shape[1] <= pool:
        return np.zeros((len(score), 1))
    return np.partition(score, score.shape[1] - pool, axis=1)[:, score.shape[1] - pool, None]


def best_places(score: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``pool`` greatest positive values of every row, ties to the smaller column."""
    row, column = np.nonzero((score >= floors(score, pool)) & (score > 0))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < pool
    return row[keep], column[keep]


def trigram_scores(asked: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray], pool: int, words: bool, least: np.ndarray) -> np.ndarray:
    """(probe, text): set similarity of trigrams; with ``words`` the greater of it and word similarity.

    ``asked``: each probe's different trigrams, ``texts``: each text's in order; both as (values end to end, lengths).
    Word similarity is at most shared / asked. It is worked out for the ``pool`` highest bounds of a probe and then for
    every bound that reaches the probe's ``pool``-th score so far, and never where the bound is under ``least``, the score
    that a probe's hits must reach; elsewhere it cannot enter the pool and stays out."""
    n, size = asked[1], texts[1]
    vocabulary = np.unique(asked[0])
    code, prev, owner = coded(vocabulary, *texts)
    different = np.bincount(owner[prev < 0], minlength=len(size))
    member = np.zeros((len(n), len(vocabulary) + 1), bool)
    member[np.repeat(np.arange(len(n)), n), np.searchsorted(vocabulary, asked[0])] = True
    once = (prev < 0) & (code < len(vocabulary))
    shared = np.zeros((len(n), len(size)), np.float32)
    for i in range(0, len(vocabulary), GRAM_SLICE):
        left = member[:, i : min(i + GRAM_SLICE, len(vocabulary))].astype(np.float32)
        mine = once & (code >= i) & (code < i + left.shape[1])
        right = np.zeros((left.shape[1], len(size)), np.float32)
        right[code[mine] - i, owner[mine]] = 1
        shared += left @ right
    shared = shared.astype(np.float64)
    score = shared / np.maximum(n[:, None] + different - shared, 1)
    if words and score.size:
        share = shared / np.maximum(n, 1)[:, None]
        bound = np.where((share > score) & (share >= least[:, None]), share, 0)
        for first in (True, False):
            floor = least if first else np.maximum(least, floors(score, pool)[:, 0])
            p, t = best_places(bound, pool) if first else np.nonzero((bound > 0) & (bound >= floor[:, None]))
            score[p, t] = np.maximum(score[p, t], extent_scores(p, n, member, t, code, prev, size, floor[p]))
            bound[p, t] = 0
    return np.where(score >= least[:, None], score, 0)


def pair_scores(asked: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray], floor: np.ndarray | None = None) -> np.ndarray:
    """Word similarity of each probe with the text of the same place; below ``floor`` it may come out lower."""
    n, size = asked[1], texts[1]
    vocabulary = np.unique(asked[0])
    code, prev, _ = coded(vocabulary, *texts)
    own = np.searchsorted(vocabulary, asked[0])
    edges = np.r_[0, np.cumsum(n)]
    out = np.zeros(len(n))
    for i in range(0, len(n), 512):
        row = np.arange(i, min(i + 512, len(n)))
        member = np.zeros((len(row), len(vocabulary) + 1), bool)
        member[np.repeat(row - i, n[row]), own[edges[i] : edges[row[-1] + 1]]] = True
        out[row] = extent_scores(row - i, np.maximum(n[row], 1), member, row, code, prev, size, None if floor is None else floor[row])
    return out


def word_similarity_of(asked: set, text: list) -> float:
    """Word similarity of one set of trigrams with one text's trigrams in order."""
    number = {g: i for i, g in enumerate({*asked, *text})}
    one = lambda grams: (np.array([number[g] for g in grams], np.int64), np.array([len(grams)]))
    return float(pair_scores(one(asked), one(text))[0])


@F.pandas_udf(Ty.DoubleType())
def word_similarity(asked: pd.Series, text: pd.Series) -> pd.Series:
    """Word similarity of packed trigrams: ``asked`` different ones, ``text`` in order."""
    flat = lambda s: (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in s)]), np.array([len(x) for x in s], np.int64))
    return pd.Series(pair_scores(flat(asked), flat(text)))
