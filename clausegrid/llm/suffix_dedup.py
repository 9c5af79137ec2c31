"""Substring dedup of bytes with two-stage suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller
document id, or earlier in the same document). Strings never cross documents.

1. Anchors. Every window of ``length`` bytes is named by the smallest hash among its
   grams, so equal windows have equal names wherever they stand. Windows in a row with
   one name form a run, about one run for 40 bytes. Names that occur once are unique
   windows and end here (counts are summed before they shuffle).
2. Contexts. The bytes under each remaining run are cut out by the task that holds the text. Of
   equal contexts in a task the first occurrence stands for all and the others' ranges go at
   once, so a passage that very many documents share costs a row for each task.
3. Hot names. A name whose contexts are more than a task should sort (``HEAVY_BYTES``: a gram that
   stands in very many texts with other neighbours each time) is split: windows get new names from
   all the bytes that the windows with the gram in the same part of them share, in ``PARTS`` parts
   first and then, where that is still too much, one for each offset - the whole window. Equal windows keep
   equal names, and windows of one whole-window name are equal, so no name stays hot.
4. Suffix arrays. Contexts meet by name. Those that stand in two places, differ or repeat inside
   themselves are laid end to end and suffix-sorted in two stages: suffixes smaller than their
   successors are sorted directly, the rest is induced by scanning the buckets in order. Adjacent
   common prefixes of ``length`` bytes or more give the repeated windows; the earliest start stays.
   Equal contexts lie there once and count in their two first places; further places go as the second.
5. The removed byte ranges of a document are united and cut out.

Names only decide what meets; equality is decided on bytes. No limit drops a candidate.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; a null id
comes after all others; rows with equal id and text are one document, each row with its
result; rows of one id with other texts follow in order of the texts' hashes; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, identified, ragged, release, save, slices

LENGTH, GRAM = 100, 24
#: Bytes of contexts that are suffix-sorted together.
SORT_BYTES = 1 << 20
#: Bytes of contexts from which a name is split, and the parts it is split into at first.
HEAVY_BYTES, PARTS = 1 << 20, 8
#: Starts in one run at most, so that no context is long.
RUN_STARTS = 1024
#: Bytes of contexts that a task holds before it hands them on.
HELD_BYTES = 16 << 20
CONTEXT = "name long, gram long, context binary, twice boolean, key long, rid long, lo long, hi long"
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every position of ``raw`` (uint8)."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,)).copy()
    words ^= words >> np.uint64(29)
    words *= _K[3]
    words ^= words >> np.uint64(32)
    out = words[:n] * _K[0]
    for j in range(1, GRAM // 8):
        out += words[8 * j : 8 * j + n] * _K[j]
    out ^= out >> np.uint64(31)
    out *= _K[3]
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, first start, number of starts, name's gram stands there twice) of all runs."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.sum():
        return (np.zeros(0, np.int64),) * 5
    width = length - GRAM + 1
    hashes = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    lows = sliding_min(hashes, width)
    at = ragged(begins, starts)
    names = lows[at]
    new = np.ones(len(at), bool)
    new[1:] = names[1:] != names[:-1]
    some = starts > 0
    new[(np.cumsum(starts) - starts)[some]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    name, a = names[first], at[first]
    b = a + count - 1
    twice = np.zeros(len(first), bool)
    look = np.arange(width)
    for i in range(0, len(first), 8192):
        part = slice(i, i + 8192)
        head = hashes[a[part, None] + look] == name[part, None]
        tail = hashes[b[part, None] + look] == name[part, None]
        twice[part] = (head.sum(1) > 1) | (tail.sum(1) > 1) | (a[part] + head.argmax(1) < b[part])
    who = np.repeat(np.arange(len(texts)), starts)[first]
    start = a - begins[who]
    if (count > RUN_STARTS).any():  # only where a gram repeats
        parts = -(-count // RUN_STARTS)
        before = ragged(np.zeros(len(parts), np.int64), parts) * RUN_STARTS
        who, name, start, count = (np.repeat(x, parts) for x in (who, name, start, count))
        start, count, twice = start + before, np.minimum(count - before, RUN_STARTS), np.repeat(twice | (parts > 1), parts)
    return who, name, start, count, twice


def suffix_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of ``text`` (uint8), ordered by their first ``depth`` bytes at least. With ``wanted``
    (mask) only those and the suffixes behind them from which they are induced."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # A suffix is like the last of its run of equal bytes: up (smaller than its successor) or down.
    run_end = np.r_[text[1:] != text[:-1], True]
    ends = np.flatnonzero(run_end)
    up = np.repeat(np.r_[text[ends[:-1]] < text[ends[:-1] + 1], False], np.diff(np.r_[-1, ends]))
    live = np.ones(n, bool)
    if wanted is not None:  # from each wanted suffix up to the next that is sorted directly
        at, ups = np.flatnonzero(wanted), np.flatnonzero(up)
        stop = np.r_[ups, n - 1][np.searchsorted(ups, at)] + 1
        live = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0
    direct = np.flatnonzero(up & live)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    views = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    direct = direct[np.argsort(views[direct].view(f"S{depth}").ravel(), kind="stable")]
    heads = text[direct]
    deep = np.flatnonzero(~up & live & (np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n) > depth))
    deep = deep[np.argsort(text[deep], kind="stable")]
    deep_letters = text[deep]
    down: dict[int, list[np.ndarray]] = {int(text[-1]): [np.array([n - 1])]}
    out = []
    for c in np.unique(text).tolist():
        lists = down.pop(c, [])
        level = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        bucket = [level]
        for _ in range(depth):  # runs of c: one more c in front
            level = level[level > 0] - 1
            level = level[(text[level] == c) & live[level]]
            if not len(level):
                break
            bucket.append(level)
        # Beyond depth their order is free.
        bucket.append(deep[np.searchsorted(deep_letters, c) : np.searchsorted(deep_letters, c, side="right")])
        bucket.append(direct[np.searchsorted(heads, c) : np.searchsorted(heads, c, side="right")])
        full = np.concatenate(bucket)
        out.append(full)
        before = full[full > 0] - 1
        before = before[(text[before] > c) & live[before]]
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]]) if len(letters) else np.zeros(0, np.int64)
        for part in np.split(before, cuts[1:]):
            if len(part):
                down.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in ``order`` has its first ``depth`` bytes in common with the one before it; all have that many."""
    wide = 8 if depth >= 8 else 1
    units = np.ndarray((len(text) - wide + 1,), f"<u{wide}", text.tobytes(), 0, (1,)).copy() if len(text) >= wide else text
    alike = np.arange(1, len(order))
    for offset in [*range(0, depth - wide, wide), depth - wide]:
        alike = alike[units[order[alike] + offset] == units[order[alike - 1] + offset]]
    out = np.zeros(len(order), bool)
    out[alike] = True
    return out


def repeated_starts(contexts: list[bytes], firsts: list[tuple[int, int, int]], seconds: list[tuple[int, int, int] | None], length: int) -> list[np.ndarray]:
    """For each context the starts whose window also stands earlier, in its first place and in its second (two items a
    context). Places are (id, row, start); a context without a second place stands once. Its suffixes are sorted once
    and count in both places."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    opens = np.arange(len(text)) + length <= (begins + sizes)[owner]  # a window starts there
    order = suffix_order(text, length, opens)
    order = order[opens[order]]
    if not len(order):
        return [order] * (2 * len(contexts))
    new = ~common_prefixes(text, order, length)
    group = np.cumsum(new) - 1
    who = owner[order]
    inside = order - begins[who]
    again = np.flatnonzero(np.array([p is not None for p in seconds], bool)[who])
    places = np.array([p or (0, 0, 0) for both in zip(firsts, seconds, strict=True) for p in both], np.int64).reshape(-1, 3)
    document = np.unique(places[:, :2], axis=0, return_inverse=True)[1].reshape(-1)
    at = (document << 32 | places[:, 2])[np.r_[2 * who, 2 * who[again] + 1]] + np.r_[inside, inside[again]]
    lowest = np.minimum.reduceat(at[: len(order)], np.flatnonzero(new))
    np.minimum.at(lowest, group[again], at[len(order) :])
    later = at > lowest[np.r_[group, group[again]]]
    found = np.sort((np.r_[2 * who, 2 * who[again] + 1] << 32 | np.r_[inside, inside[again]])[later])
    edges = np.searchsorted(found >> 32, np.arange(2 * len(contexts) + 1))
    return [found[edges[i] : edges[i + 1]] & 0xFFFFFFFF for i in range(2 * len(contexts))]


def _unite(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the half-open ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.r_[at[1:] - 1, len(hi) - 1]]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                who, name, start, count, twice = runs(byte_texts(part), length)
                take = lambda c: pa.array(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[who])
                span = start << 32 | count << 1 | twice
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(name, np.uint64).view(np.int64)), take("key"), take("rid"), pa.array(span, pa.int64())], ["name", "key", "rid", "span"])

    return run


class _Contexts:
    """Contexts met in one task: of equal ones the first place stands for all, the others' ranges go."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, bytes], list] = {}
        self.gone: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, name: int, gram: int, context: bytes, twice: bool, place: tuple[int, int, int]) -> None:
        entry = self.held.get((name, context))
        if entry is None:
            self.held[name, context] = [place, twice, gram]
            self.size += len(context) + 100
            return
        entry[1] |= twice
        if place != entry[0]:
            later = max(place, entry[0])
            entry[0] = min(place, entry[0])
            self.gone.append((*later, later[2] + len(context)))
            self.size += 40

    def rows(self) -> pa.RecordBatch:
        n = len(self.held)
        place = np.array([p for p, _, _ in self.held.values()], np.int64).reshape(-1, 3)
        ends = place[:, 2] + np.fromiter((len(c) for _, c in self.held), np.int64, n)
        gone = _unite_rows(np.array(self.gone, np.int64).reshape(-1, 4))
        m = len(gone)
        columns = [
            pa.array([k for k, _ in self.held] + [None] * m, pa.int64()), pa.array([g for _, _, g in self.held.values()] + [None] * m, pa.int64()),
            pa.array([c for _, c in self.held] + [None] * m, pa.binary()), pa.array([t for _, t, _ in self.held.values()] + [False] * m, pa.bool_()),
            *(pa.array(np.r_[place[:, i], gone[:, i]]) for i in range(3)), pa.array(np.r_[ends, gone[:, 3]]),
        ]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["name", "gram", "context", "twice", "key", "rid", "lo", "hi"])


def _unite_rows(ranges: np.ndarray) -> np.ndarray:
    """Rows (key, rid, lo, hi) with the ranges of each document united."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 2], ranges[:, 1], ranges[:, 0]))]
    edges = np.flatnonzero(np.r_[True, (ranges[1:, :2] != ranges[:-1, :2]).any(1), True])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        lo, hi = _unite(ranges[a:b, 2], ranges[a:b, 3])
        out.append(np.stack([np.full(len(lo), ranges[a, 0]), np.full(len(lo), ranges[a, 1]), lo, hi], axis=1))
    return np.concatenate(out)


def _context_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Contexts()
        for batch in batches:
            for doc, rid, text, spans in zip(batch.column("key").to_pylist(), batch.column("rid").to_pylist(), byte_texts(batch), batch.column("spans"), strict=True):
                packed = spans.values
                names, cuts = packed.field(0).to_numpy().tolist(), packed.field(1).to_numpy()
                begin, count, twice = cuts >> 32, (cuts & 0xFFFFFFFF) >> 1, cuts & 1
                for name, a, b, t in zip(names, begin.tolist(), (begin + count + length - 1).tolist(), twice.tolist(), strict=True):
                    found.add(name, name, text[a:b], bool(t), (doc, rid, a))
                if found.size >= HELD_BYTES:
                    yield found.rows()
        yield found.rows()

    return run


def split_windows(context: bytes, name: int, length: int, parts: int) -> list[tuple[int, int, int]]:
    """(new name, first start, starts) of the context's windows, all named ``name``, in up to ``parts`` parts by
    where the gram first stands in them. A new name covers the bytes that all windows of its part share."""
    width = length - GRAM + 1
    at = np.flatnonzero(gram_hashes(np.frombuffer(context, np.uint8)).view(np.int64) == name)
    start = np.arange(len(context) - length + 1)
    gram = at[np.searchsorted(at, start)]
    part = (gram - start) * parts // width
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
    out = []
    for a, n in zip(first.tolist(), np.diff(np.r_[first, len(start)]).tolist(), strict=True):
        p, g = int(part[a]), int(gram[a])
        low, high = -(-p * width // parts), -(-(p + 1) * width // parts) - 1  # offsets of the gram in this part
        shared = context[g - low : g - high + length] if low <= high else b""
        out.append((xxhash.xxh3_64_intdigest(shared, (name ^ p) & 0xFFFFFFFF) - (1 << 63), a, n))
    return out


def _split_rows(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Contexts()
        for batch in batches:
            for gram, context, key, rid, lo in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "key", "rid", "lo")), strict=True):
                for new, a, n in split_windows(context, gram, length, parts):
                    found.add(new, gram, context[a : a + n + length - 1], False, (key, rid, lo + a))
                if found.size >= HELD_BYTES:
                    yield found.rows()
        yield found.rows()

    return run


def _range_rows(length: int):
    """Rows arrive sorted by name."""

    def work(names: dict[int, dict[bytes, list]]) -> list[np.ndarray]:
        """Ranges of repeats in the first and second places of contexts that are not alone."""
        contexts, firsts, seconds = [], [], []
        for group in names.values():
            for context, (first, second, twice) in group.items():
                if twice or second or len(group) > 1:
                    contexts.append(context)
                    firsts.append(first)
                    seconds.append(second)
        out = []
        if contexts:
            places = [p for both in zip(firsts, seconds, strict=True) for p in both]
            for place, at in zip(places, repeated_starts(contexts, firsts, seconds, length), strict=True):
                if len(at):
                    key, rid, start = place
                    lo, hi = _unite(at + start, at + start + length)
                    out.append(np.stack([np.full(len(lo), key), np.full(len(lo), rid), lo, hi], axis=1))
        return out

    def batch_of(ranges: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(ranges) if ranges else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy(), pa.int64()) for i in range(4)], ["key", "rid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        size, last = 0, None
        for batch in batches:
            later: list[tuple[int, int, int, int]] = []
            sorted_now: list[np.ndarray] = []
            for name, context, twice, *place in zip(*(batch.column(c).to_pylist() for c in ("name", "context", "twice", "key", "rid", "lo")), strict=True):
                if name != last and size >= SORT_BYTES:
                    sorted_now += work(held)
                    held, size = {}, 0
                last, place = name, tuple(place)
                group = held.setdefault(name, {})
                entry = group.get(context)
                if entry is None:
                    group[context] = [place, None, twice]
                    size += len(context)
                    continue
                entry[2] |= twice
                if place not in entry[:2]:
                    known = sorted(p for p in (*entry[:2], place) if p)
                    entry[:2] = known[:2]
                    later += [(*p, p[2] + len(context)) for p in known[2:]]  # goes as its second place does
            yield batch_of([_unite_rows(np.array(later, np.int64).reshape(-1, 4)), *sorted_now])
        yield batch_of(work(held))

    return run


def _split_hot(contexts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of the contexts in which no name is too heavy, the stored tables that they read)."""
    parts_of, stored = [], [contexts]
    for parts in (PARTS, length - GRAM + 1):
        weights = contexts.filter("context IS NOT NULL").groupBy("name").agg(F.sum(F.octet_length("context")).alias("weight"))
        heavy = save(weights.filter(F.col("weight") > HEAVY_BYTES).select("name"), "heavy")
        stored.append(heavy)
        n = heavy.count()
        if not n:
            break
        small = F.broadcast(heavy) if n <= 300_000 else heavy  # some 5 MB; beyond that both sides shuffle
        parts_of.append(contexts.join(small, "name", "left_anti"))
        hot = contexts.filter("context IS NOT NULL").join(small, "name", "left_semi")
        contexts = save(hot.select("gram", "context", "key", "rid", "lo").mapInArrow(_split_rows(length, parts), CONTEXT), "contexts")
        stored.append(contexts)
    return [*parts_of, contexts], stored


def removed_ranges(rows: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, rid, lo, hi: bytes of ``rows`` (key, rid, text) that go; the stored tables that it reads)."""
    anchors = rows.select("key", "rid", "text").mapInArrow(_anchor_rows(length), "name long, key long, rid long, span long")
    # Written before the joins, so that adaptive execution can split a name or a document that is everywhere.
    again = save(anchors.groupBy("name").agg(F.sum(1 + F.col("span").bitwiseAND(1)).alias("n")).filter("n > 1").select("name"), "names")
    spans = save(anchors.join(again.hint("shuffle_hash"), "name", "left_semi").groupBy("key", "rid").agg(F.collect_set(F.struct("name", "span")).alias("spans")), "spans")
    release(again)
    contexts = save(rows.join(spans, ["key", "rid"]).select("key", "rid", "text", "spans").mapInArrow(_context_rows(length), CONTEXT), "contexts")
    release(spans)
    every, stored = _split_hot(contexts, length)
    known, meeting = [], []
    for part in every:
        known.append(part.filter("context IS NULL").select("key", "rid", "lo", "hi"))
        meeting.append(part.filter("context IS NOT NULL").select("name", "context", "twice", "key", "rid", "lo"))
    together = reduce(DataFrame.unionByName, meeting).repartition(F.col("name")).sortWithinPartitions("name")
    return reduce(DataFrame.unionByName, known).unionByName(together.mapInArrow(_range_rows(length), "key long, rid long, lo long, hi long")), stored


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the remaining bytes), spans (removed [lo, hi) ranges)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = []
                for text, ranges in zip(byte_texts(part), part.column("ranges"), strict=True):
                    if ranges.is_valid:
                        lo, hi = _unite(ranges.values.field(0).to_numpy(), ranges.values.field(1).to_numpy())
                        kept = b"".join(text[a:b] for a, b in zip(np.r_[0, hi].tolist(), np.r_[lo, len(text)].tolist(), strict=True))
                        out.append((len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
                    else:
                        out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text, []))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    rows = identified(docs, id_col, text_col)
    ranges, stored = removed_ranges(rows, length)
    per = save(ranges.groupBy("key", "rid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    release(*stored)
    return rows.join(per, ["key", "rid"], "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:long,hi:long>>")
