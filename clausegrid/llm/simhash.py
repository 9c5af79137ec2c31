"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint: 64 majority bits over the XXH64 values of all word shingles. To find every
pair of distinct fingerprints within 4 bits, the 64 bits are cut into three segments and
the errors per segment pigeonholed:

* a segment without errors: of the other two one has at most 2. Key: the first segment as
  it is and a nearby codeword of the second (6 ordered pairs of segments);
* no segment without errors: two have exactly 1, so one half of each is exact, and the
  third has at most 2. Key: the two halves and a nearby codeword (3 x 4 choices).

Nearby codewords of a segment: the (23, 12) Golay code is perfect, so every 23-bit word
decodes to one codeword. Taking the codewords of the segment and of all its one-bit
changes gives 1 or 6 keys, and two segments within 2 bits share one: the word between them.
Keys have about 33 bits, so buckets stay small; candidates are verified exactly, and a
task hands on a spanning forest of the links it found, not all pairs. A bucket of more than
``HOT_BUCKET`` fingerprints (a template's family) is split: the 64 bits are cut into one piece
more than there may be errors, each fingerprint goes to the part of each of its pieces, and
every pair within the errors shares a piece. A part then holds 2^18 fingerprints at most.

Only distinct fingerprints take part in the search: exact copies and texts with equal
shingles cost one row. Components come from ``components``.

Defined results: null and empty texts have fingerprint zero and link like any other; a
very long text is read whole, all its shingles count; a null id is a row like any other; repeated rows share a component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, digest, release, save, slices, without
from .components import components

MAX_BITS = 4
SHINGLE, SEED = 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY_GENERATOR = 0xC75
#: Fingerprints of one bucket that are compared at once, and beyond which it is split.
BLOCK, HOT_BUCKET = 1024, 20_000


@lru_cache(maxsize=1)
def _corrections() -> np.ndarray:
    """For every syndrome the only error of up to three bits that has it."""
    table = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    words = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    errors = np.array(words, np.int64)
    table[_syndromes(errors)] = errors
    return table


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GOLAY_GENERATOR << (bit - 11), 0)
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits."""
    return (words ^ _corrections()[_syndromes(words)]) >> 11


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of the codewords of every word and its one-bit changes, each once."""
    changes = np.array([0, *(1 << i for i in range(width))], np.int64)
    found = np.sort(decode(words[:, None] ^ changes), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all buckets of the fingerprints (uint64)."""
    seg = [(prints >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    near = [nearby(s, w) for s, (_, w) in zip(seg, SEGMENTS, strict=True)]
    halves = [(s & 0x7FF, s >> 11) for s in seg]
    keys, rows = [], []
    for k in range(3):
        row, code = near[k]
        others = [i for i in range(3) if i != k]
        for i in others:
            keys.append((np.int64(k * 3 + i) << 40) | (seg[i][row] << 12) | code)
            rows.append(row)
        for x in range(2):
            for y in range(2):
                tag = np.int64(16 + k * 4 + x * 2 + y) << 40
                keys.append(tag | (halves[others[0]][x][row] << 23) | (halves[others[1]][y][row] << 12) | code)
                rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    values: list[int] = []
    per = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        line = b" ".join(words)
        n = len(words)
        if n <= shingle:
            values.append(digest(line, seed))
            per[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.r_[0, ends[: n - shingle]].tolist()
        values += [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        per[i] = n - shingle + 1
    if not values:
        return out
    some = np.flatnonzero(per)
    first = np.cumsum(per[some]) - per[some]
    bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = np.add.reduceat(bits, first, axis=0, dtype=np.int32) * 2 > per[some][:, None]
    out[some] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (place in this scan), doc_id, digest (of the text), fp (long with the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "digest")), pa.array(fingerprint(byte_texts(part)).view(np.int64))], ["rid", "doc_id", "digest", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, digest binary, fp long")


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def run_links(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (uint64) of equal key; ``keys`` is sorted."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    for lag in range(1, min(32, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small[:-lag] & (keys[:-lag] == keys[lag:]))
        at = at[_close(prints[at], prints[at + lag], max_bits)]
        left.append(prints[at])
        right.append(prints[at + lag])
    for a, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        every = np.unique(prints[a : a + size])
        for i in range(0, len(every), BLOCK):
            head = every[i : i + BLOCK]
            for j in range(i, len(every), BLOCK):
                x, y = np.nonzero(_close(head[:, None], every[None, j : j + BLOCK], max_bits))
                forest = _forest(zip(head[x].tolist(), every[j + y].tolist(), strict=True), {})
                left.append(np.array([p for p, _ in forest], np.uint64))
                right.append(np.array([q for _, q in forest], np.uint64))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.uint64),) * 2


def _forest(pairs, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that join two trees of ``parent``, which is updated."""

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        if (p := root(a)) != (q := root(b)):
            parent[p] = q
            out.append((a, b))
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): a spanning forest of each task's links between the distinct values of column ``fp``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                keys, rows = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        rest_k, rest_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            u, v = run_links(keys, prints, max_bits)
            if len(parent) > 1_000_000:
                parent.clear()
            out = np.array(_forest(zip(u.tolist(), v.tolist(), strict=True), parent), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["u", "v"])

        for batch in batches:
            keys = np.r_[rest_k, batch.column("key").to_numpy()]
            prints = np.r_[rest_p, batch.column("fp").to_numpy().view(np.uint64)]
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            yield found(keys[:cut], prints[:cut])
            rest_k, rest_p = keys[cut:], prints[cut:]
        yield found(rest_k, rest_p)

    # so many parts that the keys, a hundred a fingerprint, do not come out of a few tasks
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("fp").repartition(parts, "fp").distinct().mapInArrow(spread, "key long, fp long")
    hot = save(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BUCKET), "hot")
    if not hot.isEmpty():
        edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
        pieces = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        split = F.array(*[F.xxhash64("key", F.lit(i), p) for i, p in enumerate(pieces)])
        rows = rows.join(hot, "key", "left").select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(split)).alias("key"), "fp")
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(match, "u long, v long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, digest, fp, component_id, kept: one row of each component) and the stored tables that it reads."""
    prints = save(fingerprints(docs, id_col, text_col), "prints")
    roots = components(links(prints, max_bits))
    rows = save(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("rid", "doc_id", "digest", "fp", F.coalesce("root", "fp").alias("root")), "roots")
    release(prints)
    # Written before the join, so that adaptive execution can split a hot root.
    heads = save(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("head")), "heads")
    return rows.join(heads, "root").select("doc_id", "digest", "fp", F.col("head.doc_id").alias("component_id"), (F.col("head.rid") == F.col("rid")).alias("kept")), [rows, heads]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept (one row of each component)."""
    found, _ = components_of(docs, id_col, text_col, max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with all its columns: one document of each component. Rows with equal id and text are one document."""
    found, stored = components_of(docs, id_col, text_col, max_bits)
    decided = save(found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "classes")
    release(*stored)
    return without(docs, decided, docs[id_col].cast("long"), digest(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
