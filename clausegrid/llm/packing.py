"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs ``linear * n + quadratic * n^2`` (attention stays inside a
piece). Documents are cut into full sequences and a remainder; remainders go, largest
first, to the cheapest sequence with room for them. Where none has room, the cheapest
sequence with any room takes as much as fits and the rest is dealt again.

Packing works on runs of documents holding about ``run_tokens`` tokens inside one task:
no shuffle, memory bounded by the run. A run opens exactly as much capacity as it has
tokens: full sequences, then the rest as sequences whose lengths are powers of two, which
need no padding. So no token is lost and nothing is padded.

Defined results: null and empty texts have only the end token; a null id stays null;
repeated rows are documents of their own; a very long text is a run of its own, cut over as many
sequences as it needs; other columns are ignored; an empty table gives an empty result. Sequence
ids are unique and depend on how the input is split, like monotonically_increasing_id.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_path, encoder
from .common import byte_texts, documents, slices

CAPACITY, END_TOKEN, RUN_TOKENS = 2048, 1, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence lengths that hold exactly ``total`` tokens: full ones, then falling powers of two."""
    full, rest = divmod(total, capacity)
    return np.array([capacity] * full + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset) for documents of the given lengths."""
    room = capacities(int(lengths.sum()), capacity)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    full = int((room == capacity).sum())
    next_full = 0
    todo: list[tuple[int, int, int]] = []  # (length, document, start), ascending: the largest is last
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity and next_full < full:
            put(doc, start, capacity, next_full)
            next_full += 1
            start += capacity
        if n > start:
            todo.append((n - start, doc, start))
    todo.sort()
    open_from = next_full
    while todo:
        n, doc, start = todo.pop()
        free = room[open_from:]
        fits = np.where(free >= n, cost[open_from:], np.inf)
        seq = int(fits.argmin())
        if free[seq] >= n:
            put(doc, start, n, open_from + seq)
            continue
        seq = open_from + int(np.where(free > 0, cost[open_from:], np.inf).argmin())
        part = int(room[seq])
        put(doc, start, part, seq)
        insort(todo, (n - part, doc, start + part))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN, run_tokens: int = RUN_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` also the ids themselves."""

    def flush(run: list[tuple[int | None, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x) for _, x in run], np.int64)
        pieces = assign(lengths, capacity, linear, quadratic)
        doc, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        cuts = [run[d][1][s : s + m] for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
        columns = [pa.array([run[d][0] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in cuts], pa.int64()), pa.array(lengths[doc]), pa.array(seq + first), pa.array(offset)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns, names = [*columns, pa.array([x.astype(np.int64) for x in cuts], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names), first + int(seq.max()) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or default_path())
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 33
        run: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = enc.encode(byte_texts(part))
                ends = np.cumsum(counts)
                for key, a, b in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    run.append((key, np.append(ids[a:b], np.uint32(end_token)).astype("<u4")))
                    held += b - a + 1
                    if held >= run_tokens:
                        out, first = flush(run, first)
                        yield out
                        run, held = [], 0
        if run:
            yield flush(run, first)[0]

    return documents(docs, id_col, text_col).mapInArrow(work, SCHEMA + (", ids array<long>" if with_ids else ""))
