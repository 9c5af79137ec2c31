"""Alignment of two tokenizers over the same texts by an event sweep.

Every token of either tokenizer is an event at the byte where it ends. A pass over the texts makes
the union of both tokenizers' events in runs: rows (row, at, side, ids) that hold one side's tokens of
some kilobytes from byte ``at`` on; offsets inside a run follow from the ids, whose bytes are known.
Runs are repartitioned by document and sorted within partitions by (row, at, side); the sweep goes
through them in that order. A group ends where both sides have an event at one byte, and a token of
one side is linked with those of the other that end after its begin and begin before its end. Runs
end where both sides end, so between two runs of a document the sweep keeps only sums, a running
digest of the groups and the counts of its id pairs, however long the text is.

The sweep hands on batches of documents: sums and digests, the batch's distinct id pairs with the
number of its documents that hold each, and every document's pairs as places in that list. Counts are
summed over all batches by pair, the highest of an A id is a grouped maximum, and both come back to the
batches that asked by joins: rows are distinct pairs of batches, never links. Every partition of the sweep makes a
batch, so many small partitions would ask for the same pairs again and again: batches that are less than half full
on average are put together first, and the rows follow the pairs of documents, not the partitions.

Texts are cut into units at spaces behind a visible character, where neither tokenizer joins anything
(A's words take the space before them, B's pieces hold spaces only in front), so a unit that came before
comes from a bounded cache of what the two libraries gave for it.

Defined results: a document whose text is null, empty or not given back byte for byte by both sides
has zeros and an empty digest and counts in no pair; a null id stays null; rows with equal ids or
texts are documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import byte_texts, distinct_runs, documents, ragged, release, save, slices

#: Bytes of a run of events, units that a worker remembers, pairs of documents in a batch: at most, and from where on it is full;
#: a document without pairs takes the room of some.
RUN_BYTES, CACHE_UNITS, CACHE_TOKENS, BATCH_PAIRS, FULL_PAIRS, DOC_PAIRS = 16 << 10, 500_000, 4_000_000, 1 << 22, 1 << 19, 16
_EVENTS = "row long, doc_id long, at long, side int, ids binary"
_DOC = "doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,n_pairs:long"
_BATCH = f"batch long, held long, docs array<struct<{_DOC}>>, places binary, times binary, pairs binary, holders binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Bytes that end a visible character: no control, no space, and no space beyond ASCII (those begin with the lead bytes below).
_SEEN = np.ones(256, bool)
_SEEN[:0x21] = False
_SEEN[0x7F] = False


class Side:
    """One tokenizer: ids of units, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True
            letters = {x: b for b, x in enumerate(_byte_letters())}
            vocab = self.library.get_vocab(with_added_tokens=True)
            with open(path, encoding="utf-8") as f:
                added = {x["content"]: x["content"].encode() for x in json.load(f)["added_tokens"]}
            bytes_of = {i: added[x] if x in added else bytes(map(letters.__getitem__, x)) for x, i in vocab.items()}
            self.encode = lambda units: [x.ids for x in self.library.encode_batch(units, add_special_tokens=False)]
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            bytes_of = {}
            for i in range(self.library.get_piece_size()):
                piece = self.library.id_to_piece(i)
                bytes_of[i] = bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()
            self.encode = lambda units: self.library.encode([x[1:] for x in units], num_threads=1)  # it adds the space itself
        self.size = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(self.size)]
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(decimal id and a separator of each id in 8 bytes, for `,` `|` `;`; their length)."""
        table = np.zeros((3, self.size, 8), np.uint8)
        for kind, mark in enumerate(",|;"):
            text = b"".join(f"{i}{mark}".encode().ljust(8, b"\0") for i in range(self.size))
            table[kind] = np.frombuffer(text, np.uint8).reshape(-1, 8)
        return table.view(np.uint64)[:, :, 0], (table[0] > 0).sum(axis=1)


class _Cached:
    """What one side gave for units: ragged ids in a growing array."""

    def __init__(self, side: Side):
        self.side = side
        self.reset()

    def reset(self) -> None:
        self.pool, self.starts, self.counts, self.used, self.n = np.zeros(1 << 16, self.side.kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, units: list[bytes], texts: list[str]) -> list[bool]:
        found = self.side.encode(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), self.side.kind, int(counts.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(units) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(units)] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : self.n + len(units)] = counts
        self.used, self.n = self.used + len(ids), self.n + len(units)
        known = self.side.bytes_of
        return [b"".join([known[i] for i in x]) == unit for x, unit in zip(found, units, strict=True)]

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[places]
        return self.pool[ragged(self.starts[places], n)], n


class Units:
    """Both sides' ids of texts, by way of the units that they are made of."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = [_Cached(Side(a_path)), _Cached(Side(b_path))]
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.good = np.zeros(1 << 12, bool)
        for side in self.sides:
            side.reset()

    def _learn(self, units: list[bytes]) -> None:
        if not units:
            return
        first, texts = len(self.index), [x.decode() for x in units]
        good = np.logical_and(*(side.add(units, texts) for side in self.sides))
        while first + len(units) > len(self.good):
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        self.good[first : first + len(units)] = good
        self.index.update(zip(units, range(first, first + len(units)), strict=True))

    def events(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(text and begin of each run of events, per side its runs' ids end to end and their lengths); texts without tokens have no run."""
        if len(self.index) > CACHE_UNITS or max(x.used for x in self.sides) > CACHE_TOKENS:
            self.reset()
        sizes = np.fromiter((len(x) + 1 if x else 0 for x in texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(b" " + x for x in texts if x), np.uint8)
        text_of = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[text_of])
        begins = ends - sizes[text_of]
        if not len(raw):
            return text_of, begins, [(np.zeros(0, x.side.kind), np.zeros(0, np.int64)) for x in self.sides]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (raw[1:] == 0x20) & _SEEN[raw[:-1]]
        cut[2:] &= ~((raw[1:-1] >= 0x80) & (raw[:-2] == 0xC2))
        cut[3:] &= ~((raw[2:-1] >= 0x80) & (raw[:-3] >= 0xE1) & (raw[:-3] <= 0xE3))
        cut[ends - 1] = False  # B takes a lone last space only with what stands before it
        cut[begins] = True
        at = np.flatnonzero(cut)
        units, codes = distinct_runs(raw, np.diff(np.r_[at, len(raw)]))
        self._learn([x for x in units if x not in self.index])
        places = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))[codes]
        text = np.searchsorted(ends, at, side="right")
        good = np.logical_and.reduceat(self.good[places], np.searchsorted(at, begins))
        places, at, text = places[good[text]], at[good[text]], text[good[text]]
        run = text << 32 | (at - begins[text]) // RUN_BYTES
        new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        out = []
        for side in self.sides:
            ids, n = side.ids(places)
            out.append((ids, np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)))
        return text_of[text[new]], (at - begins[text])[new], out


@lru_cache(maxsize=1)
def _units(a_path: str, b_path: str) -> Units:
    return Units(a_path, b_path)


def _events(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(a_path, b_path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, at, sides = units.events(byte_texts(part))
                rows, keys = part.column("row").to_numpy(), part.column("doc_id")
                for side, (ids, n) in enumerate(sides):
                    offsets = np.r_[0, np.cumsum(n)] * ids.itemsize
                    runs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[text]), keys.take(pa.array(text)), pa.array(at), pa.array(np.full(len(n), side, np.int32)), runs], ["row", "doc_id", "at", "side", "ids"])
                none = np.setdiff1d(np.arange(len(rows)), text)
                empty = pa.array([b""] * len(none), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows[none]), keys.take(pa.array(none)), pa.array(none * 0), pa.array(none * 0, pa.int32()), empty], ["row", "doc_id", "at", "side", "ids"])

    return run


@dataclass
class _Doc:
    """What the sweep keeps of a document between two runs."""

    row: int
    doc_id: int | None
    sums: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    digest: object = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _times(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, how often each; or the sums of their weights)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.r_[new, len(keys)]) if weights is None else np.add.reduceat(weights, new)


class Sweep:
    """Goes through runs of events in order."""

    def __init__(self, a: Side, b: Side):
        if a.size * b.size > 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        self.a, self.b = a, b
        self.a_cells, self.a_wide = a.cells()
        self.b_cells, self.b_wide = b.cells()

    def runs(self, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums (n_a, n_b, n_groups, n_links) of every document, its groups as one text of all (without the last mark) and
        where each begins, and (document << 32 | pair) of all links. ``doc``: the document, from 0, of each pair of runs."""
        a_len, b_len = self.a.length[a], self.b.length[b]
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        total = int(a_end[-1])
        mark = np.zeros(total + 1, np.int8)
        mark[a_end] = 1
        b_upto = np.zeros(total + 1, np.int32)
        b_upto[b_end] = 1
        both = mark & b_upto.astype(np.int8)
        np.cumsum(b_upto, out=b_upto)
        group = np.cumsum(both, dtype=np.int32)
        a_cut, b_cut = both[a_end].astype(bool), both[b_end].astype(bool)
        a_doc = np.repeat(doc, a_counts)
        n = int(doc[-1]) + 1
        # each group's A ids and then its B ids: where every token stands
        a_upto, b_before = np.r_[0, np.flatnonzero(a_cut) + 1], np.r_[0, np.flatnonzero(b_cut) + 1]
        a_place = np.arange(len(a)) + b_before[group[a_end - 1]]
        b_place = np.arange(len(b)) + a_upto[group[b_end - 1] + 1]
        cells, wide = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        cells[a_place], wide[a_place] = self.a_cells[a_cut.astype(np.int8), a], self.a_wide[a]
        cells[b_place], wide[b_place] = self.b_cells[2 * b_cut.astype(np.int8), b], self.b_wide[b]
        text = cells.view(np.uint8)
        text = text[text > 0]
        docs = np.bincount(doc, weights=a_counts, minlength=n).astype(np.int64), np.bincount(doc, weights=b_counts, minlength=n).astype(np.int64)
        begins = np.r_[0, np.cumsum(wide)][np.r_[0, np.cumsum(docs[0] + docs[1])]]
        first = b_upto[a_end - a_len]
        links = b_upto[a_end - 1] - first + 1
        link_doc = np.repeat(a_doc, links)
        keys = link_doc.astype(np.int64) << 32 | (np.repeat(a.astype(np.int64), links) * self.b.size + b[ragged(first.astype(np.int64), links.astype(np.int64))])
        groups = np.bincount(a_doc[a_cut], minlength=n)
        sums = np.stack([docs[0], docs[1], groups, np.bincount(a_doc, weights=links, minlength=n).astype(np.int64)], 1)
        return sums, text, begins, keys, np.arange(n)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 byte place by byte place, so that small ones compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _places(steps: bytes, sizes: np.ndarray) -> np.ndarray:
    """Places in the batch's list of the pairs of all documents, which have ``sizes`` of them. Steps run on inside
    a document: their sum less the sum before it."""
    upto = np.cumsum(_from_planes(steps))
    before = np.r_[0, upto][np.cumsum(sizes) - sizes]
    return upto - np.repeat(before, sizes)


def _record(number: int, docs: pa.StructArray, every: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A batch of ``docs``, whose pairs lie end to end in ``every``, each document's in order."""
    counts = docs.field("n_pairs").to_numpy()
    different, holders = _times(every)
    places = np.searchsorted(different, every)
    steps = np.diff(places, prepend=0)
    begin = (np.cumsum(counts) - counts)[counts > 0]
    steps[begin] = places[begin]  # the first of each document whole, the others as steps
    columns = [pa.array([number], pa.int64()), pa.array([len(every) + DOC_PAIRS * len(docs)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
    columns += [pa.array([x], pa.binary()) for x in (_planes(steps), _planes(times), different.astype("<i8").tobytes(), _planes(holders))]
    return pa.RecordBatch.from_arrays(columns, ["batch", "held", "docs", "places", "times", "pairs", "holders"])


def _batch(number: int, docs: list[_Doc], pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [{"doc_id": d.doc_id, "n_a": int(d.sums[0]), "n_b": int(d.sums[1]), "n_groups": int(d.sums[2]), "n_links": int(d.sums[3]), "groups_sha256": d.digest.hexdigest() if d.digest else "", "n_pairs": len(p)} for d, (p, _) in zip(docs, pairs, strict=True)]
    kind = pa.struct([(x.split(":")[0], pa.string() if x.endswith("string") else pa.int64()) for x in _DOC.split(",")])
    return _record(number, pa.array(rows, kind), *(np.concatenate(x) for x in zip(*pairs, strict=True)))


def _merged(full: int):
    """Puts batches together as long as they hold no more than ``full`` pairs of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        parts: list[tuple[pa.StructArray, np.ndarray, np.ndarray]] = []
        held = 0

        def together() -> pa.RecordBatch:
            docs, every, times = zip(*parts, strict=True)
            return _record(number, pa.concat_arrays(docs), np.concatenate(every), np.concatenate(times))

        for batch in batches:
            for i, n in enumerate(batch.column("held").to_pylist()):
                if parts and held + n > full:
                    yield together()
                    parts, held, number = [], 0, number + 1
                docs = batch.column("docs")[i].values
                places = _places(batch.column("places")[i].as_py(), docs.field("n_pairs").to_numpy())
                pairs = np.frombuffer(batch.column("pairs")[i].as_py(), "<i8")
                parts.append((docs, pairs[places], _from_planes(batch.column("times")[i].as_py())))
                held += n
        if parts:
            yield together()

    return run


def _filled(batches: DataFrame, full: int = FULL_PAIRS) -> DataFrame:
    """The stored ``batches``, put together where they are less than half full on average."""
    n, held = batches.agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
    enough = max(1, -(-held // full))
    if n <= 2 * enough:
        return batches
    out = save(batches.coalesce(enough).mapInArrow(_merged(full), _BATCH), "filled", "zstd")
    release(batches)
    return out


def _swept(a_path: str, b_path: str, batch_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(*(x.side for x in _units(a_path, b_path).sides))
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        done: list[_Doc] = []
        done_pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        state: _Doc | None = None
        waiting: pa.RecordBatch | None = None  # a run of A whose run of B comes with the next rows

        def close() -> None:
            nonlocal held
            found = state.pairs
            one = found[0] if len(found) == 1 else (_times(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2)
            done.append(state)
            done_pairs.append(one)
            held += len(one[0]) + DOC_PAIRS

        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                if waiting is not None:
                    part, waiting = pa.Table.from_batches([waiting, part]).combine_chunks().to_batches()[0], None
                side, empty = part.column("side").to_numpy(), np.asarray(part.column("ids").is_valid()) & (np.asarray([len(x) for x in part.column("ids").to_pylist()]) == 0)
                if side[-1] == 0 and not empty[-1]:
                    part, waiting = part.slice(0, len(side) - 1), part.slice(len(side) - 1)
                    side, empty = side[:-1], empty[:-1]
                    if not len(side):
                        continue
                rows, keys, runs = part.column("row").to_numpy(), part.column("doc_id").to_pylist(), part.column("ids").to_pylist()
                full_a, full_b = np.flatnonzero((side == 0) & ~empty), np.flatnonzero(side == 1)
                new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                doc = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])
                sums = np.zeros((len(new), 4), np.int64)
                pairs, times, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(new) + 1, np.int64)
                text, begins = np.zeros(0, np.uint8), np.zeros(len(new) + 1, np.int64)
                if len(full_a):
                    sides = []
                    for which, tok in ((full_a, sweep.a), (full_b, sweep.b)):
                        parts = [runs[i] for i in which.tolist()]
                        sides.append((np.frombuffer(b"".join(parts), tok.kind), np.array([len(x) // tok.kind.itemsize for x in parts])))
                    own, at = np.unique(doc[full_a], return_inverse=True)
                    found, text, spots, links, _ = sweep.runs(sides[0][0], sides[1][0], sides[0][1], sides[1][1], at)
                    sums[own] = found
                    begins = spots[np.searchsorted(own, np.arange(len(new) + 1))]
                    pairs, times = _times(links)
                    edges = np.searchsorted(pairs >> 32, np.searchsorted(own, np.arange(len(new) + 1)))
                    pairs = pairs & 0xFFFFFFFF
                text = memoryview(text)
                for d, i in enumerate(new.tolist()):
                    if state is None or state.row != rows[i]:
                        if state is not None:
                            close()
                            if held >= batch_pairs:
                                yield _batch(number, done, done_pairs)
                                done, done_pairs, held, number = [], [], 0, number + 1
                        state = _Doc(int(rows[i]), keys[i])
                    if sums[d, 0]:
                        state.digest = state.digest or hashlib.sha256()
                        if state.sums[0]:
                            state.digest.update(b";")
                        state.digest.update(text[begins[d] : begins[d + 1] - 1])
                        state.sums = state.sums + sums[d]
                        state.pairs.append((pairs[edges[d] : edges[d + 1]], times[edges[d] : edges[d + 1]]))
        if state is not None:
            close()
            yield _batch(number, done, done_pairs)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, pairs, holders in zip(*(batch.column(x).to_pylist() for x in ("batch", "pairs", "holders")), strict=True):
            pairs, holders = np.frombuffer(pairs, "<i8"), _from_planes(holders)
            for a in range(0, len(pairs), 1 << 16):
                some = pairs[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(np.arange(a, a + len(some))), pa.array(some), pa.array(holders[a : a + (1 << 16)])], ["batch", "place", "pair", "n"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch after another: the counts of its pairs in order, then its documents."""
    counts: list[np.ndarray] = []
    best: list[np.ndarray] = []
    for batch in batches:
        docs = np.asarray(batch.column("docs").is_valid())
        edges = [0, *(x for i in np.flatnonzero(docs).tolist() for x in (i, i + 1)), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if not docs[a]:
                counts.append(part.column("n").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            n, top = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (counts, best))
            counts, best = [], []
            rows = part.column("docs")[0].values
            sizes = rows.field("n_pairs").to_numpy()
            ends = np.cumsum(sizes)
            places, times = _places(part.column("places")[0].as_py(), sizes), _from_planes(part.column("times")[0].as_py())
            sums = [np.r_[0, np.cumsum(x)] for x in (times * n[places], times * top[places])]
            total, n_best = (x[ends] - x[ends - sizes] for x in sums)
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays([*(rows.field(x) for x in names), pa.array(n_best), pa.array(total), rows.field("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. ``a_path``: a byte-level
    vocabulary (.json), ``b_path``: a sentence piece model; both must exist on every executor."""
    rows = documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    events = rows.mapInArrow(_events(a_path, b_path), _EVENTS)
    in_order = events.repartition("row").sortWithinPartitions("row", "at", "side")
    batches = _filled(save(in_order.mapInArrow(_swept(a_path, b_path, batch_pairs), _BATCH), "aligned", "zstd"))
    width = Side(b_path).size
    asked = batches.select("batch", "pairs", "holders").mapInArrow(_pairs, "batch long, place long, pair long, n long")
    counts = save(asked.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # one row an A id: bounded by the vocabulary
    highest = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("top"))
    told = counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = asked.drop("n").join(told, "pair").select("batch", "place", "n", "best")
    blobs = batches.select("batch", F.lit((1 << 62)).alias("place"), "docs", "places", "times")
    both = answers.unionByName(blobs, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "place")
    return both.select("n", "best", "docs", "places", "times").mapInArrow(_scored, _RESULT)


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grp, a_ids, b_ids: the groups of every document, in order, for those that need them written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(a_path, b_path)
        a_side, b_side = (x.side for x in units.sides)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, at, ((a, a_n), (b, b_n)) = units.events(byte_texts(part))
                if not len(text):
                    continue
                a_end, b_end = np.cumsum(a_side.length[a]), np.cumsum(b_side.length[b])
                cuts = np.intersect1d(a_end, b_end, assume_unique=True)
                a_cut, b_cut = np.searchsorted(a_end, cuts) + 1, np.searchsorted(b_end, cuts) + 1
                doc = text[np.searchsorted(np.cumsum(a_n), a_cut - 1, side="right")]
                grp = np.arange(len(doc)) - np.searchsorted(doc, doc)
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, c], pa.int32()), pa.array(x.astype(np.int64))) for c, x in ((a_cut, a), (b_cut, b))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(grp), *lists], ["doc_id", "grp", "a_ids", "b_ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, grp long, a_ids array<long>, b_ids array<long>")
