"""Re-Pair grammars of token ids: one shard's documents as symbols, rules and expansion lengths.

Compression replaces frequent pairs of neighbours by new symbols, round by round. A round
takes all pairs within a factor of the most frequent one: where two of them overlap the more frequent
one wins, the loser is counted again next round, and a rule that is left with too few uses is dropped.
Pairs are counted in a table of hashes first, so that only those that can be frequent enough are sorted.
It ends where a round at the least count takes away under a hundredth of the symbols.
No pair spans two documents, so a document is a run of symbols of its own.

A shard's bytes: header, sizes of the rounds, left and right symbol and expansion length of each rule,
then for each document its id, whether it has one, its tokens and its symbols, then the symbols.
Rules only use symbols of earlier rounds. Everything is little-endian.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .common import ragged

MAGIC = b"IDGRAM01"
_HEADER = struct.Struct("<8s8I")
#: A pair must be replaced so often to be worth a rule.
MIN_USES = 8
MAX_ROUNDS = 24
#: A round takes pairs down to this share of the most frequent one.
FALL = 4
#: The last rounds go on while they take at least this share of the symbols away.
WORTH = 100
_FREE = np.int32((1 << 31) - 1)


def _buckets(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    mixed = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


def _apart(at: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring positions (a a a) every other one, from the left."""
    if len(at) < 2:
        return at
    new = np.r_[True, np.diff(at) != 1]
    if new.all():
        return at
    place = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return at[place % 2 == 0]


def compress(ids: np.ndarray, counts: np.ndarray, base: int, min_uses: int = MIN_USES, max_rules: int | None = None) -> Grammar:
    """The grammar of documents of ``counts`` ids that lie end to end. ``base``: the first free symbol."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    if max_rules is None:
        max_rules = (1 << 16) - base if base < 1 << 16 else (1 << 31) - base  # symbols of 2 bytes where ids are
    rules: list[np.ndarray] = []
    n_rules, least = 0, None
    for _ in range(MAX_ROUNDS):
        if len(symbols) < 2 or n_rules >= max_rules:
            break
        bits = min(max(len(symbols).bit_length(), 10), 24)
        bucket = _buckets(symbols[:-1], symbols[1:], bits)
        seen = np.bincount(bucket, minlength=1 << bits)
        least = max(int(seen.max()) // FALL, min_uses) if least is None else least
        at = np.flatnonzero((seen >= least)[bucket] & ~last[:-1])
        keys = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        uses = np.diff(np.r_[edge, len(ordered)])
        pairs = ordered[edge][uses >= least]
        replaced = 0
        if len(pairs):
            by_use = np.argsort(-uses[uses >= least], kind="stable")
            rank = np.empty(len(pairs), np.int32)
            rank[by_use] = np.arange(len(pairs), dtype=np.int32)
            # the most frequent pair of a bucket is looked up by it; others wait for the next round
            owner = seen
            rare_first = by_use[::-1]
            owner[_buckets((pairs >> 32).astype(np.uint32), (pairs & 0xFFFFFFFF).astype(np.uint32), bits)[rare_first]] = rare_first
            found = np.minimum(owner[bucket[at]], len(pairs) - 1)
            real = pairs[found] == keys
            best = np.full(len(symbols) + 1, _FREE)  # one more than pairs on either side
            best[at[real] + 1] = rank[found[real]]
            mine = best[at[real] + 1]
            after = np.r_[best, _FREE][at[real] + 2]
            spots = _apart(at[real][(mine <= best[at[real]]) & (mine <= after)])
            took = best[spots + 1]
            times = np.bincount(took, minlength=len(pairs))
            good = np.flatnonzero(times >= min_uses)[: max_rules - n_rules]
            name = np.zeros(len(pairs), np.uint32)
            name[good] = base + n_rules + np.arange(len(good))
            spots = spots[name[took] > 0]
            replaced = len(spots)
            made = pairs[by_use[good]]
            rules.append(np.stack([made >> 32, made & 0xFFFFFFFF], 1).astype(np.uint32))
            n_rules += len(good)
            symbols[spots] = name[best[spots + 1]]
            last[spots] = last[spots + 1]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            symbols, last = symbols[keep], last[keep]
        if least == min_uses and replaced < len(symbols) // WORTH:
            break
        least = max(least // FALL, min_uses)
    rounds = np.array([len(x) for x in rules if len(x)], np.uint32)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    ends = np.flatnonzero(last) + 1
    sizes = np.zeros(len(counts), np.uint32)
    sizes[counts > 0] = np.diff(np.r_[0, ends])
    return Grammar(base, rounds, pairs, expansion_lengths(base, rounds, pairs), np.asarray(counts, np.uint32), sizes, symbols)


def expansion_lengths(base: int, rounds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.ones(base + len(pairs), np.int64)
    done = 0
    for n in rounds.tolist():
        out[base + done : base + done + n] = out[pairs[done : done + n]].sum(axis=1)
        done += n
    return out[base:].astype(np.uint32)


@dataclass
class Grammar:
    """Documents of one shard."""

    base: int
    rounds: np.ndarray
    pairs: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray

    @cached_property
    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each rule's ids begin, all rules' ids end to end)."""
        length = self.lengths.astype(np.int64)
        starts = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.uint32)
        done = 0
        for n in self.rounds.tolist():
            for side, shift in ((0, np.zeros(n, np.int64)), (1, self._length(self.pairs[done : done + n, 0]))):
                part = self.pairs[done : done + n, side]
                flat[ragged(starts[done : done + n] + shift, self._length(part))] = self._ids(part, starts, flat)
            done += n
        return starts, flat

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def _ids(self, symbols: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        length = self._length(symbols)
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        rule = symbols >= self.base
        out[ends[~rule] - 1] = symbols[~rule]
        which = symbols[rule] - self.base
        out[ragged(ends[rule] - length[rule], length[rule])] = flat[ragged(starts[which], length[rule])]
        return out

    def ids(self) -> np.ndarray:
        """All documents' ids end to end."""
        return self._ids(self.symbols, *self._expanded)

    @cached_property
    def _begins(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.sizes.astype(np.int64))]

    def span(self, doc: int, start: int, n: int) -> np.ndarray:
        """``n`` ids of a document from ``start`` on; only the symbols over them are expanded."""
        part = self.symbols[self._begins[doc] : self._begins[doc + 1]]
        ends = np.cumsum(self._length(part))
        stop = min(start + n, int(ends[-1]) if len(ends) else 0)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, [start, stop - 1], side="right").tolist()
        skip = start - (int(ends[a - 1]) if a else 0)
        return self._opened(part[a : b + 1])[skip : skip + stop - start]

    def _opened(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a few symbols, rule by rule."""
        while (rule := symbols >= self.base).any():
            width = 1 + rule.astype(np.int64)
            out = np.empty(int(width.sum()), np.uint32)
            ends = np.cumsum(width)
            out[ends[~rule] - 1] = symbols[~rule]
            out[ends[rule] - 2], out[ends[rule] - 1] = self.pairs[symbols[rule] - self.base].T
            symbols = out
        return symbols

    def to_bytes(self, doc_ids: np.ndarray, has_id: np.ndarray) -> bytes:
        """The shard with its documents' ids."""
        wide = self.base + len(self.pairs) > 1 << 16
        head = _HEADER.pack(MAGIC, self.base, len(self.rounds), len(self.pairs), len(self.tokens), len(self.symbols), 4 if wide else 2, 0, 0)
        parts = [self.rounds.astype("<u4"), self.pairs.T.astype("<u4"), self.lengths.astype("<u4"), doc_ids.astype("<i8"), has_id.astype("u1")]
        parts += [self.tokens.astype("<u4"), self.sizes.astype("<u4"), self.symbols.astype("<u4" if wide else "<u2")]
        return head + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def from_bytes(raw: bytes) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """(grammar, document ids, whether each document has one)."""
    magic, base, n_rounds, n_rules, n_docs, n_symbols, width, _, _ = _HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = _HEADER.size
    out = []
    for kind, n in (("<u4", n_rounds), ("<u4", 2 * n_rules), ("<u4", n_rules), ("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_docs), (f"<u{width}", n_symbols)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    rounds, pairs, lengths, doc_ids, has_id, tokens, sizes, symbols = out
    return Grammar(base, rounds, pairs.reshape(2, -1).T, lengths, tokens, sizes, symbols.astype(np.uint32)), doc_ids, has_id.astype(bool)
