"""Byte-pair encoding of many pre-tokens at once: rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie end to end in one symbol array. A round finds each
pre-token's lowest-rank pair, merges the leftmost occurrences of it in every pre-token
at once, and looks up ranks only where neighbours changed. The symbols that survive are
the tokens. Pre-tokens seen before come from a bounded cache in the Python worker.

Pre-tokens of plain texts (ASCII and accented Latin-1 letters) are cut on byte arrays too: classes of
bytes and their changes. The cache is keyed by the pre-token's bytes. A text with anything else is cut
at spaces and line ends, where no pre-token goes on; of its pieces those with control separators or
characters beyond Latin Extended-B are folded and cut by the vocabulary's own rules (the ``tokenizers``
library's normaliser and pre-tokeniser, whose character tables decide) and merged here like all others.
Only pieces with a special string are left to the library whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import distinct_runs, ragged

NO_RANK = np.int64(1 << 40)
#: Pieces that a worker remembers; beyond it the cache starts anew.
CACHE_PIECES, CACHE_SYMBOLS = 700_000, 6_000_000
#: Bytes worked on at once.
BLOCK = 2 << 20
_WHITE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of texts that are not plain: control separators and all but the accented Latin-1 letters.
_BAD = np.zeros(256, bool)
_BAD[[0x00, *range(0x1C, 0x20), 0xC2, *range(0xC4, 0x100)]] = True
_ODD = re.compile("[\x00\x1c-\x1f\x85]|[^\x00-\u024f]|<\\|")
#: The vocabulary's own pre-token pattern, said in ``re`` for characters that _ODD lets through (\w holds some number signs there).
_SPECIAL = "<|"
_SIMPLE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\\w\\s]|_)+")


def _byte_letters() -> list[str]:
    """The letters that stand for bytes 0-255 in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Encoder:
    """Token ids of texts for one vocabulary file, as ragged uint32 arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        first = np.unique(keys, return_index=True)[1]  # sorted by key
        self.keys, self.ranks, self.made = keys[first], first.astype(np.int64), made
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16 if self.width < 65536 else np.uint32)
        self.starts, self.counts, self.used, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0, 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per piece) of pre-tokens given as bytes; none may be empty."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(n), lengths)
        rank = np.full(len(symbols), NO_RANK)  # of the pair that starts here
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            low = np.minimum.reduceat(rank, starts)
            if (low == NO_RANK).any():  # finished pre-tokens leave
                alive = np.repeat(low != NO_RANK, sizes)
                done_ids.append(symbols[~alive])
                done_owner.append(owner[~alive])
                symbols, owner, rank = symbols[alive], owner[alive], rank[alive]
                low, sizes = low[low != NO_RANK], sizes[low != NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a a a: from the left, every other one of a run
                new_run = np.r_[True, np.diff(at) != 1]
                place = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, owner, rank, changed = symbols[keep], owner[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            spots = np.flatnonzero(changed)
            inside = spots + 1 < len(symbols)
            rank[spots[~inside]] = NO_RANK
            spots = spots[inside]
            rank[spots] = np.where(owner[spots] == owner[spots + 1], self._rank(symbols[spots], symbols[spots + 1]), NO_RANK)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        who = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return ids[order], np.bincount(who, minlength=n)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pre-tokens that the cache does not hold and add them to it."""
        if not pieces:
            return
        ids, counts = self.merge(pieces)
        m = len(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + m > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + m] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : self.n + m] = counts
        self.index.update(zip(pieces, range(self.n, self.n + m), strict=True))
        self.used, self.n = self.used + len(ids), self.n + m

    def _places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the cache, first byte) of every pre-token of plain bytes."""
        low = _LOWER[raw]
        accent = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        low[1:][accent] += 0x20
        kind = _KIND[low]
        edge = np.ones(len(low), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = np.flatnonzero(edge)
        solid = kind[at] != _WHITE
        begin, end = at[solid], np.r_[at[1:], len(low)][solid]
        if (alone := np.flatnonzero((low[begin] == 0x27) & (end == begin + 1) & (np.r_[begin[1:], -1] == end))).size:  # contractions
            nxt = np.r_[low, np.zeros(3, np.uint8)]
            first, second = nxt[begin[alone] + 1], nxt[begin[alone] + 2]
            inside = end[alone + 1] - begin[alone + 1] > 1
            two = inside & (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
            takes = np.where(np.isin(first, np.frombuffer(b"stmd", np.uint8)), 1, np.where(two, 2, 0))
            end[alone] += takes
            begin[alone + 1] += takes
            begin, end = begin[begin < end], end[begin < end]
        if not len(begin):
            return np.zeros(0, np.int64), begin
        pieces, codes = distinct_runs(low[kind != _WHITE], end - begin)
        self._learn([x for x in pieces if x not in self.index])
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))[codes], begin

    def _cut(self, piece: str) -> list[bytes]:
        """Pre-tokens of a piece by the vocabulary's own rules."""
        folded = self.library.normalizer.normalize_str(piece)
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)]

    def _odd_ids(self, text: str) -> list[int]:
        """A text with odd pieces: those with special strings go through the library, all others through the merge."""
        parts: list[bytes | str] = []
        for x in re.split("[ \n]+", text):
            if _SPECIAL in x:
                parts.append(x)
            elif x:
                parts += self._cut(x) if _ODD.search(x) else [y.encode() for y in _SIMPLE.findall(x.lower())]
        distinct = list(dict.fromkeys(x for x in parts if isinstance(x, bytes)))
        ids, counts = self.merge(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.cumsum(counts)
        known = {x: ids[e - c : e].tolist() for x, e, c in zip(distinct, ends.tolist(), counts.tolist(), strict=True)}
        whole = {x: self.library.encode(x, add_special_tokens=False).ids for x in {x for x in parts if isinstance(x, str)}}
        return [i for x in parts for i in (known[x] if isinstance(x, bytes) else whole[x])]

    def encode(self, texts: list[bytes], only_count: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, tokens of each text); ids are left out with ``only_count``."""
        if self.n > CACHE_PIECES or self.used > CACHE_SYMBOLS:
            self.reset()
        cuts = [(i, x) for i, text in enumerate(texts) for x in _blocks(text)]
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        a = 0
        while a < len(cuts):
            b, size = a, 0
            while b < len(cuts) and (b == a or size + len(cuts[b][1]) < BLOCK):
                size += len(cuts[b][1])
                b += 1
            ids, found = self._block([x for _, x in cuts[a:b]], only_count)
            np.add.at(counts, [i for i, _ in cuts[a:b]], found)
            out += ids
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def _block(self, texts: list[bytes], only_count: bool) -> tuple[list[np.ndarray], np.ndarray]:
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
        ends = np.cumsum([len(x) + 1 for x in texts])
        bad = _BAD[raw]
        bad[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(bad), side="right"))
        for k in odd.tolist():
            raw[ends[k] - len(texts[k]) - 1 : ends[k]] = 0x20
        places, begin = self._places(raw)
        n = self.counts[places].astype(np.int64)
        sums, edges = np.r_[0, np.cumsum(n)], np.searchsorted(begin, np.r_[0, ends])
        counts = np.diff(sums[edges])
        strange = {k: self._odd_ids(texts[k].decode()) for k in odd.tolist()}
        for k, ids in strange.items():
            counts[k] = len(ids)
        if only_count:
            return [], counts
        ids = self.pool[ragged(self.starts[places], n)].astype(np.uint32)
        if not strange:
            return [ids], counts
        return [np.array(strange[k], np.uint32) if k in strange else ids[sums[edges[k]] : sums[edges[k + 1]]] for k in range(len(texts))], counts


def _blocks(text: bytes) -> list[bytes]:
    """A very long text in blocks that end at spaces, where no pre-token goes on."""
    out = []
    while len(text) > BLOCK and (cut := text.rfind(b" ", 0, BLOCK)) > 0:
        out.append(text[:cut])
        text = text[cut + 1 :]
    return [*out, text]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def default_path() -> str:
    """The vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
