"""Byte-pair merging of pre-tokens, one or many at a time, and the splitting of texts into pre-tokens."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import regex

#: The characters with the White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Runs that a pre-token never crosses: white space but for the last blank before a
#: word, and a word's non-blank characters with one space before them.
UNIT = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

_SHORT = 64
_NONE = 1 << 62
_U64 = np.uint64
_EMPTY = _U64((1 << 64) - 1)
_NO_RANK = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a unit to its pre-tokens."""
    return regex.compile(pattern).findall


class PairTable:
    """Pairs of ids and their ranks in an open hash table whose lookups are numpy passes."""

    def __init__(self, ranks: dict[int, int]) -> None:
        pairs = np.fromiter(ranks.keys(), _U64, len(ranks))
        values = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.shift = _U64(64 - max(10, int(len(ranks)).bit_length() + 3))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, _EMPTY), np.full(size, _NO_RANK, np.int64)
        self.mask, self.probes = size - 1, 1
        at, left = self._slots(pairs), np.arange(len(pairs))
        while len(left):
            places, firsts = np.unique(at[left], return_index=True)
            free = self.keys[places] == _EMPTY
            placed = left[firsts[free]]
            self.keys[at[placed]], self.values[at[placed]] = pairs[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``_NO_RANK`` if it has none."""
        pairs = a.astype(_U64) << _U64(20) | b.astype(_U64)
        at = self._slots(pairs)
        held = self.keys[at]
        out = np.where(held == pairs, self.values[at], _NO_RANK)
        open_ = np.flatnonzero((held != pairs) & (held != _EMPTY))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            same = held == pairs[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (held != _EMPTY)]
        return out


@dataclass
class Merger:
    """Byte-level BPE over token ids.

    ``ranks`` maps a pair of ids, ``a << 20 | b``, to its rank, and ``joined`` the
    rank to the id of the joined token (None: the rank is the id).
    """

    ranks: dict[int, int]
    byte_ids: list[int]
    joined: list[int] | None = None
    _table: PairTable | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> tuple:
        return self.ranks, self.byte_ids, self.joined

    def __setstate__(self, state: tuple) -> None:
        self.ranks, self.byte_ids, self.joined = state
        self._table = None

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids end to end, and how many each has; as ``ids`` gives them one by one.

        Each round merges one pair of every piece that still has one with a rank.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts = [np.zeros(0, np.int64)]
        counts = np.zeros(len(pieces), np.int64)
        of_part: list[np.ndarray] = [np.zeros(0, np.int64)]
        for i in np.flatnonzero(lengths > _SHORT).tolist():
            found = self.ids(pieces[i])
            parts.append(np.array(found, np.int64))
            of_part.append(np.full(len(found), i))
        short = np.flatnonzero((lengths > 0) & (lengths <= _SHORT))
        data = b"".join([pieces[i] for i in short.tolist()] if len(short) < len(pieces) else pieces)
        ids, of = self._rounds(np.frombuffer(data, np.uint8), lengths[short])
        parts.append(ids)
        of_part.append(short[of])
        flat, owner = np.concatenate(parts), np.concatenate(of_part)
        counts += np.bincount(owner, minlength=len(pieces))
        if len(parts) > 2:
            flat = flat[np.argsort(owner, kind="stable")]
        return flat, counts

    def _rounds(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge short pieces, given end to end: their ids, in order, and the piece of each."""
        if self._table is None:
            self._table = PairTable(self.ranks)
            self._joined = np.array(self.joined, np.int64) if self.joined is not None else None
        table, joined = self._table, self._joined
        ids = np.array(self.byte_ids, np.int64)[data]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ranks = np.full(len(ids), _NO_RANK, np.int64)
        if len(ids) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[inner] = table.ranks(ids[inner], ids[inner + 1])
        done_ids, done_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(ids):
            firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), firsts)
            rank, at = least >> 32, least & 0xFFFFFFFF
            active = rank < _NO_RANK
            if not active.all():
                of = np.repeat(active, np.diff(firsts, append=len(ids)))
                done_ids.append(ids[~of])
                done_owner.append(owner[~of])
                shifted = np.cumsum(of) - 1
                ids, owner, ranks = ids[of], owner[of], ranks[of]
                at, rank = shifted[at[active]], rank[active]
                if not len(ids):
                    break
            ids[at] = joined[rank] if joined is not None else rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol goes from each piece before this one
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            right = at[(at + 1 < len(ids)) & (owner[np.minimum(at + 1, len(ids) - 1)] == owner[at])]
            ranks[at] = _NO_RANK
            left = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            changed = np.concatenate([left, right])
            ranks[changed] = table.ranks(ids[changed], ids[changed + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def ids(self, piece: bytes) -> list[int]:
        """Merge the neighbours of the lowest rank, leftmost first, until none has a rank.

        Short pieces are scanned; long ones keep their pairs in a heap, so a text
        without any break costs n log n.
        """
        byte_ids, get, joined = self.byte_ids, self.ranks.get, self.joined
        ids = [byte_ids[b] for b in piece]
        if len(ids) > _SHORT:
            return self._by_heap(ids)
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == _NONE:
                break
            i = ranks.index(lowest)
            ids[i] = joined[lowest] if joined else lowest
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, get, joined = len(ids), self.ranks.get, self.joined
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank = get(ids[i] << 20 | ids[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = (joined[rank] if joined else rank), -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]


def merger_of_ranks(ranks: dict[bytes, int]) -> Merger:
    """A pair's rank is the rank of its joined bytes."""
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = rank
    return Merger(pairs, [ranks[bytes([b])] for b in range(256)])


def merger_of_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Merger:
    """A pair's rank is its place in the list of merges; entries are in byte characters."""
    pairs = {vocabulary[a] << 20 | vocabulary[b]: rank for rank, (a, b) in enumerate(merges)}
    return Merger(pairs, [vocabulary[c] for c in byte_characters()], [vocabulary[a + b] for a, b in merges])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the others take code points
    from 256 on, in order.
    """
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]
