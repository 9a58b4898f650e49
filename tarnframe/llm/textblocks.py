"""Vectorised access to text columns in Arrow batches.

Texts stay UTF-8 bytes in one numpy buffer; words, lines and n-grams are found
and hashed for a whole block of documents at once, so no Python object is made
per word.  A block holds whole documents only: at most ``BLOCK_BYTES`` of text,
or one document that is longer than that by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U64 = np.uint64
_MIX_A = _U64(0xBF58476D1CE4E5B9)
_MIX_B = _U64(0x94D049BB133111EB)
_GOLDEN = _U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _MIX_A
    x = x ^ (x >> _U64(27))
    x = x * _MIX_B
    return x ^ (x >> _U64(31))


#: Maps the bytes of A-Z to those of a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Masks for the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U64)

#: Word separators: space and the five controls from tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII letters in lower case."""
    return _LOWER[data]


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number; zeros follow the data."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))


def beginning_hashes(data: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """``span_hashes`` of the first bytes, for sizes of at most eight."""
    first = _eight_bytes(data)[starts]
    return [mix64(mix64(first & _FIRST_BYTES[k]) ^ _U64(k * int(_GOLDEN) % (1 << 64))) for k in sizes]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands.

    Eight bytes at a time are mixed together with their place in the span, and the
    results are added up; spans of at most eight bytes have different hashes for certain
    if they are equally long.
    """
    words = _eight_bytes(data)
    lengths = ends - starts
    total = mix64(words[starts] & _FIRST_BYTES[np.minimum(lengths, 8)])
    longer = np.flatnonzero(lengths > 8)
    if len(longer):
        rest = (lengths[longer] - 1) >> 3
        firsts = np.cumsum(rest) - rest
        place = np.arange(int(rest.sum())) - np.repeat(firsts, rest) + 1
        at = np.repeat(starts[longer], rest) + 8 * place
        more = words[at] & _FIRST_BYTES[np.minimum(np.repeat(ends[longer], rest) - at, 8)]
        total[longer] += np.add.reduceat(mix64(more ^ mix64(place.astype(_U64) * _GOLDEN)), firsts)
    return mix64(total ^ lengths.astype(_U64) * _GOLDEN)


@dataclass
class Texts:
    """A text column: its bytes, offsets (one more than rows) and which rows are not null."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.valid)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null rows count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    _, offset_buffer, data_buffer = column.buffers()
    if n == 0 or offset_buffer is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid)
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    if not valid.all() and np.any(np.diff(offsets)[~valid]):
        filled = texts_of(column.fill_null(""))
        return Texts(filled.data, filled.offsets, valid)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0], valid)


def block_ranges(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


@dataclass
class Block:
    """Whole documents' bytes with the places of their words."""

    data: np.ndarray
    offsets: np.ndarray
    in_word: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, starts, ends)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(lowered(self.data) if lower else self.data, self.starts, self.ends)


def block_of(texts: Texts, first: int, last: int) -> Block:
    """The documents of rows ``first`` to ``last`` (exclusive) with their words found."""
    base = texts.offsets[first]
    offsets = texts.offsets[first : last + 1] - base
    data = texts.data[base : texts.offsets[last]]
    n = len(data)
    in_word = ~IS_SPACE[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = in_word[:-1], in_word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(in_word & ~before)
    ends = np.flatnonzero(in_word & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Block(data, offsets, in_word, starts, ends, doc)


def blocks_of(texts: Texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    for first, last in block_ranges(texts.offsets, limit):
        yield first, last, block_of(texts, first, last)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive words (documents' edges are the caller's matter)."""
    if len(words) < n:
        return np.zeros(0, dtype=_U64)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total *= _U64(_BASE)
        total += words[k : len(words) - n + 1 + k]
    return mix64(total)


def windows_inside(doc: np.ndarray, n: int) -> np.ndarray:
    """First words of the ``n``-word windows that lie within one document."""
    if len(doc) < n:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])


def keyed_by_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values in the same document."""
    return mix64(hashes + doc.astype(_U64) * _GOLDEN)


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    flags = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twin = np.zeros(len(keys), dtype=bool)
        twin[1:] |= same
        twin[:-1] |= same
        flags[order] = twin
    return flags


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    flags = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        flags[order[1:]] = ranked[1:] == ranked[:-1]
    return flags


def covered(n_words: int, firsts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the ``n``-word windows that begin at ``firsts``."""
    steps = np.zeros(n_words + 1, dtype=np.int32)
    steps[firsts] += 1
    steps[firsts + n] -= 1
    return np.cumsum(steps[:-1]) > 0


@dataclass
class Lines:
    """Lines (split at line feeds) that hold a word."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


def lines_of(block: Block) -> Lines:
    n = len(block.data)
    breaks = np.flatnonzero(block.data == 0x0A)
    filled = np.flatnonzero(np.diff(block.offsets) > 0)
    starts = np.union1d(block.offsets[:-1][filled], breaks + 1)
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    last_is_break = (ends > starts) & (block.data[np.maximum(ends - 1, 0)] == 0x0A)
    ends = ends - last_is_break
    words_before = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(block.in_word, out=words_before[1:])
    keep = words_before[ends] > words_before[starts]
    starts, ends = starts[keep], ends[keep]
    return Lines(starts, ends, np.searchsorted(block.offsets, starts, side="right") - 1)
