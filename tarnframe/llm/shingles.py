"""Sets of word shingles as 64-bit hashes, in an order that puts rare shingles first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import Block, mix64, ngram_hashes, windows_inside

#: Cells of the frequency table; fixed, so what is broadcast doesn't grow.
TABLE_BITS = 24
_CHUNKS = 64
#: Partitions whose tables are added in one go.
PARTS_TOGETHER = 256
_U64 = np.uint64


def shingle_hashes(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each ``k``-word shingle of lower-cased words; a text of fewer words is one shingle."""
    words = block.word_hashes(lower=True)
    firsts = windows_inside(block.doc, k)
    docs, hashes = [block.doc[firsts]], [ngram_hashes(words, k)[firsts]]
    counts = block.word_counts()
    begins = np.cumsum(counts) - counts
    for short in range(1, k):
        doc = np.flatnonzero(counts == short)
        if len(doc):
            docs.append(doc)
            hashes.append(mix64(ngram_hashes(words, short)[begins[doc]] + _U64(k - short)))
    return np.concatenate(docs), np.concatenate(hashes)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U64(64 - TABLE_BITS)).astype(np.int64)


def ranked_sets(docs: np.ndarray, hashes: np.ndarray, n_docs: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by document, rare ones first (then by value), and the documents' edges.

    ``rarity`` is a byte per table cell.  One sort of a composed key does it; should
    two hashes of a document agree in all bits that fit, a slower sort takes over.
    """
    rank = rarity[cells(hashes)].astype(_U64)
    doc_bits = max(1, int(n_docs - 1).bit_length())
    key = docs.astype(_U64) << _U64(64 - doc_bits) | rank << _U64(56 - doc_bits) | hashes >> _U64(8 + doc_bits)
    order = np.argsort(key, kind="stable")
    key, ranked = key[order], hashes[order]
    same_key = key[1:] == key[:-1]
    if np.any(same_key & (ranked[1:] != ranked[:-1])):
        order = np.lexsort((hashes, rank, docs))
        ranked = hashes[order]
        same = (ranked[1:] == ranked[:-1]) & (docs[order][1:] == docs[order][:-1])
    else:
        same = same_key
    keep = np.ones(len(ranked), dtype=bool)
    keep[1:] = ~same
    counts = np.bincount(docs[order][keep], minlength=n_docs)
    return ranked[keep], np.concatenate([[0], np.cumsum(counts)])


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts, mostly 0 or 1, compressed: how many, which aren't 0, and those as bytes (as eight from 255 on)."""
    held = counts[counts > 0]
    large = held >= 255
    parts = [np.array([len(counts)], "<u8"), np.packbits(counts > 0), np.where(large, 255, held).astype(np.uint8), held[large].astype("<u8")]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 3)


def unpacked_counts(packed: bytes) -> np.ndarray:
    """The counts of ``packed_counts``."""
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    at = 8 - (-n // 8)
    flags = np.unpackbits(raw[8:at], count=n).astype(bool)
    n_held = int(flags.sum())
    held = raw[at : at + n_held].astype(_U64)
    held[held == 255] = np.frombuffer(raw[at + n_held :].tobytes(), "<u8")
    out = np.zeros(n, _U64)
    out[flags] = held
    return out


def table_parts(table: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A fixed-size table of counts as numbered, packed chunks."""
    return list(range(_CHUNKS)), [packed_counts(c) for c in np.split(table, _CHUNKS)]


def _adder(finish: Callable[[np.ndarray], bytes], more: int):
    """Adds a chunk's packed parts; ``more``: how many key columns follow the chunk's number."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(1 + more).to_pylist():
                counts = unpacked_counts(part)
                total = counts if total is None else total + counts
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([finish(total)], pa.binary())], ["chunk", "part"])

    return add


def summed_table(parts: DataFrame, finish: Callable[[np.ndarray], np.ndarray], dtype: type = np.uint8) -> np.ndarray | None:
    """Add up tables given as rows (chunk, part) on the executors; ``finish`` turns sums into ``dtype``.

    The tables of ``PARTS_TOGETHER`` partitions at a time are added first, then their
    sums, so no task reads a part of every partition.  Only the finished table, of a fixed
    size, comes to the driver.
    """
    if parts.rdd.getNumPartitions() > PARTS_TOGETHER:
        together = parts.select("chunk", F.floor(F.spark_partition_id() / PARTS_TOGETHER).cast("int").alias("some"), "part")
        parts = together.groupBy("chunk", "some").applyInArrow(_adder(packed_counts, 1), "chunk int, part binary")
    last = _adder(lambda total: finish(total).astype(dtype).tobytes(), 0)
    rows = sorted((r["chunk"], bytes(r["part"])) for r in parts.groupBy("chunk").applyInArrow(last, "chunk int, part binary").collect())
    return np.frombuffer(b"".join(part for _, part in rows), dtype) if rows else None


def tables_of(df: DataFrame, per_partition: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> DataFrame:
    """One table per partition, as rows for ``summed_table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, packed = table_parts(per_partition(batches))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "part"])

    return df.mapInArrow(run, "chunk int, part binary")


def log_scale(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight steps to a doubling."""
    return np.minimum(255, 8 * np.log2(counts.astype(float) + 1))
