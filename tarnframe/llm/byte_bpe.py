"""Byte-level BPE by a global distinct-word shuffle, and its inverse.

Encoding explodes texts into pre-tokens with positions, block by block (whole
documents, ``TEXT_PER_BLOCK`` bytes of text, or one longer document).  A block's
distinct words go, packed, to the partition that their hash names; there each
distinct word of the corpus is merged once, whatever number of blocks hold it (again
only if the task's memo of ``MEMO_BYTES`` has overflowed since), and the ids join back
to the blocks.  A block's positions travel beside them as a
compressed stream of word numbers, and with the ids the texts' id lists are
reassembled by position.  A word is sent once a block, so a frequent word costs a
word partition no more rows than there are blocks.

Decoding joins ids to the table of token bytes, which is as large as the
vocabulary and broadcast.

A task numbers its blocks; a block's number also holds a checksum of its content.  Should the input not be
replayed alike after a loss (a file scan is), the parts of a block would not meet
and the job fails rather than giving a wrong result.

Defined results: null and empty texts have no ids; repeated rows and ids each get
their own result; of pairs that tie in rank the leftmost is merged first; very long
texts are a block by themselves, read whole; an empty table gives an empty result;
extra columns are ignored by ``encode`` and passed on by ``decode``, which gives its
result another name if a column has it already.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import UNIT, Merger, merger_of_ranks, read_ranks, splitter
from .session import bound_batches, unused_names
from .textblocks import block_ranges, texts_of

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
TEXT_PER_BLOCK = 16 << 20
#: Bytes of words and ids that a worker keeps, roughly (it starts anew when full), and the longest word it keeps.
MEMO_BYTES = 64 << 20
MEMO_WORD = 64
_MEMO_ENTRY = 170
#: Word partitions for each partition of the input, and at most.
PARTS_PER_PARTITION = 4
MAX_PARTS = 4096
#: Bytes of word lists whose words are merged together.
LISTS_TOGETHER = 256 << 10
#: Pre-tokens gathered at a time when texts are reassembled.
GATHER = 1 << 19
_STREAM = -1


def pack_parts(*parts: bytes | np.ndarray) -> bytes:
    """Several arrays or byte strings as one compressed string."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    head = struct.pack(f"<{len(raw)}Q", *map(len, raw))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack_parts(packed: bytes, n: int) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(packed))
    sizes = struct.unpack_from(f"<{n}Q", raw)
    out, at = [], 8 * n
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def byte_planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, all first bytes before all second ones: it compresses better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(planes: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[start : start + length]`` over all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) - np.repeat(ends - lengths - starts, lengths)]


#: Word numbers below the first bound take one byte, below the second two, others three.
_ONE, _TWO = 160, 224
_FREQUENT = _ONE + (_TWO - _ONE) * 256


def number_planes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers as planes of first, second and third bytes; small numbers are frequent."""
    if len(numbers) and numbers.max() >= _FREQUENT + (256 - _TWO) * 65536:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8), numbers.astype(np.uint32).view(np.uint8)
    two, three = numbers - _ONE, numbers - _FREQUENT
    in_two, in_three = (two >= 0) & (three < 0), three >= 0
    first = np.where(in_three, _TWO + (three >> 16), np.where(in_two, _ONE + (two >> 8), numbers)).astype(np.uint8)
    second = np.where(in_three, three >> 8, two)[in_two | in_three].astype(np.uint8)
    return first, second, three[in_three].astype(np.uint8)


def numbers_of_planes(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    if not len(first):
        return third.view(np.uint32).astype(np.int64)
    numbers = first.astype(np.int64)
    longer = np.flatnonzero(first >= _ONE)
    in_three = first[longer] >= _TWO
    values = np.where(in_three, (numbers[longer] - _TWO) << 8, (numbers[longer] - _ONE) << 8) + second
    values[in_three] = (values[in_three] << 8) + third + (_FREQUENT - _ONE)
    numbers[longer] = values + _ONE
    return numbers


class Numbering(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _explode(texts: Iterator[str | None], split) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, all texts' word numbers, and how many each text has.

    The most frequent words have the smallest numbers, for the stream's sake; the
    others follow in alphabetical order, for the word lists' sake.
    """
    runs, number, counts = Numbering(), [], []
    for text in texts:
        found = UNIT.findall(text) if text else []
        number.append(np.fromiter(map(runs.__getitem__, found), np.int32, len(found)))
        counts.append(len(found))
    words, pieces, n_pieces = Numbering(), [], []
    for run in runs:
        cut = split(run)
        pieces += map(words.__getitem__, cut)
        n_pieces.append(len(cut))
    n_pieces, pieces = np.array(n_pieces, np.int64), np.array(pieces, np.int32)
    by_run = np.concatenate(number) if number else np.zeros(0, np.int32)
    del number
    starts = np.cumsum(n_pieces) - n_pieces
    lengths = n_pieces[by_run]
    upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    stream = ragged(pieces, starts[by_run], lengths)
    listed = list(words)
    order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")
    order[_FREQUENT:] = sorted(order[_FREQUENT:].tolist(), key=listed.__getitem__)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return [listed[i] for i in order], rank[stream], np.diff(upto)


def _pack_block(ids: pa.Array, column: pa.Array, split, n_parts: int, task: int, serial: int) -> list[tuple]:
    """Rows (part, task, block, kind, payload): the words of each part, and the stream of positions."""
    words, stream, counts = _explode((x for at in range(0, len(column), 256) for x in column.slice(at, 256).to_pylist()), split)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    head = sink.getvalue().to_pybytes()
    planes = number_planes(stream)
    block = serial << 32 | zlib.crc32(planes[0].tobytes(), zlib.crc32(head))
    encoded = [w.encode() for w in words]
    part_of = np.fromiter((zlib.crc32(w) % n_parts for w in encoded), np.int64, len(encoded))
    order = np.argsort(part_of, kind="stable")
    edges = np.searchsorted(part_of[order], np.arange(n_parts + 1))
    lengths = np.fromiter(map(len, encoded), np.uint32, len(encoded))
    rows = []
    for k in range(n_parts):
        mine = order[edges[k] : edges[k + 1]]
        if len(mine):
            steps = byte_planes(np.diff(mine, prepend=0))
            rows.append((k, task, block, k, pack_parts(steps, byte_planes(lengths[mine]), b"".join([encoded[i] for i in mine]))))
    rows.append((zlib.crc32(struct.pack("<qq", task, serial)) % n_parts, task, block, _STREAM, pack_parts(head, byte_planes(counts), np.array([len(words)], np.uint64), *planes)))
    return rows


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    part, task, block, kind, payload = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (part, task, block, kind)), pa.array(payload, pa.binary())], ["part", "task", "block", "kind", "payload"])


_ROWS = "part long, task long, block long, kind long, payload binary"


class WordIds:
    """The ids of words, packed; a task merges each distinct word once as long as its memo holds."""

    def __init__(self, merger: Merger) -> None:
        self.merger, self.memo, self.held = merger, {}, 0

    def of(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as unsigned 32-bit integers."""
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            ids, counts = self.merger.many(new)
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            for word, a, b in zip(new, [0, *ends], ends):
                memo[word] = raw[a:b]
        found = [memo[w] for w in words]
        for word in new:
            if len(word) > MEMO_WORD:
                del memo[word]
            else:
                self.held += len(word) + len(memo[word]) + _MEMO_ENTRY
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        return found


def _merge_words(payloads: list[bytes], known: WordIds) -> list[bytes]:
    """Word lists with ids for words; the lists' new words are merged together."""
    lists, words = [], []
    for payload in payloads:
        steps, lengths, joined = unpack_parts(payload, 3)
        joined, ends = bytes(joined), np.cumsum(of_planes(lengths).astype(np.int64)).tolist()
        lists.append((bytes(steps), len(words), len(words) + len(ends)))
        words += [joined[a:b] for a, b in zip([0, *ends], ends)]
    ids, out = known.of(words), []
    for steps, a, b in lists:
        sizes = np.fromiter(map(len, ids[a:b]), np.int64, b - a) // 4
        out.append(pack_parts(steps, byte_planes(sizes), byte_planes(np.frombuffer(b"".join(ids[a:b]), "<u4"))))
    return out


class TokenBytes:
    """The table of token bytes, by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(table), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids, ``GATHER`` ids at a time."""
        parts = (ids[at : at + GATHER] for at in range(0, len(ids), GATHER))
        return b"".join(ragged(self.pool, self.starts[c], self.lengths[c]).tobytes() for c in parts)


def _reassemble(kinds: list[int], payloads: list[bytes], tokens_of: TokenBytes | None) -> tuple[pa.Array, np.ndarray, list[bytes], list[bytes | None]]:
    """Ids of the block's documents, their token counts, their packed token ids, and those decoded (if asked for)."""
    at = [i for i, k in enumerate(kinds) if k == _STREAM]
    if len(at) != 1:
        raise RuntimeError("a block's words and positions did not meet: the input was not replayed alike")
    head, counts, n_words, *planes = unpack_parts(payloads[at[0]], 6)
    doc_ids = pa.ipc.open_stream(head).read_all().column(0).combine_chunks()
    counts = of_planes(counts).astype(np.int64)
    sizes = np.zeros(int(np.frombuffer(n_words, np.uint64)[0]), np.int64)
    starts, pool, base = np.zeros(len(sizes), np.int64), [], 0
    for kind, payload in zip(kinds, payloads):
        if kind != _STREAM:
            steps, lengths, ids = unpack_parts(payload, 3)
            places = np.cumsum(of_planes(steps).astype(np.int64))
            lengths = of_planes(lengths).astype(np.int64)
            sizes[places] = lengths
            starts[places] = base + np.cumsum(lengths) - lengths
            pool.append(of_planes(ids))
            base += len(pool[-1])
    if len(sizes) and not sizes.all():
        raise RuntimeError("a block's words are not complete: the input was not replayed alike")
    pool = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
    stream = numbers_of_planes(*(np.frombuffer(p, np.uint8) for p in planes))
    edges = np.concatenate([[0], np.cumsum(counts)])
    n_tokens, packed, decoded = np.zeros(len(counts), np.int64), [], []
    for first, last in block_ranges(edges, GATHER):
        mine = stream[edges[first] : edges[last]]
        tokens = ragged(pool, starts[mine], sizes[mine])
        upto = np.concatenate([[0], np.cumsum(sizes[mine])])[edges[first : last + 1] - edges[first]]
        n_tokens[first:last] = np.diff(upto)
        raw = tokens.astype("<u4", copy=False).tobytes()
        packed += [raw[4 * a : 4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        if tokens_of is not None:
            text = tokens_of.join(tokens)
            cuts = np.concatenate([[0], np.cumsum(tokens_of.lengths[tokens])])[upto].tolist()
            decoded += [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return doc_ids, n_tokens, packed, decoded or [None] * len(packed)


def encode(documents: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", text_per_block: int = TEXT_PER_BLOCK, decoded: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, and ids packed as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids also join the table of token bytes where they are
    reassembled, into one more column; ``decode`` does the same for ids from elsewhere.
    """
    bound_batches(documents.sparkSession)
    spark = documents.sparkSession
    ranks = ranks or read_ranks(public_tokenizers.path(RANK_FILE))
    shared = spark.sparkContext.broadcast(merger_of_ranks(ranks))
    token_bytes = spark.sparkContext.broadcast(TokenBytes(ranks) if decoded else None)
    source = documents.select(F.col(id_col), F.col(text_col))
    n_partitions = source.rdd.getNumPartitions()
    n_parts = min(max(1, n_partitions) * PARTS_PER_PARTITION, MAX_PARTS)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        task, serial = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held, waiting
            if waiting:
                table = pa.Table.from_batches(waiting).combine_chunks()
                waiting, held = [], 0
                ids, column = (table.column(i).combine_chunks() for i in (0, 1))
                ids, column = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, column))
                yield _as_batch(_pack_block(ids, column, split, n_parts, task, serial))
                serial += 1

        for batch in batches:
            offsets = texts_of(batch.column(1)).offsets
            first = 0
            while first < len(offsets) - 1:
                room = max(text_per_block - held, 0)
                last = int(np.searchsorted(offsets, offsets[first] + room, side="right")) - 1
                if last <= first:
                    if held:
                        yield from flush()
                        continue
                    last = first + 1
                waiting.append(batch.slice(first, last - first))
                held += int(offsets[last] - offsets[first])
                first = last
                if held >= text_per_block:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(shared.value)
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] == _STREAM:
                    yield _as_batch([row])
                    continue
                waiting.append(row)
                if sum(len(r[4]) for r in waiting) >= LISTS_TOGETHER:
                    yield _as_batch([(*r[:4], p) for r, p in zip(waiting, _merge_words([r[4] for r in waiting], known))])
                    waiting = []
        if waiting:
            yield _as_batch([(*r[:4], p) for r, p in zip(waiting, _merge_words([r[4] for r in waiting], known))])

    def reassemble(table: pa.Table) -> pa.Table:
        doc_ids, n_tokens, packed, texts = _reassemble(table.column("kind").to_pylist(), table.column("payload").to_pylist(), token_bytes.value)
        arrays = [doc_ids, pa.array(n_tokens), pa.array(packed, pa.binary()), pa.array(texts, pa.binary())]
        return pa.table(arrays[:3] + arrays[3:] * decoded, [id_col, "n_tokens", "ids"] + ["decoded"] * decoded)

    kind = documents.schema[id_col].dataType.simpleString()
    words = source.mapInArrow(explode, _ROWS).repartition(n_parts, "part")
    merged = words.mapInArrow(merge, _ROWS)
    # as many partitions as the input has: the session's number needn't suit it
    blocks = merged.repartition(max(1, n_partitions), "task", "block")
    return blocks.groupBy("task", "block").applyInArrow(reassemble, f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Replace the packed ids by the bytes of their tokens; other columns pass."""
    ranks = ranks or read_ranks(public_tokenizers.path(RANK_FILE))
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks))
    columns = encoded.columns
    at = columns.index(ids_col)
    (out_col,) = unused_names([c for c in columns if c != ids_col], out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if packed is None else shared.value.join(np.frombuffer(packed, "<u4")) for packed in batch.column(at).to_pylist()]
            arrays = [pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, [out_col if c == ids_col else c for c in columns])

    schema = ", ".join(f"`{out_col}` binary" if f.name == ids_col else f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema)
