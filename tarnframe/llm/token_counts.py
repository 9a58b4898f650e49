"""Token counts with the whole-token shortcut.

Offline, for each string of the vocabulary: merge its bytes and split it by the
pre-tokenizer; if that gives one pre-token and one token, a pre-token equal to it
counts 1 without any merge.  That set and the merges (their size is the
vocabulary's, whatever the input) are broadcast.  Texts are cut into runs that no
pre-token crosses, told apart by 64-bit hashes; a run's hash and count are kept in a
bounded memo, so words that repeat cost a lookup, and the others of a block are
merged together, each distinct one once.  Rows never leave their partition: no shuffle.

The library's default for special strings inside a text holds: each counts as one
token and cuts the text.  Defined results: null and empty texts have 0 bytes and
0 tokens; repeated rows each get their own equal count; texts are read whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import repeat
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import UNIT, WHITE_SPACE, Merger, byte_characters, merger_of_merges, splitter
from .session import bound_batches
from .textblocks import IS_SPACE, Block, Texts, blocks_of, texts_of

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Runs whose hashes and counts a worker keeps; it starts anew when full.
MEMO_RUNS = 400_000


def unit_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs that no pre-token crosses, if all white space is ASCII.

    A word takes one blank before it; what is left of the white space between two
    words is a run, but for a last character that isn't a blank, which is one by itself.
    """
    data, offsets, doc = block.data, block.offsets, block.doc
    begins = offsets[:-1]
    before = begins[doc]
    if len(doc) > 1:
        before[1:] = np.where(doc[1:] == doc[:-1], block.ends[:-1], before[1:])
    blank = (block.starts > before) & (data[np.maximum(block.starts - 1, 0)] == 0x20)
    starts = block.starts - blank
    single = (starts > before) & ~blank
    last = begins.copy()
    last[doc] = block.ends  # the last word of each document wins
    tail, middle = np.flatnonzero(last < offsets[1:]), starts - single
    gap = np.flatnonzero(middle > before)
    single = np.flatnonzero(single)
    return (
        np.concatenate([starts, before[gap], middle[single], last[tail]]),
        np.concatenate([block.ends, middle[gap], starts[single], offsets[1:][tail]]),
        np.concatenate([doc, doc[gap], doc[single], tail]),
    )


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of white space that isn't ASCII."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    a, b, c = (np.append(data, np.zeros(2, np.uint8))[at + k].astype(np.int64) for k in range(3))
    return at[np.isin(np.where(a == 0xC2, a << 8 | b, a << 16 | b << 8 | c), _WIDE)]


#: UTF-8 bytes, as numbers, of the white space that isn't ASCII.
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in re.findall(f"[{WHITE_SPACE}]", "".join(map(chr, range(128, 0x4000))))])


class Numbering(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


@dataclass
class WholeTokens:
    """What counting needs of a tokenizer."""

    merger: Merger
    #: strings proven to be one pre-token and one token
    whole: frozenset[str]
    special: tuple[str, ...]
    pattern: str = public_tokenizers.PATTERN
    _memo: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._split = splitter(self.pattern)
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def count(self, texts: Texts) -> np.ndarray:
        """The tokens of each text."""
        parts = [self._count_block(block) for _, _, block in blocks_of(texts)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _count_block(self, block: Block) -> np.ndarray:
        starts, ends, doc = unit_spans(block)
        apart = self._apart(block)
        if apart.any():
            kept = ~apart[doc]
            starts, ends, doc = starts[kept], ends[kept], doc[kept]
        hashes, firsts, which = np.unique(block.span_hashes(starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        sizes = np.fromiter(map(self._memo.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(sizes < 0)
        sizes[new] = self._sizes(block.data, starts[firsts[new]], ends[firsts[new]])
        if len(self._memo) + len(new) > MEMO_RUNS:
            self._memo.clear()
        self._memo.update(zip(hashes[new].tolist(), sizes[new].tolist()))
        out = np.bincount(doc, weights=sizes[which], minlength=block.n_docs).astype(np.int64)
        for i in np.flatnonzero(apart).tolist():
            out[i] = self._count_text(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode())
        return out

    def _apart(self, block: Block) -> np.ndarray:
        """Which documents hold special strings or white space that isn't ASCII."""
        places = [_wide_blanks(block.data)]
        raw = block.data.tobytes() if self.special else b""
        for special in map(str.encode, self.special):
            at = raw.find(special)
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(special, at + 1)
        apart = np.zeros(block.n_docs, bool)
        apart[np.searchsorted(block.offsets, np.concatenate(places), side="right") - 1] = True
        return apart

    def _count_text(self, text: str) -> int:
        parts = self._cut.split(text) if self._cut is not None else [text]
        runs = [run for part in parts for run in UNIT.findall(part)]
        number = Numbering()
        which = np.fromiter(map(number.__getitem__, runs), np.int64, len(runs))
        return len(parts) - 1 + int(self._sizes_of(list(number))[which].sum())

    def _sizes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each run of bytes."""
        out, worded = np.zeros(len(starts), np.int64), ~IS_SPACE[data[ends - 1]]
        alone = ~worded
        if self.pattern == public_tokenizers.PATTERN:
            out[worded] = self._sizes_together(data, starts[worded], ends[worded])
        else:
            alone[:] = True
        raw = data.tobytes()
        out[alone] = self._sizes_of([raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())])
        return out

    def _sizes_together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``_sizes_of`` of runs that end in words: one pass over all, each followed by a line feed, splits them as one by one."""
        lengths = ends - starts + 1
        upto = np.cumsum(lengths)
        at = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - lengths - starts, lengths)
        joined = data[np.minimum(at, len(data) - 1)]
        joined[upto - 1] = 0x0A
        pieces, number = self._split(joined.tobytes().decode()), Numbering()
        feed = number["\n"]
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        sizes = self._piece_sizes(list(number))
        sizes[feed] = 0
        total = np.concatenate([[0], np.cumsum(sizes[which])])
        return np.diff(total[np.flatnonzero(which == feed)], prepend=0)

    def _sizes_of(self, runs: list[str]) -> np.ndarray:
        """Tokens of each run."""
        cut, number = [self._split(run) for run in runs], Numbering()
        which = np.fromiter((number[piece] for found in cut for piece in found), np.int64)
        total = np.concatenate([[0], np.cumsum(self._piece_sizes(list(number))[which])])
        return np.diff(total[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))], prepend=0)

    def _piece_sizes(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token; those that aren't whole tokens are merged."""
        rest = [i for i, piece in enumerate(pieces) if piece not in self.whole]
        sizes = np.ones(len(pieces), np.int64)
        sizes[rest] = self.merger.many([pieces[i].encode() for i in rest])[1]
        return sizes


def _check_kind(file: dict) -> None:
    """Raise for settings that this operator doesn't implement, rather than count otherwise than the library."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = [
        model.get("type", "BPE") == "BPE",
        file.get("normalizer") is None,
        before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True),
        not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")),
        not any(t.get(k) for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")),
    ]
    if not all(plain):
        raise ValueError("only byte-level BPE files without a normalizer, a prefix space or special merge settings are supported")


def prove_whole_tokens(path: str) -> WholeTokens:
    """Read a byte-level tokenizer file and prove which vocabulary strings are whole tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    _check_kind(file)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merger, split = merger_of_merges(model["vocab"], pairs), splitter(public_tokenizers.PATTERN)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    special = tuple(t["content"] for t in file.get("added_tokens", ()))
    whole = set()
    for entry in model["vocab"]:
        if entry in special or not all(c in byte_of for c in entry):
            continue
        try:
            text = bytes(byte_of[c] for c in entry).decode()
        except UnicodeDecodeError:  # part of a character: no pre-token is equal to it
            continue
        if split(text) == [text] and len(UNIT.findall(text)) == 1 and len(merger.ids(text.encode())) == 1:
            whole.add(text)
    return WholeTokens(merger, frozenset(whole), special)


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    bound_batches(documents.sparkSession)
    proven = prove_whole_tokens(path or public_tokenizers.path(VOCABULARY))
    shared = documents.sparkSession.sparkContext.broadcast((proven.merger, proven.whole, proven.special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WholeTokens(*shared.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(texts.offsets)), pa.array(counts), pa.array(counts > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
