"""Repetition coverage: how much of a text stands in n-grams and lines that occur more than once.

N-grams of several lengths are found by rolling hashes in numpy, a block of
documents at a time; the characters of every word inside a duplicated n-gram
count once per length.  Words, n-grams and lines are told apart by 64-bit hashes
of all their bytes.  Rows never leave their partition: no shuffle.

Defined results: a null or empty text, or one without words, has zeros
everywhere and fails the base rule (fewer than 50 words); repeated rows each get
their own equal result; texts of any length are read whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_arrow
from .textblocks import (
    Block,
    blocks_of,
    covered,
    keyed_by_doc,
    lines_of,
    ngram_hashes,
    seen_before,
    seen_twice,
    texts_of,
    windows_inside,
)

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
BASE_NGRAM = 3
BASE_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest shares of word characters, in percent, inside duplicates.

    A word in a duplicated longer n-gram also lies in a duplicated base n-gram, so
    limits near ``BASE_REPEAT_PERCENT`` reject nothing that the base rule doesn't;
    they are well below it, and fall with the length, so that each acts by itself.
    """

    #: n-gram length in words -> percent of word characters inside n-grams found twice or more
    ngram_percent: tuple[tuple[int, int], ...] = ((4, 30), (6, 28), (10, 20))
    #: percent of word characters in lines equal to an earlier line
    line_percent: int = 15


_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _duplicate_ngrams(block: Block, words: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its document holds twice or more."""
    firsts = windows_inside(block.doc, n)
    keys = keyed_by_doc(ngram_hashes(words, n)[firsts], block.doc[firsts])
    return covered(len(words), firsts[seen_twice(keys)], n)


def measure_block(block: Block, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """All counts of a block's documents, as arrays."""
    n = block.n_docs
    words = block.word_hashes()
    is_char = (block.data & 0xC0) != 0x80
    char_at = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(block.in_word & is_char, out=char_at[1:])
    chars = (char_at[block.ends] - char_at[block.starts]).astype(np.int64)

    def total(doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)

    lines = lines_of(block)
    line_keys = keyed_by_doc(block.span_hashes(lines.starts, lines.ends), lines.doc)
    again = seen_before(line_keys)
    line_chars = char_at[lines.ends] - char_at[lines.starts]
    out = {
        "n_words": block.word_counts(),
        "word_chars": char_at[block.offsets[1:]] - char_at[block.offsets[:-1]],
        "n_symbols": block.per_doc(_IS_SYMBOL[block.data]),
        "n_dup_lines": total(lines.doc, again),
        "n_repeat_words": total(block.doc, _duplicate_ngrams(block, words, BASE_NGRAM)),
        "dup_line_chars": total(lines.doc, again * line_chars),
    }
    for size, _ in limits.ngram_percent:
        out[f"dup_{size}gram_chars"] = total(block.doc, _duplicate_ngrams(block, words, size) * chars)
    return out


def verdicts(counts: dict[str, np.ndarray], limits: RepetitionLimits) -> dict[str, np.ndarray]:
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > BASE_REPEAT_PERCENT * counts["n_words"])
    kept = ~failed & (100 * counts["dup_line_chars"] <= limits.line_percent * counts["word_chars"])
    for size, percent in limits.ngram_percent:
        kept &= 100 * counts[f"dup_{size}gram_chars"] <= percent * counts["word_chars"]
    return {"base_failed": failed, "kept": kept}


def measured_columns(limits: RepetitionLimits) -> list[str]:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    return base + [f"dup_{size}gram_chars" for size, _ in limits.ngram_percent]


def repetition_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RepetitionLimits | None = None) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``."""
    limits = limits or RepetitionLimits()
    names = measured_columns(limits)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        parts = [measure_block(block, limits) for _, _, block in blocks_of(texts)]
        counts = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}
        columns = {**counts, **verdicts(counts, limits)}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[k]) for k in [*names, "base_failed", "kept"])], [id_col, *names, "base_failed", "kept"])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return map_arrow(documents.select(F.col(id_col), F.col(text_col)), measure, schema)


def keep_unrepetitive(documents: DataFrame, text_col: str = "text", limits: RepetitionLimits | None = None) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns."""
    limits = limits or RepetitionLimits()
    at = documents.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(at))
        kept = [verdicts(measure_block(block, limits), limits)["kept"] for _, _, block in blocks_of(texts)]
        return batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return map_arrow(documents, keep, documents.schema)
