"""Noisy-channel deobfuscation, and toxicity scores of the restored text.

Channel: a writer puts look-alike signs for letters, separators between letters,
and repeats letters.  Spans that may be so written become a lattice of readings:
words with letters and a look-alike, words with separators between letters, runs
of equal letters, and two or more single letters in a row, each with or without
separators around it.  Viterbi search finds the reading of least channel cost
plus surprise under a trigram model of characters, which is counted over all
documents.  Other words have one reading, themselves, and aren't searched; of
words with look-alikes these are words that only end in stars (any vowel, or
nothing).  Letters that aren't ASCII count as one symbol of the model, and
repetitions of theirs are searched only in words that are searched anyway.

Scores: words and word beginnings of restored texts that are far more frequent in
toxic rows form a lexicon; a logistic function of a text's hits gives the score.
The lexicon comes from a bounded sample of labelled rows (``max_rows``), of which
copies with one label count once; the function is fitted to hits in lexicons of the
half of the sample that a row isn't in (of the whole sample, if only one row is of a
kind).

Character counts come from every document; they and the lexicon have fixed sizes.
Rows never leave their partition.  Defined results: null and empty texts have no
hits and get the score of none; repeated rows get equal scores; of equally likely
readings (a tie) the first found stays; without labels of both kinds every score is
that of no hits, below 1e-12; very long texts are read whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .session import bound_batches, map_arrow, settled
from .shingles import TABLE_BITS, ranked_sets, shingle_hashes, summed_table, tables_of
from .textblocks import Block, Texts, beginning_hashes, block_of, block_ranges, keyed_by_doc, lowered, mix64, span_hashes, texts_of

MAX_ROWS = 20_000
FEATURE_BITS = 20
#: Bytes of word beginnings that are features, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Spans whose reading a worker keeps (it starts anew when full), and the longest it keeps.
MEMO_SPANS = 100_000
MEMO_SPAN = 64

#: Letters that a sign can stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiou"}
SEPARATORS = " .-_*'~,"
LOOK_ALIKE_COST, KEEP_COST, SKIP_COST, BREAK_COST, REPEAT_COST = 1.0, 10.0, 0.2, 2.5, 0.6
#: Two equal letters are far more often spelling than disguise.
DOUBLE_COST = 5.0
#: Look-alikes that are punctuation at the end of a word.
CLOSING = "!|+"

_SYMBOLS = 32  # 0: no letter, 1-26: a-z, 27: any other letter; the rest is unused
_OTHER = 27
_U64 = np.uint64


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = _OTHER
    return table


_SYMBOL_OF = _symbol_table()
_LETTER = _SYMBOL_OF > 0
_ASCII_LETTER = (_SYMBOL_OF > 0) & (_SYMBOL_OF < _OTHER)
_LOOKS = np.zeros(256, bool)
_LOOKS[[ord(c) for c in LOOK_ALIKES if c != "*"]] = True
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[ord(c) for c in SEPARATORS if c != " "]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class CharacterModel:
    """Surprise (negative log probability) of a symbol after two others."""

    surprise: np.ndarray
    _memo: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of_counts(counts: np.ndarray) -> CharacterModel:
        """Each order is smoothed by the one below."""
        triples = counts.reshape((_SYMBOLS,) * 3).astype(float)
        pairs, singles = triples.sum(axis=0), triples.sum(axis=(0, 1))
        one = (singles + 1) / (singles.sum() + _SYMBOLS)
        two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
        three = (triples + 5 * two) / (triples.sum(axis=2, keepdims=True) + 5)
        return CharacterModel(-np.log(three))

    def restore(self, span: str) -> str:
        """The most likely reading of an obfuscated span."""
        found = self._memo.get(span)
        if found is None:
            found = self._viterbi(span.lower())
            if len(span) <= MEMO_SPAN:
                if len(self._memo) >= MEMO_SPANS:
                    self._memo.clear()
                self._memo[span] = found
        return found

    def _viterbi(self, span: str) -> str:
        surprise = self.surprise
        # state: the last two symbols; its value: cost, the last letter written, and the path
        states: dict[tuple[int, int], tuple[float, str, tuple | None]] = {(0, 0): (0.0, "", None)}
        closing = len(span.rstrip(CLOSING + SEPARATORS))
        for at, c in enumerate(span):
            readings = _readings(c, at >= closing)
            # a letter or sign may repeat an equal one before it, at a higher cost if they are two; a sign also another one that it can stand for
            thrice = any(span[max(k, 0) : k + 3] == 3 * c for k in (at - 2, at - 1) if k >= 0)
            double = at > 0 and span[at - 1] == c
            repeats = c in LOOK_ALIKES and not (at >= closing and c in CLOSING) or double and c.isalpha()
            repeat_cost = DOUBLE_COST if double and not thrice else REPEAT_COST
            following: dict[tuple[int, int], tuple[float, str, tuple | None]] = {}

            def offer(state: tuple[int, int], cost: float, last: str, path: tuple | None) -> None:
                old = following.get(state)
                if old is None or cost < old[0]:
                    following[state] = (cost, last, path)

            for (p, q), (cost, last, path) in states.items():
                for symbol, sign, price in readings:
                    if symbol < 0:
                        offer((p, q), cost + price, last, path)
                    elif symbol == 0 and q == 0:
                        offer((p, q), cost + price, "", (path, sign))
                    else:
                        offer((q, symbol), cost + price + surprise[p, q, symbol], sign, (path, sign))
                    if repeats and sign and sign == last:
                        offer((p, q), cost + repeat_cost, last, path)
            states = following
        ends = ((cost + (surprise[p, q, 0] if q else 0.0), path) for (p, q), (cost, _, path) in states.items())
        path = min(ends, key=lambda x: x[0])[1]
        out = []
        while path is not None:
            path, sign = path
            out.append(sign)
        return "".join(reversed(out))


def _readings(c: str, closing: bool = False) -> list[tuple[int, str, float]]:
    """(symbol, sign written, cost) of a character; symbol -1 writes nothing.  ``closing``: no letter follows."""
    if "a" <= c <= "z":
        return [(ord(c) - 96, c, 0.0)]
    if c.isalpha():
        return [(_OTHER, c, 0.0)]
    out = [(ord(x) - 96, x, LOOK_ALIKE_COST) for x in LOOK_ALIKES.get(c, "")]
    if c in SEPARATORS:
        out += [(-1, "", SKIP_COST), (0, c, BREAK_COST)]
    else:
        out.append((0, c, (BREAK_COST if closing and c in CLOSING else KEEP_COST) if out else 0.0))
    return out


def character_counts(data: np.ndarray) -> np.ndarray:
    """How often each three symbols follow each other."""
    symbols = _SYMBOL_OF[data].astype(np.int64)
    if len(symbols) < 3:
        return np.zeros(_SYMBOLS**3, np.int64)
    return np.bincount((symbols[:-2] * _SYMBOLS + symbols[1:-1]) * _SYMBOLS + symbols[2:], minlength=_SYMBOLS**3)


def count_characters(documents: DataFrame, text_col: str = "text") -> CharacterModel:
    """The character model of all documents."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for first, last in block_ranges(texts.offsets):
                table += character_counts(texts.data[texts.offsets[first] : texts.offsets[last]])
        return np.minimum(table, 0xFFFFFFFF)

    total = summed_table(tables_of(documents.select(text_col), per_partition), lambda x: x, np.uint64)
    return CharacterModel.of_counts(total if total is not None else np.zeros(_SYMBOLS**3))


def _outermost(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each span where ``at`` holds; the last is before the first if there is none."""
    places = np.flatnonzero(at)
    low, high = np.searchsorted(places, starts), np.searchsorted(places, ends)
    padded = np.concatenate([places, [0]])
    some = high > low
    return np.where(some, padded[low], ends), np.where(some, padded[high - 1], starts - 1)


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def suspicious_spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans that look obfuscated; ``doubled_spans`` has the words with two equal letters."""
    data, starts, ends = block.data, block.starts, block.ends
    if not len(starts):
        return starts, ends
    letter, looks, apart = _LETTER[data], _LOOKS[data], _SEPARATES[data]
    first, last = _outermost(letter, starts, ends)
    signs = _sums(looks)
    flagged = (first <= last) & (signs[ends] > signs[starts])
    # separators, stars among them, between a word's letters, and stars before them
    marks = _sums(apart)
    some, after = np.minimum(first, len(data)), np.maximum(last, 0)
    flagged |= (first <= last) & (marks[after] > marks[some])
    flagged |= (first <= last) & (data[np.maximum(first - 1, 0)] == 0x2A) & (first > starts)
    low = np.where(_ASCII_LETTER[data], data | 0x20, 0)
    equal = (low[1:] > 0) & (low[1:] == low[:-1])
    thrice = _sums(np.concatenate([equal[1:] & equal[:-1], np.zeros(2, bool)])[: len(data)])
    flagged |= (ends - starts > 2) & (thrice[np.maximum(ends - 2, starts)] > thrice[starts])
    # single letters in a row, with separators around them or not, as one span; without any letter, four signs or more
    core, core_last = _outermost(~apart, starts, ends)
    at = np.minimum(core, len(data) - 1)
    single = (core == core_last) & (_ASCII_LETTER[data[at]] | looks[at])
    change = np.flatnonzero((np.diff(single.astype(np.int8)) != 0) | (np.diff(block.doc) != 0)) + 1
    runs = np.concatenate([[0], change, [len(single)]])
    lettered = _sums(single & _ASCII_LETTER[data[at]])
    size = np.diff(runs)
    long = single[runs[:-1]] & ((size >= 4) | (size >= 2) & (lettered[runs[1:]] > lettered[runs[:-1]]))
    flagged &= ~np.repeat(long, size)
    run_starts, run_ends = starts[runs[:-1][long]], ends[runs[1:][long] - 1]
    starts, ends = np.concatenate([starts[flagged], run_starts]), np.concatenate([ends[flagged], run_ends])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def doubled_spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """From the first letter to the last of each word with two equal letters: mostly plain words, but searched as well."""
    data = block.data
    low = np.where(_ASCII_LETTER[data], data | 0x20, 0)
    equal = np.flatnonzero((low[1:] > 0) & (low[1:] == low[:-1]))
    word = np.unique(np.searchsorted(block.starts, equal, side="right") - 1)
    first, last = _outermost(_LETTER[data], block.starts[word], block.ends[word])
    return first, last + 1


def searched_spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All spans that the search sees, in order and apart from each other."""
    starts, ends = suspicious_spans(block)
    more, upto = doubled_spans(block)
    if len(starts):
        before = np.searchsorted(starts, more, side="right") - 1
        fresh = (upto <= starts[np.minimum(before + 1, len(starts) - 1)]) | (before + 1 == len(starts))
        fresh &= (before < 0) | (ends[before] <= more)
        more, upto = more[fresh], upto[fresh]
    starts, ends = np.concatenate([starts, more]), np.concatenate([ends, upto])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def restored_texts(block: Block, model: CharacterModel) -> Texts:
    """The block's texts with their suspicious spans restored."""
    starts, ends = searched_spans(block)
    raw = block.data.tobytes()
    pieces, grown, at = [], np.zeros(len(starts), np.int64), 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        span = raw[a:b].decode("utf-8", "replace")
        new = model.restore(span)
        new = raw[a:b] if new == span.lower() else new.encode()
        pieces += [raw[at:a], new]
        grown[i] = len(new) - (b - a)
        at = b
    pieces.append(raw[at:])
    total = np.concatenate([[0], np.cumsum(grown)])
    offsets = block.offsets + total[np.searchsorted(ends, block.offsets, side="right")]
    return Texts(np.frombuffer(b"".join(pieces), np.uint8), offsets, np.ones(block.n_docs, bool))


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words' documents, and hashes of their features: a column for the whole word and one for each beginning."""
    data = block.data
    starts, ends = block.starts.copy(), block.ends.copy()
    for _ in range(4):
        ends -= (ends - starts > 1) & _EDGE[data[ends - 1]]
        starts += (ends - starts > 1) & _EDGE[data[starts]]
    data = lowered(data)
    columns = [span_hashes(data, starts, ends)]
    for k, beginning in zip(BEGINNINGS, beginning_hashes(data, starts, BEGINNINGS)):
        hashes = mix64(beginning + _U64(k))
        columns.append(np.where(ends - starts > k, hashes, columns[0]))
    return block.doc, np.column_stack(columns)


def feature_cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature's cells in the two tables; it counts as known only if both say so."""
    low = hashes >> _U64(64 - 2 * FEATURE_BITS) & _U64((1 << FEATURE_BITS) - 1)
    return (hashes >> _U64(64 - FEATURE_BITS)).astype(np.int64), low.astype(np.int64)


@dataclass
class ToxicityModel:
    characters: CharacterModel
    #: weight of each cell of the two tables; 0 for what isn't in the lexicon
    lexicon: np.ndarray
    coefficients: np.ndarray

    def hits(self, texts: Texts) -> np.ndarray:
        """For each text: its heaviest hit, the log of its number of hits, and their share of words."""
        parts = [np.zeros((0, 3))]
        for first, last in block_ranges(texts.offsets):
            restored = restored_texts(block_of(texts, first, last), self.characters)
            block = block_of(restored, 0, len(restored))
            doc, features = word_features(block)
            a, b = feature_cells(features)
            weight = np.minimum(self.lexicon[0][a], self.lexicon[1][b]).max(axis=1) if len(features) else np.zeros(0)
            found = weight > 0
            most = np.zeros(block.n_docs)
            np.maximum.at(most, doc[found], weight[found])
            n_hits = np.bincount(doc[found], minlength=block.n_docs)
            share = n_hits / np.maximum(block.word_counts(), 1)
            parts.append(np.column_stack([most, np.log1p(n_hits), np.sqrt(share)]))
        return np.concatenate(parts)

    def scores(self, hits: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(hits), 1)), hits]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lexicon_of(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each feature the log-odds of toxic against clean rows, less 1.64 of its standard errors; 0 if that is small.

    ``counts`` are by table, label (toxic first) and cell; ``rows`` by label.  A feature
    needs three toxic rows, or all of them if they are fewer.
    """
    toxic, clean = counts[:, 0], counts[:, 1]
    odds = np.log((toxic + 0.5) / (rows[0] + 1)) - np.log((clean + 0.5) / (rows[1] + 1))
    sure = odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.where((sure > 1) & (toxic >= min(3, rows[0])), sure, 0.0).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 60) -> np.ndarray:
    """Newton steps on the mean logistic loss; the first coefficient is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def copy_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Add a fingerprint of each text's set of shingles: copies share it, and count once."""
    texts, keys = texts_of(batch.column(1)), [np.zeros(0, np.int64)]
    for first, last in block_ranges(texts.offsets):
        block = block_of(texts, first, last)
        docs, hashes = shingle_hashes(block, 5)
        sets, edges = ranked_sets(docs, hashes, block.n_docs, np.zeros(1 << TABLE_BITS, np.uint8))
        total = np.concatenate([np.zeros(1, _U64), np.cumsum(mix64(sets))])
        keys.append(mix64(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(_U64)).view(np.int64))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys))], [*batch.schema.names, "_key"])


def train(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Characters from all documents; lexicon and score from at most ``max_rows`` rows with crc32(id) mod 5 not 0."""
    bound_batches(documents.sparkSession)
    characters = count_characters(documents, text_col)
    size = 1 << FEATURE_BITS
    model = ToxicityModel(characters, np.zeros((2, size), np.float32), np.array([-30.0, 0, 0, 0]))
    sample = labelled_sample(documents, labels, id_col, text_col, label_col, held_out(id_col, 5, 0), max_rows)
    kind = documents.schema[id_col].dataType.simpleString()
    keyed = settled(map_arrow(sample, copy_keys, f"`{id_col}` {kind}, _text string, _label int, _key long"))
    # of copies with one label that with the smallest id; the median of its ids' hashes halves each kind of label
    once = keyed.groupBy("_key", "_label").agg(F.min(id_col).alias(id_col))
    once = once.withColumns({"_kind": F.col("_label") > 0, "_dealt": F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1 << 40))})
    middle = once.groupBy("_kind").agg(F.median("_dealt").alias("_middle"))
    once = once.join(F.broadcast(middle), "_kind").withColumn("_half", (F.col("_dealt") > F.col("_middle")).cast("int")).drop("_kind", "_dealt", "_middle")
    sample = settled(keyed.join(F.broadcast(once), [id_col, "_key", "_label"], "inner").select(id_col, "_text", "_label", "_half"))

    def presence(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """By half, table and label (toxic first): the rows with each feature."""
        table = np.zeros((2, 2, 2, size), np.uint32)
        for batch in batches:
            texts = texts_of(batch.column(1))
            half, clean = batch.column(3).to_numpy(), (batch.column(2).to_numpy() <= 0).astype(int)
            for first, last in block_ranges(texts.offsets):
                restored = restored_texts(block_of(texts, first, last), characters)
                doc, features = word_features(block_of(restored, 0, len(restored)))
                of_feature = np.repeat(doc, features.shape[1])
                _, once = np.unique(keyed_by_doc(features.ravel(), of_feature), return_index=True)
                of_feature, found = of_feature[once] + first, feature_cells(features.ravel()[once])
                for h in (0, 1):
                    for k in (0, 1):
                        mine = (half[of_feature] == h) & (clean[of_feature] == k)
                        for at in (0, 1):
                            table[h, at, k] += np.bincount(found[at][mine], minlength=size).astype(np.uint32)
        return table.ravel()

    numbers = np.zeros((2, 2))
    for half, clean, n in sample.groupBy("_half", (F.col("_label") <= 0).alias("k")).count().collect():
        numbers[half, int(clean)] = n
    if not numbers.sum(axis=0).all():
        return model
    counts = summed_table(tables_of(sample, presence), lambda x: x, np.uint32).reshape(2, 2, 2, size).astype(float)
    # a half that lacks a kind, as only one row has it, gives no lexicon: the whole sample's takes its place
    whole = counts.sum(axis=0), numbers.sum(axis=0)
    given = [(counts[h], numbers[h]) if numbers[h].all() else whole for h in (1, 0)]
    other = [ToxicityModel(characters, lexicon_of(*g), model.coefficients) for g in given]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Hits in the lexicon of the half that the row isn't in."""
        half = batch.column(3).to_numpy()
        x = np.zeros((len(half), 3))
        for k in (0, 1):
            x[half == k] = other[k].hits(texts_of(batch.column(1).filter(pa.array(half == k))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in x.T)], ["id", "label", "a", "b", "c"])

    rows = map_arrow(sample, measure, f"id {kind}, label int, a double, b double, c double").toPandas()
    rows = rows.sort_values(["id", "a", "b", "c"], kind="stable")
    model.lexicon = lexicon_of(*whole)
    model.coefficients = fit_logistic(rows[["a", "b", "c"]].to_numpy(), rows["label"].gt(0).to_numpy(float))
    return model


def score(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.scores(shared.value.hits(texts_of(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col), F.col(text_col), held_out(id_col, 5, 0).alias("_held_out"))
    return map_arrow(rows, measure, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def restore(documents: DataFrame, characters: CharacterModel, text_col: str = "text") -> DataFrame:
    """``documents`` with obfuscated spans of the text restored; null texts stay null."""
    at = documents.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(batch.column(at)), []
        for first, last in block_ranges(texts.offsets):
            new = restored_texts(block_of(texts, first, last), characters)
            raw = new.data.tobytes()
            out += [raw[a:b].decode() for a, b in zip(new.offsets[:-1].tolist(), new.offsets[1:].tolist())]
        column = pa.array([x if ok else None for x, ok in zip(out, texts.valid)], pa.string())
        return pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return map_arrow(documents, run, documents.schema)
