"""Bradley-Terry quality classifier.

Each document gets a strength that is linear in features of its text.  The
weights come from preference pairs (a document labelled good beats one labelled
bad): the logistic loss on the difference of the pair's features, which is the
Bradley-Terry likelihood.  The cut is a quantile of the fitted rows' strengths,
the share of them labelled bad; scores are the logistic of the distance to it,
so 0.5 lies at the cut.

Fitting uses every labelled row that isn't held out, and every pair of a good and
a bad one.  Pairs aren't formed: the loss depends on two strengths only, so what a
row adds is a smooth function of its strength, which follows from the other
class's strengths counted on a fine grid (see ``fit_weights``).  Each step is a few
sums over the rows' features, which stay in the checkpoint folder; the driver gets
tables of fixed size from each task.  The steps begin at the weights of a few thousand
rows, so that few of them read all rows.  Scoring streams whole texts through numpy
without a shuffle.

Defined results: null and empty texts are scored as texts without words; repeated
rows get equal scores; an id labelled twice takes its larger label, and of an id's
documents one is fitted, that whose features come first as bytes; without labels of both kinds every score is 0.5; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out
from .session import bound_batches, map_arrow, settled
from .textblocks import (
    Block,
    Texts,
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

_RIDGE = 1e-3
#: Nodes of the grid of strengths, and of the coarser one for the curvature.
_FINE, _COARSE = 8192, 256
_ROUNDS = 50
#: Rows, roughly, whose weights the fit of all rows begins with.
_FIRST_ROWS = 4096
#: Labelled rows of one task, roughly, and tasks at most.
_TASK_ROWS, _MAX_TASKS = 16_384, 512

#: Character classes whose share of the text is a feature.
CHARACTER_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&", "|", "<>{}[]\\", "!?", ".", ",;:", "/@_=+-", "\"'()", "\n")


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for k, members in enumerate(CHARACTER_CLASSES, 1):
        table[[ord(c) for c in members]] = k
    table[128:] = len(CHARACTER_CLASSES) + 1
    return table


_CLASS_OF = _class_table()
_N_CLASSES = len(CHARACTER_CLASSES) + 2


def block_features(block: Block) -> np.ndarray:
    """A row of features for each document of a block."""
    n = block.n_docs
    n_bytes = np.diff(block.offsets).astype(float)
    n_words = block.word_counts().astype(float)
    per_word = 1 / np.maximum(n_words, 1)
    of_byte = np.repeat(np.arange(n, dtype=np.int64), np.diff(block.offsets))
    classes = np.bincount(of_byte * _N_CLASSES + _CLASS_OF[block.data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    per_kind = classes[:, 1:] / np.maximum(n_bytes, 1)[:, None]

    def mean(doc: np.ndarray, weights: np.ndarray, over: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=weights, minlength=n) * over

    words = block.word_hashes()
    lengths = (block.ends - block.starts).astype(float)
    mean_length = mean(block.doc, lengths, per_word)
    spread = np.sqrt(np.maximum(mean(block.doc, lengths**2, per_word) - mean_length**2, 0))
    repeats = np.zeros(len(words))
    if len(words) > 1:
        repeats[1:] = (words[1:] == words[:-1]) & (block.doc[1:] == block.doc[:-1])
    known = seen_before(keyed_by_doc(words, block.doc))
    first, last = (block.data[block.starts], block.data[block.ends - 1]) if len(words) else (np.zeros(0, np.uint8),) * 2
    firsts = windows_inside(block.doc, 3)
    triples = covered(len(words), firsts[seen_twice(keyed_by_doc(ngram_hashes(words, 3)[firsts], block.doc[firsts]))], 3)
    lines = lines_of(block)
    n_lines = np.bincount(lines.doc, minlength=n)
    same_lines = seen_before(keyed_by_doc(block.span_hashes(lines.starts, lines.ends), lines.doc))
    columns = [
        np.log1p(n_words),
        np.minimum(n_words, 50) / 50,
        np.log1p(n_bytes),
        mean_length,
        spread,
        mean(block.doc, lengths <= 3, per_word),
        mean(block.doc, lengths >= 12, per_word),
        mean(block.doc, repeats, per_word),
        mean(block.doc, known, per_word),
        mean(block.doc, triples, per_word),
        mean(block.doc, (first >= 65) & (first <= 90), per_word),
        mean(block.doc, (last < 48) | ((last > 57) & (last < 65)), per_word),
        mean(block.doc, (last == 0x2E) | (last == 0x2C), per_word),
        mean(lines.doc, same_lines, 1 / np.maximum(n_lines, 1)),
        np.log1p(n_words / np.maximum(n_lines, 1)),
        *np.sqrt(per_kind.T),
    ]
    return np.column_stack(columns)


def text_features(texts: Texts) -> np.ndarray:
    parts = [block_features(block) for _, _, block in blocks_of(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


N_FEATURES = 15 + _N_CLASSES - 1


@dataclass
class QualityModel:
    """Strength: ``clip((x - centre) / scale) @ weights``; its cut and the slope of the score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def expanded(self, features: np.ndarray) -> np.ndarray:
        return expand((features - self.centre) / self.scale)

    def strengths(self, features: np.ndarray) -> np.ndarray:
        return self.expanded(features) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(features) - self.cut), -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, with their squares: both extremes of a feature can be bad."""
    z = np.clip(z, -4, 4)
    return np.hstack([z, z * z])


def fit_pairs(differences: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Newton steps on the mean logistic loss of ``w @ difference`` with a ridge."""
    w = np.zeros(differences.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = _RIDGE * w - differences.T @ p / len(differences)
        curvature = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences)
        step = np.linalg.solve(curvature + _RIDGE * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: What a function of (features, labels) gives over all rows: its values for parts of them, put together by a ufunc.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ufunc], np.ndarray]


def on_grid(s: np.ndarray, low: float, step: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The node below each value and how far the value is on its way to the next node."""
    at = (s - low) / step
    node = np.clip(at.astype(np.int64), 0, size - 2)
    return node, at - node


def counted(node: np.ndarray, part: np.ndarray, size: int, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights dealt to the two nodes around each value."""
    return np.bincount(node, weights * (1 - part), size) + np.bincount(node + 1, weights * part, size)


def against(f: Callable[[np.ndarray], np.ndarray], counts: np.ndarray, step: float) -> np.ndarray:
    """For each node k the sum over nodes j of ``f((k - j) * step) * counts[j]``, as a convolution."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    kernel = f(np.arange(1 - n, n) * step)
    return np.fft.irfft(np.fft.rfft(kernel, size) * np.fft.rfft(counts, size), size)[n - 1 : 2 * n - 1]


def _beaten(u: np.ndarray) -> np.ndarray:
    """The probability that the bad one of a pair wins, whose strength is ``u`` below the good one's."""
    return 1 / (1 + np.exp(np.clip(u, -500, 500)))


def _curvature(u: np.ndarray) -> np.ndarray:
    return _beaten(u) * _beaten(-u)


def fit_weights(total: Total, model: QualityModel, n_good: int, n_bad: int, start: np.ndarray | None = None) -> np.ndarray:
    """Newton steps on the mean logistic loss of all pairs with a ridge, from ``start`` or zero.

    The loss has one minimum, so the start decides how many steps there are and not where they end.

    Loss and gradient come from strengths counted on ``_FINE`` nodes, between which the
    logistic is taken as straight: with strengths 40 apart it is wrong by less than 1e-6.
    The coarser grid only shapes the steps, not where they end.
    """
    pairs, size = float(n_good) * n_bad, len(model.weights)
    w = np.zeros(size) if start is None else start
    last, before = np.inf, w
    for _ in range(_ROUNDS):
        here = QualityModel(model.centre, model.scale, w)

        def extent(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = here.strengths(x)
            return np.array([s.min(initial=np.inf), -s.max(initial=-np.inf)])

        low, high = total(extent, np.minimum) * (1, -1)
        fine, coarse = ((high - low) / (n - 1) or 1.0 for n in (_FINE, _COARSE))

        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            node, part = on_grid(here.strengths(x), low, fine, _FINE)
            return np.stack([counted(node[k], part[k], _FINE) for k in (y > 0, y <= 0)])

        good, bad = total(count, np.add)
        loss = good @ against(lambda u: np.logaddexp(0, -u), bad, fine) / pairs + _RIDGE / 2 * w @ w
        if loss > last + 1e-5:
            w = (w + before) / 2
            continue
        nodes = on_grid(low + fine * np.arange(_FINE), low, coarse, _COARSE)
        pulls = against(_beaten, bad, fine), -against(lambda u: _beaten(-u), good, fine)
        bends = [against(_curvature, counted(*nodes, _COARSE, other), coarse) for other in (bad, good)]

        def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s, z = here.strengths(x), here.expanded(x)
            gradient, square, sums = np.zeros(size), np.zeros((size, size)), []
            for k, pull, bend in zip((y > 0, y <= 0), pulls, bends):
                node, part = on_grid(s[k], low, fine, _FINE)
                gradient -= z[k].T @ (pull[node] * (1 - part) + pull[node + 1] * part)
                node, part = on_grid(s[k], low, coarse, _COARSE)
                square += (z[k] * (bend[node] * (1 - part) + bend[node + 1] * part)[:, None]).T @ z[k]
                sums += [counted(node, part, _COARSE, column) for column in z[k].T]
            return np.concatenate([gradient, square.ravel(), np.concatenate(sums)])

        found = total(slopes, np.add)
        gradient, square, sums = found[:size], found[size : size + size**2].reshape(size, size), found[size + size**2 :].reshape(2, size, _COARSE)
        apart = _curvature((np.arange(_COARSE)[:, None] - np.arange(_COARSE)) * coarse)
        cross = sums[0] @ apart @ sums[1].T
        curvature = (square - cross - cross.T) / pairs
        step = np.linalg.solve(curvature + _RIDGE * np.eye(size), _RIDGE * w + gradient / pairs)
        w, last, before = w - step, loss, w
        if np.abs(step).max() < 1e-6:
            break
    return w


def nth_strength(total: Total, model: QualityModel, n: int) -> float:
    """The n-th smallest strength (from 0) of all rows."""
    return nth_strengths(total, model, [n])[0]


def nth_strengths(total: Total, model: QualityModel, ranks: list[int]) -> list[float]:
    """The strengths of all rows at the given ranks (from 0), found together by eleven bits of their order at a time."""

    def ordered(x: np.ndarray) -> np.ndarray:
        bits = model.strengths(x).view(np.int64)
        return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)

    prefixes, left = [0] * len(ranks), list(ranks)
    for shift in (55, 44, 33, 22, 11, 0):

        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            keys = ordered(x) >> np.uint64(shift)
            tops, digits = keys >> np.uint64(11), (keys & np.uint64(2047)).astype(np.int64)
            return np.stack([np.bincount(digits[tops == prefix], minlength=2048) for prefix in prefixes])

        tables = np.cumsum(total(count, np.add), axis=1)
        for k, upto in enumerate(tables):
            digit = int(np.searchsorted(upto, left[k], side="right"))
            left[k] -= int(upto[digit - 1]) if digit else 0
            prefixes[k] = prefixes[k] << 11 | digit
    bits = np.array(prefixes, np.uint64) ^ np.uint64(1 << 63)
    bits = bits.view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64).tolist()


def fit_rows(total: Total, weigh: Callable[[QualityModel, int, int], np.ndarray]) -> QualityModel:
    """A model of all rows, whose weights ``weigh`` finds from the standard and the numbers of good and bad rows."""
    sums = total(lambda x, y: np.concatenate([[np.sum(y > 0), np.sum(y <= 0)], x.sum(axis=0)]), np.add)
    n_good, n_bad, d = int(sums[0]), int(sums[1]), len(sums) - 2
    n = n_good + n_bad
    if not n_good or not n_bad:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(2 * d))
    centre = sums[2:] / n
    scale = np.sqrt(total(lambda x, y: ((x - centre) ** 2).sum(axis=0), np.add) / n) + 1e-6
    model = QualityModel(centre, scale, np.zeros(2 * d))
    model.weights = weigh(model, n_good, n_bad)
    place = n_bad / n * (n - 1)
    below, above = nth_strengths(total, model, [int(place), min(int(place) + 1, n - 1)])
    model.cut = below + (above - below) * (place - int(place))
    return model


def fit_bradley_terry(features: np.ndarray, labels: np.ndarray, n_pairs: int | None = None, seed: int = 7) -> QualityModel:
    """Learn from all (good, bad) pairs of the given rows, or from ``n_pairs`` random ones if that is asked for."""

    def total(f: Callable, merge: np.ufunc) -> np.ndarray:
        return f(features, labels)

    def drawn(model: QualityModel, n_good: int, n_bad: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        z = model.expanded(features)
        good, bad = np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)
        return fit_pairs(z[rng.choice(good, n_pairs)] - z[rng.choice(bad, n_pairs)])

    return fit_rows(total, drawn if n_pairs else lambda *given: fit_weights(total, *given))


def labelled_features(documents: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int | None) -> DataFrame:
    """(``_label``, ``_x``: features as bytes) of every labelled document whose crc32(id) mod 3 is not 1, one row an id.

    Features are taken where the texts are, and only they move.  Rows are dealt to tasks by
    id and sorted in them, so that sums don't depend on the tables' order.  Every pass over
    the rows sends the driver a table a task, so the tasks go by the number of rows, also
    where a session's shuffles have more partitions.
    """
    apart = held_out(id_col, 3, 1)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~apart).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    if max_rows is not None:
        chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    tasks = min(1 + chosen.count() // _TASK_ROWS, _MAX_TASKS)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = text_features(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], [id_col, "_x"])

    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.where(F.col(id_col).isNotNull() & ~apart).select(id_col, text_col)
    measured = map_arrow(texts, measure, f"`{id_col}` {kind}, _x binary").groupBy(id_col).agg(F.min("_x").alias("_x"))
    rows = settled(measured.join(chosen, id_col).repartition(tasks, id_col).sortWithinPartitions(id_col).select("_label", "_x"))
    return rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows


def total_of(rows: DataFrame) -> Total:
    """Totals over a frame of ``labelled_features``: one table from each task, put together in the order of tasks."""

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray], merge: np.ufunc) -> np.ndarray:
        nothing = f(np.zeros((0, N_FEATURES)), np.zeros(0, np.int32)).astype(float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = nothing
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, N_FEATURES)
                out = merge(out, f(x, batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        bound_batches(rows.sparkSession)
        out = nothing
        for (part,) in rows.mapInArrow(run, "part binary").collect():
            out = merge(out, np.frombuffer(part).reshape(nothing.shape))
        return out

    return total


def first_rows(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``_FIRST_ROWS`` rows of a frame of ``labelled_features``, an equal number from each task at most."""
    most = 1 + _FIRST_ROWS // rows.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for batch in batches:
            if left:
                yield batch.slice(0, left)
            left -= min(left, batch.num_rows)

    bound_batches(rows.sparkSession)
    found = rows.mapInArrow(run, rows.schema).collect()
    return np.frombuffer(b"".join(bytes(r._x) for r in found)).reshape(-1, N_FEATURES), np.array([r._label for r in found], np.int32)


def fit_from_first(rows: DataFrame, total: Total, model: QualityModel, n_good: int, n_bad: int) -> np.ndarray:
    """The weights of all rows; the steps begin at those of the first rows, which the driver fits, as each step reads all rows."""
    x, y = first_rows(rows)
    good, bad = int((y > 0).sum()), int((y <= 0).sum())
    start = fit_weights(lambda f, merge: f(x, y), model, good, bad) if good and bad else None
    return fit_weights(total, model, n_good, n_bad, start)


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int | None = None) -> QualityModel:
    """Fit on the labelled rows whose crc32(id) mod 3 is not 1: all of them, or ``max_rows`` by a hash of the id if that is asked for."""
    rows = labelled_features(documents, labels, label_col, id_col, text_col, max_rows)
    total = total_of(rows)
    return fit_rows(total, lambda *given: fit_from_first(rows, total, *given))


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted``."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(text_features(texts_of(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col), F.col(text_col), held_out(id_col, 3, 1).alias("_held_out"))
    return map_arrow(rows, measure, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` scored 0.5 or more, with all their columns."""
    at = documents.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(text_features(texts_of(batch.column(at)))) >= 0.5))

    return map_arrow(documents, keep, documents.schema)
