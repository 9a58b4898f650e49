"""Length buckets of least padding, and token-budget batches inside each.

The lengths' global histogram (one row per distinct length, with its count) goes
to the driver; dynamic programming over it finds the bucket boundaries for which
padding every document to its bucket's longest costs least.  It has few rows at
any size of input: m distinct lengths take at least m(m-1)/2 tokens.  Costs are
exact integers, and each bucket more takes one pass over the lengths.

Batches fill a budget of padded tokens: a bucket padded to ``b`` takes
``max(1, budget // b)`` documents a batch.  Rows are numbered inside (bucket,
split) groups, and a split's offset is the sum of the groups before it, so one
bucket with most of the rows is still numbered by many tasks; only the last batch
of each bucket can be short.

``pack`` takes a document's number of words (``[^\\x20\\x09-\\x0D]+``) as its length
and ``n_tokens``; ``pack_tokens`` takes its tokens under a tokenizer; ``pack_lengths``
any column of lengths.  Defined results: null and empty texts have length 0 and share
a bucket as any other length does; a document longer than the budget is a batch by
itself; very long texts are counted whole; repeated rows and ids are packed each for
itself; equal lengths are in one bucket, and of boundaries that cost the same one set
is taken; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import token_counts
from .session import settled

N_BUCKETS = 16
TOKEN_BUDGET = 16_384
ROWS_PER_SPLIT = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def optimal_boundaries(longest: np.ndarray, counts: np.ndarray, n_buckets: int) -> np.ndarray:
    """Which lengths end a bucket, so that ``sum(count * (bucket's longest - length))`` is least.

    ``longest`` ascends.  A bucket over i..j costs longest[j] * (rows[j+1] - rows[i])
    less a constant: for each i a line in longest[j], with slopes that fall as i
    rises, so the least of them moves along their lower hull.
    """
    m = len(longest)
    if m == 0:
        return np.zeros(0, dtype=np.int64)
    n_buckets = min(n_buckets, m)
    x = [int(v) for v in longest]
    rows = [0]
    for c in counts:
        rows.append(rows[-1] + int(c))
    best = [x[j] * rows[j + 1] for j in range(m)]
    choice = np.zeros((n_buckets, m), dtype=np.int64)
    for k in range(1, n_buckets):
        now: list = [None] * m
        hull: list[tuple[int, int, int]] = []  # (slope, height, first length of the bucket)
        at = 0
        for j in range(k, m):
            slope, height = -rows[j], best[j - 1]
            while len(hull) > 1:
                (s1, h1, _), (s2, h2, _) = hull[-2], hull[-1]
                if (height - h1) * (s1 - s2) > (h2 - h1) * (s1 - slope):
                    break
                hull.pop()
            hull.append((slope, height, j))
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x[j] + hull[at + 1][1] <= hull[at][0] * x[j] + hull[at][1]:
                at += 1
            slope, height, choice[k, j] = hull[at]
            now[j] = x[j] * rows[j + 1] + slope * x[j] + height
        best = now
    ends, j = [], m - 1
    for k in range(n_buckets - 1, -1, -1):
        ends.append(j)
        j = int(choice[k, j]) - 1
    return np.array(ends[::-1], dtype=np.int64)


def _first_at_least(value: Column, bounds: list[int]) -> Column:
    """The place of the first bound that isn't below the value; the bounds are few."""
    out = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def pack(documents: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, bucket, padded_tokens, padding, batch, slot; words count as tokens."""
    return pack_lengths(documents.select(F.col(id_col), n_words(F.col(text_col)).alias("n_tokens")), n_buckets, token_budget, id_col)


def pack_tokens(documents: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As ``pack``, with lengths and budget in tokens of the tokenizer file at ``path`` (``token_counts``' own if None)."""
    counted = token_counts.count_tokens(documents, path, id_col=id_col, text_col=text_col)
    return pack_lengths(counted.select(F.col(id_col), "n_tokens"), n_buckets, token_budget, id_col)


def pack_lengths(lengths: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id") -> DataFrame:
    """Pack rows (id, n_tokens)."""
    # a row's place tells rows apart whose ids are equal or null
    lengths = settled(lengths.select(id_col, "n_tokens", F.monotonically_increasing_id().alias("_place")))
    histogram = lengths.groupBy(F.col("n_tokens").alias("longest")).agg(F.count(F.lit(1)).alias("rows")).orderBy("longest").toPandas()
    longest, counts = histogram["longest"].to_numpy(np.int64), histogram["rows"].to_numpy(np.int64)
    bounds = [int(x) for x in longest[optimal_boundaries(longest, counts, n_buckets)]] or [0]
    n_splits = max(1, -(-int(counts.sum()) // ROWS_PER_SPLIT))
    placed = (
        lengths.withColumn("bucket", _first_at_least(F.col("n_tokens"), bounds).cast("int"))
        .withColumn("padded_tokens", F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1).cast("long"))
        .withColumn("_split", F.pmod(F.xxhash64(id_col, "_place"), F.lit(n_splits)))
    )
    sizes = placed.groupBy("bucket", "_split").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("bucket").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_split", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("bucket", "_split").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens", "_place")
    per_batch = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(padded_tokens, 1)"))
    return (
        placed.withColumn("_number", F.row_number().over(order))
        .join(offsets, ["bucket", "_split"])
        .withColumn("_index", F.col("_before") + F.col("_number") - 1)
        .withColumn("_per_batch", per_batch)
        .select(
            id_col,
            "n_tokens",
            "bucket",
            "padded_tokens",
            (F.col("padded_tokens") - F.col("n_tokens")).alias("padding"),
            F.expr("_index div _per_batch").alias("batch"),
            F.expr("_index % _per_batch").alias("slot"),
        )
    )
