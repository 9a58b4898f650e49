"""A bounded, reproducible sample of labelled documents for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo ``modulus``, is ``remainder``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, is_held_out: Column, max_rows: int) -> DataFrame:
    """(id, ``_text``, ``_label``) of at most ``max_rows`` labelled documents that aren't held out, chosen by a hash of the id.

    Null labels and ids don't take part; an id labelled twice takes its larger
    label, and an id with several documents the smallest text (null counts as empty),
    so there is one row an id, whatever the tables' order.  The bound makes the
    chosen ids small enough to broadcast.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out)
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_rows)
    )
    texts = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
