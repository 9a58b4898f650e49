"""Contiguous shards of nearly equal bytes, cut from a global prefix sum.

Rows are put in id order by ranges of ids; each range's total gives the bytes
that come before it, and a running sum inside the range does the rest.  A row
goes to the shard in whose equal share of the bytes its middle lies, so a shard
misses its target by less than one row.  Only (id, size, checksum) move, never
texts; the one table that is not distributed is the list of range totals, whose
length is the number of ranges.

The law is ``bytes``.  Defined results: a null text has size 8 and the checksum
of no bytes; rows with a null id come first; rows that agree in every column are
interchangeable; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import settled

N_SHARDS = 24
#: Added to each row's text bytes, for its length field.
ROW_OVERHEAD = 8
#: Rows of one range at most, roughly; ranges are what a task sums.
ROWS_PER_RANGE = 250_000
MIN_RANGES = 32


def sized(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def balanced_shards(documents: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = settled(sized(documents, id_col, text_col))
    n_ranges = max(MIN_RANGES, -(-rows.count() // ROWS_PER_RANGE))
    in_order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = settled(rows.repartitionByRange(n_ranges, *in_order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everywhere).alias("_total"),
    )
    order = Window.partitionBy("_range").orderBy(*in_order)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        placed.withColumn("_upto", F.sum("size").over(running))
        .withColumn("_number", F.row_number().over(order))
        .join(offsets, "_range")
        .withColumn("_twice_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(_twice_middle * {n_shards}) div (2 * _total)")).cast("int"))
        .withColumn("_index", F.col("_rows_before") + F.col("_number") - 1)
        .select(id_col, "size", "text_crc32", "shard", "_index")
    )
    summed = settled(summed)
    firsts = summed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return summed.join(F.broadcast(firsts), "shard").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_index") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

