"""Settings that the operators read from the session."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship

#: Bytes of one Arrow batch at most, roughly; the session's own setting holds if it is smaller.
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Keys that ``joined_by_key`` may broadcast are fewer than these.
HOT_KEYS = 4096

LOCAL_CHECKPOINTS = "/tmp/checkpoints/tarnframe"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session without one gets a folder here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    context.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """The frame's rows computed once and kept in the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    del df
    release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that nothing refers to any more.

    The cleaner acts on collected references; without this they stay on the
    executors' disks until the driver happens to collect garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill the memory of executors and workers.

    The setting is the session's and stays.  The package's code is sent along, as
    executors may lack it.
    """
    ship(spark)
    size = spark.conf.get(_BATCH_SETTING, "64m").lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(size[-1:], 0)
    if not 0 < int(size.rstrip("kmgtp")) << scale <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def joined_by_key(rows: DataFrame, by_key: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows joined to ``by_key``, which has one row a key, and in ``size`` how many of the ``total`` rows have it.

    Keys with more than one in ``HOT_KEYS`` of all rows are fewer than ``HOT_KEYS``: they are
    broadcast, and their rows stay where they are.  All others meet in a shuffle, in which no key has
    more than that share.
    """
    hot = by_key.where(F.col(size) * HOT_KEYS > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    cold = by_key.where(F.col(size) * HOT_KEYS <= total)
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))


def unused_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened where a column (in any case) has them already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``f`` to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
