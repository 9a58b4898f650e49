"""From raw documents to packed training batches.

The stages run in order, each on all that its predecessor kept; what a stage
returns is written as Parquet and read again.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnframe.llm import jaccard_join, packing, quality_classifier, quality_rules
from tarnframe.llm.session import documents_of, ensure_checkpoint_dir


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the Bradley-Terry classifier scores 0.5 or more.

    Empty and null texts are scored as texts without words, very long ones whole; a
    score that ties with the cut stays; repeated rows and ids are each judged by their
    text; without labels of both kinds all stay; an empty table stays empty.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rule and the repetition limits.

    Null and empty texts fail (fewer than 50 words); very long texts are read whole; a
    share that ties with its limit passes; repeated rows are each judged; an empty table
    stays empty.
    """
    return quality_rules.keep_unrepetitive(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates.

    Documents of other groups stay, also if their id repeats; ids that are null come
    last; null, empty and wordless texts are in no group and stay; very long texts are
    compared whole; pairs that tie with the threshold link; an empty table stays empty.
    """
    return jaccard_join.keep_one_of_each(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign each document its length in tokens of byte_bpe_50k, its length bucket, batch and slot.

    Null and empty texts have length 0; a document longer than the budget is a batch by
    itself; repeated rows and ids are each packed; equal lengths share a bucket; an empty
    table stays empty.
    """
    return packing.pack_tokens(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack_batches),
]

#: A trained classifier isn't SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; their tables are in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline-{uuid.uuid4()}"
    docs = documents_of(spark, sf_dir)
    path = None
    for k, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a table that no later stage reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
