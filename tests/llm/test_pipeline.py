import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tarnframe.llm import quality_classifier

from .conftest import PROSE, SCHEMA, row
from .test_jaccard_join import brute as brute_join
from .test_quality_rules import brute as brute_rules
from .test_sharding_packing import check_packed


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = [f"{w}{k}" for w in PROSE.split() for k in range(40)]
    texts = []
    for i in range(160):
        picked = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if i % 5 == 0:
            picked = [w + "$$$" for w in picked]
        if i % 7 == 0:
            picked = picked[:6] * 20
        texts.append((i, " ".join(picked)))
    texts += [(200 + i, texts[i][1] + " end") for i in range(20)] + [(300, None), (301, "")]
    folder = str(tmp_path)
    spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(160)], "doc_id long, quality int")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect() if r.score >= 0.5}
    left = [(i, t) for i, t in texts if i in good and brute_rules(t)["kept"]]
    kept = {c for _, _, c, _ in brute_join(left)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in left if i in kept]
    check_packed(corpus_pipeline.run(spark, folder).collect(), lengths, 16, 16_384)
    assert len(kept) > 50


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([row(1, PROSE)], SCHEMA).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_fit_takes_few_tasks_whatever_the_partitions(spark, tmp_path, monkeypatch):
    texts = [(i, PROSE + " " + f"w{i} " * (i % 40) + "$$$ " * (i % 5 == 0)) for i in range(80)]
    spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    deal = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *columns: deal(self, max(n, 24), *columns))
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("fit", "fit")
    corpus_pipeline.classify_quality(spark, docs, str(tmp_path))
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for job in tracker.getJobIdsForGroup("fit") for k in tracker.getJobInfo(job).stageIds}
    tasks = [tracker.getStageInfo(k).numTasks for k in stages if tracker.getStageInfo(k)]
    assert len(tasks) > 10 and sum(n >= 24 for n in tasks) <= 2
