import random
import zlib

import numpy as np
import pyarrow as pa

from tarnframe.llm import quality_classifier as q

from .conftest import PROSE


def corpus(n=240):
    rng = random.Random(5)
    words, out = PROSE.split(), []
    for i in range(n):
        picked = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        good = i % 4 > 0
        out.append((i, " ".join(picked) if good else " ".join(w + "###" for w in picked), int(good)))
    return out


def test_held_out_rows_are_ranked(spark, frame):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = frame([(i, t) for i, t, _ in rows])
    model = q.train(docs, labels)
    scored = {r.doc_id: r for r in q.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    held = [(scored[i].predicted, y) for i, _, y in rows if scored[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert {r.doc_id for r in q.keep_good(docs, model).collect()} == {i for i, r in scored.items() if r.score >= 0.5}


def test_awkward_rows_and_no_labels(spark, frame, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = q.train(frame(awkward), labels)
    rows = q.score(frame(awkward), model).collect()
    assert len(rows) == len(awkward) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert q.score(frame([]), model).collect() == []


def test_null_and_repeated_labels(spark, frame):
    rows = corpus(120)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = frame([(i, t) for i, t, _ in rows] + [(5, None), (None, "x")])
    assert len(q.score(docs, q.train(docs, labels)).collect()) == 122


def test_bound_on_rows(spark, frame):
    rows = corpus(120)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = frame([(i, t) for i, t, _ in rows])
    a = q.train(docs, labels, max_rows=40)
    b = q.train(docs.repartition(5), labels, max_rows=40)
    assert (a.weights == b.weights).all() and a.cut == b.cut


def test_fit_equals_plain_descent():
    rng = np.random.default_rng(4)
    truth = rng.normal(size=5)
    x = rng.normal(size=(800, 5))
    x = np.where((x @ truth + rng.logistic(size=800) > 0)[:, None], x, -x)
    w = np.zeros(5)
    for _ in range(4000):
        beaten = 1 / (1 + np.exp(x @ w))
        w -= 0.5 * (q._RIDGE * w - (x * beaten[:, None]).mean(axis=0))
    assert np.abs(q.fit_pairs(x) - w).max() < 1e-4


def test_the_cut_is_the_share_of_bad_rows():
    rng = np.random.default_rng(6)
    labels = (rng.random(400) < 0.7).astype(int)
    features = rng.normal(size=(400, q.N_FEATURES)) + labels[:, None]
    model = q.fit_bradley_terry(features, labels, 5000)
    strengths = model.strengths(features)
    assert abs((strengths < model.cut).mean() - (labels == 0).mean()) < 0.01
    assert ((model.scores(features) >= 0.5) == (strengths >= model.cut)).all()


def test_repeated_ids_stay_within_the_bound(spark, frame):
    rows = [(i % 3, PROSE + " " + "word " * (i % 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    one, other = q.train(frame(rows), labels), q.train(frame(rows).repartition(5), labels)
    assert np.allclose(one.weights, other.weights) and one.cut == other.cut


def test_all_pairs_are_fitted():
    rng = np.random.default_rng(8)
    for n, gap in ((150, 1.0), (300, 3.0)):
        labels = (rng.random(n) < 0.7).astype(int)
        features = rng.normal(size=(n, q.N_FEATURES)) + gap * labels[:, None] * (rng.random(q.N_FEATURES) < 0.2)
        model = q.fit_bradley_terry(features, labels)
        z = model.expanded(features)
        pairs = (z[labels > 0][:, None] - z[labels == 0]).reshape(-1, z.shape[1])
        assert np.allclose(model.weights, q.fit_pairs(pairs, rounds=100), atol=1e-5)
        assert np.isclose(model.cut, np.quantile(model.strengths(features), (labels == 0).mean()), rtol=1e-12)


def test_every_labelled_row_is_fitted(spark):
    docs = spark.range(31_000).selectExpr("id AS doc_id", "concat(repeat(concat('w', id % 97, ' '), cast(1 + id % 9 as int)), if(id % 5 = 0, '###', 'End.')) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 > 0 OR doc_id % 1001 = 0 AS int) AS quality")
    model = q.train(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert len(rows) > 20_000
    features = q.text_features(q.texts_of(pa.array([r.text for r in rows])))
    whole = q.fit_bradley_terry(features, np.array([r.quality for r in rows]))
    assert np.allclose(model.centre, features.mean(axis=0)) and np.allclose(model.scale, features.std(axis=0) + 1e-6)
    assert np.allclose(model.weights, whole.weights, atol=1e-6) and np.isclose(model.cut, whole.cut, atol=1e-6)


def test_the_nth_strength():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=50), np.full(30, 0.25), -rng.random(20) * 1e-300, [0.0, 1e300]])[:, None]
    model = q.QualityModel(np.zeros(1), np.ones(1), np.array([1.0, 0.0]))
    values = np.sort(model.strengths(x))
    assert [q.nth_strength(lambda f, merge: f(x, x), model, n) for n in range(len(x))] == values.tolist()


def test_tasks_go_by_rows_not_by_partitions(spark, frame, monkeypatch):
    rows = corpus(120)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = frame([(i, t) for i, t, _ in rows])
    one = q.train(docs, labels)
    deal = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *columns: deal(self, max(n, 40), *columns))
    features = q.labelled_features(docs, labels, "quality", "doc_id", "text", None)
    seen = q.total_of(features)(lambda x, y: np.array([len(y), not len(y)]), np.add)
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    assert seen[1] == 1 + 1  # no rows yet: once in the driver and once in each task
    assert np.allclose(q.train(docs, labels).weights, one.weights, atol=1e-6)


def test_few_passes_over_all_rows(spark, frame, monkeypatch):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs, passes, total_of = frame([(i, t) for i, t, _ in rows]), [], q.total_of

    def counting(features):
        total = total_of(features)
        return lambda f, merge: passes.append(f) or total(f, merge)

    monkeypatch.setattr(q, "total_of", counting)
    q.train(docs, labels)
    assert len(passes) <= 30


def test_the_start_does_not_decide_the_weights(spark, frame, monkeypatch):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = frame([(i, t) for i, t, _ in rows])
    whole = q.train(docs, labels)
    monkeypatch.setattr(q, "_FIRST_ROWS", 30)
    part = q.train(docs, labels)
    assert np.allclose(part.weights, whole.weights, atol=1e-6) and np.isclose(part.cut, whole.cut, atol=1e-6)
