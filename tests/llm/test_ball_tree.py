import math
import random

import numpy as np
from pyspark.sql import functions as F

from tarnframe.llm.ball_tree import build, search, top_inner_products, upper_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, id string, score long"


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in pairs], SCHEMA)


def brute(pairs, is_query, k):
    usable = [(i, v) for i, v in pairs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in usable]
    out, done = set(), set()
    for i, q in sorted(whole):
        if is_query(i) and i not in done:
            done.add(i)
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    pairs = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    pairs += [(1000 + i, [round(rng.random(), 1)] * 8) for i in range(60)]  # ties
    pairs += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, []), (2500, [0.5, 0.25])]
    df = top_inner_products(frame(spark, pairs), F.col("vec_id") % 100 == 0, rows_per_shard=90, queries_per_block=3)
    assert found(df) == brute(pairs, lambda i: i % 100 == 0, 10)


def test_few_candidates_and_empty_table(spark):
    pairs = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (100, [0.0, 0.0])]
    assert found(top_inner_products(frame(spark, pairs), F.col("vec_id") % 100 == 0)) == brute(pairs, lambda i: i % 100 == 0, 10)
    assert top_inner_products(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def test_products_beyond_floats_are_exact(spark):
    pairs = [(0, [1e6 + 0.5, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.0009765625]), (3, [3e6, 0.0])]
    assert found(top_inner_products(frame(spark, pairs), F.col("vec_id") == 0)) == brute(pairs, lambda i: i == 0, 10)


def test_products_one_apart_beyond_floats(spark):
    # 2^60 + 1, + 3, + 2 and + 2, which are one float
    big = float(1 << 20)
    pairs = [(0, [big, 2**-10]), (1, [big, 2**-10]), (2, [big, 3 * 2**-10]), (3, [big, 2 * 2**-10]), (4, [big, 2 * 2**-10])]
    rows = found(top_inner_products(frame(spark, pairs), F.col("vec_id") == 0, rows_per_shard=2))
    assert rows == brute(pairs, lambda i: i == 0, 10) and {(r, j) for _, r, j, _ in rows} == {(1, 2), (2, 3), (3, 4), (4, 1)}


def test_products_beyond_64_bits_stop_at_the_end(spark):
    pairs = [(0, [1e30, 1.0]), (2, [1e30, 5.0]), (1, [1e30, 3.0]), (3, [-1e30, 0.0])]
    end = (1 << 63) - 1
    assert found(top_inner_products(frame(spark, pairs), F.col("vec_id") == 0)) == {(0, 1, 1, end), (0, 2, 2, end), (0, 3, 3, -end)}


def test_blocks_meet_few_shards(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 6)) * 20
    pairs = [(i, (middles[i % 40] + rng.normal(size=6)).tolist()) for i in range(2000)]
    met = spark.sparkContext.accumulator(0)
    rows = found(top_inner_products(frame(spark, pairs), F.col("vec_id") % 100 == 0, rows_per_shard=40, queries_per_block=2, pairs_met=met))
    assert rows == brute(pairs, lambda i: i % 100 == 0, 10)
    assert 0 < met.value < 0.5 * 10 * 50  # at least 10 blocks and 50 shards


def test_a_floor_prunes_leaves():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(4000, 4)) * 300)
    tree = build(np.arange(4000), rows)
    query = rows[7]
    bounds = upper_bounds(tree.centres, tree.radii, query[None])[0]
    ids, scores, opened = search(tree, 7, query, bounds, 10, -(1 << 63), 1e9)
    again = search(tree, 7, query, bounds, 10, int(scores[-1]), 1e9)
    assert again[0].tolist() == ids.tolist() and again[2] <= opened < (tree.left < 0).sum()
