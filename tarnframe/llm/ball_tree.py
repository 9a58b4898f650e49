"""Exact largest inner products by ball trees, one per shard.

Vectors are dealt to shards of bounded size: by the nearest of a few centres, which
come from a bounded sample, and within a centre's vectors by a hash of the id; each
shard is built into a ball tree and kept packed in one row.  Queries are packed in
blocks of bounded size in the same way.  A search takes nodes in the order of their
inner-product upper bound (centre's product plus radius times the query's norm) and
ends at the first that cannot reach the current k-th score.

That score is shared between shards in rounds.  First each block searches the shard
whose root has the highest bound; then, with the k-th scores found as floor, the
next ``NEXT_SHARDS`` best; then all others whose root's bound reaches the floor of one
of the block's queries.  Blocks and shards that cannot add to a result never meet.

Vectors are quantised to ``floor(1024 * x)``, so products are integers, and scores are
exact ones: from 64-bit floats while every sum stays below 2**53, from 64-bit integers
below 2**63, from Python integers beyond, where a score outside the 64-bit range counts
as the range's end.  Ties go to the smaller id.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as do null ids; of queries with one id the first by its components
counts; a query never finds rows with its own id; other repeated rows each count;
vectors of unequal length are compared as if zeros followed the shorter, and very long
ones whole; with fewer than k candidates all are returned; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import bound_batches, settled

SCALE = 1024
ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 512
LEAF_ROWS = 64
#: Vectors from which the centres come, and centres at most.
SAMPLE_ROWS = 8192
MAX_CENTRES = 256
#: Shards that a block searches in the second round.
NEXT_SHARDS = 4
#: Roots that meet a block at a time.
ROOTS_PER_CHUNK = 4096
_EXACT = float(1 << 53)
_LARGEST = (1 << 63) - 1
_NO_FLOOR = -(1 << 63)


@dataclass
class BallTree:
    """Rows in leaf order; node i covers ``rows[first[i]:last[i]]``, its children are ``left[i]`` and ``left[i] + 1``."""

    ids: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
    """Split at the median along the direction between two far rows until leaves are small."""
    order = np.lexsort((ids,))
    spans, left, centres, radii = [(0, len(ids))], [], [], []
    at = 0
    while at < len(spans):
        first, last = spans[at]
        mine = order[first:last]
        points = rows[mine]
        centre = points.mean(axis=0)
        away = np.sqrt(np.square(points - centre).sum(axis=1))
        centres.append(centre)
        radii.append(away.max())
        if last - first <= leaf_rows or not radii[-1] > 0:
            left.append(-1)
        else:
            one = points[np.argmax(away)]
            other = points[np.argmax(np.square(points - one).sum(axis=1))]
            middle = (last - first) // 2
            order[first:last] = mine[np.argpartition(points @ (other - one), middle)]
            left.append(len(spans))
            spans += [(first, first + middle), (first + middle, last)]
        at += 1
    spans = np.array(spans)
    return BallTree(ids[order], rows[order], spans[:, 0], spans[:, 1], np.array(left), np.array(centres), np.array(radii))


def upper_bounds(centres: np.ndarray, radii: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query and node, what no row of the node can exceed, rounding included."""
    norms = np.sqrt(np.square(queries).sum(axis=1))[:, None]
    reach = norms * radii
    slack = 1e-9 * (norms * np.sqrt(np.square(centres).sum(axis=1)) + reach) + 1e-3
    return queries @ centres.T + reach + slack


def products_of(rows: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Inner products as 64-bit integers; no sum of absolute products exceeds ``largest``."""
    if largest < _EXACT:
        return (rows @ query).astype(np.int64)
    if largest < float(1 << 62):
        return rows.astype(np.int64) @ query.astype(np.int64)
    whole = [int(x) for x in query]
    return np.array([max(-_LARGEST, min(_LARGEST, sum(int(a) * b for a, b in zip(row, whole)))) for row in rows], np.int64)


def search(tree: BallTree, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int, largest: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (ids, scores) of the tree that reach ``floor``, and how many leaves were opened."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    queue, opened = [(-bounds[0], 0)], 0
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < floor:
            break
        child = tree.left[node]
        if child >= 0:
            for c in (child, child + 1):
                heapq.heappush(queue, (max(bound, -bounds[c]), int(c)))
            continue
        opened += 1
        span = slice(tree.first[node], tree.last[node])
        found = products_of(tree.rows[span], query, largest)
        good = (found >= floor) & (tree.ids[span] != query_id)
        if good.any():
            ids, scores = np.concatenate([ids, tree.ids[span][good]]), np.concatenate([scores, found[good]])
            best = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, at the range's ends too
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
    return ids, scores, opened


def centres_of(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """About n centres of the sample's rows, by Lloyd's rounds from its first rows."""
    centres = sample[:n].copy()
    for _ in range(rounds):
        of = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        held = np.bincount(of, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    if not len(centres):
        return np.zeros(len(rows), np.int64)
    return np.argmin(np.square(centres).sum(axis=1) - 2 * (rows @ centres.T), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Quantised rows; shorter ones are filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), max(width, 1)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(SCALE * flat)
    return out


def _widen(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _fit(rows: np.ndarray, width: int) -> np.ndarray:
    return _widen(rows, width)[:, :width]


def _dealt(rows: DataFrame, per_part: int, seed: int, name: str) -> DataFrame:
    """Add the number of the part that a row is in: its centre's rows, split by a hash of the id."""
    counts = {r["centre"]: r["count"] for r in rows.groupBy("centre").count().collect()}
    pieces = [-(-counts.get(c, 0) // per_part) for c in range(max(counts, default=0) + 1)]
    firsts = [sum(pieces[:c]) for c in range(len(pieces))]
    piece = F.element_at(F.array(*map(F.lit, [max(1, p) for p in pieces])), F.col("centre") + 1)
    first = F.element_at(F.array(*map(F.lit, firsts)), F.col("centre") + 1)
    return rows.withColumn(name, (first + F.pmod(F.xxhash64("id", F.lit(seed)), piece)).cast("int"))


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_shard: int = ROWS_PER_SHARD,
    queries_per_block: int = QUERIES_PER_BLOCK,
    pairs_met: Accumulator | None = None,
) -> DataFrame:
    """For each query row, its k largest integer inner products: query_id, rank, vec_id, score.

    ``pairs_met`` counts the pairs of a block and a shard that are searched.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    usable = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    n_rows = usable.count()
    picked = usable.orderBy(F.xxhash64("id", F.lit(2)), "id", "v").select("v").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    sample = _matrix(picked.chunk(0) if isinstance(picked, pa.ChunkedArray) else picked)
    centres = centres_of(sample, min(MAX_CENTRES, -(-n_rows // rows_per_shard)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = nearest(_fit(_matrix(batch.column(1)), centres.shape[1]), centres) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32))], ["id", "v", "q", "centre"])

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tree = build(table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks()))
        return pa.table([table.column("shard")[:1], pa.array([pickle.dumps(tree)], pa.binary()), pa.array([pickle.dumps((tree.centres[0], tree.radii[0]))], pa.binary())], ["shard", "tree", "root"])

    def pack_chunk(table: pa.Table) -> pa.Table:
        roots = [pickle.loads(x) for x in table.column("root").to_pylist()]
        width = max(len(c) for c, _ in roots)
        packed = pickle.dumps((table.column("shard").to_numpy(), np.array([np.pad(c, (0, width - len(c))) for c, _ in roots]), np.array([r for _, r in roots])))
        return pa.table([table.column("chunk")[:1], pa.array([packed], pa.binary())], ["chunk", "roots"])

    def pack_block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        floors = table.column("floor").to_numpy(zero_copy_only=False)
        packed = pickle.dumps((table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks()), floors))
        return pa.table([table.column("block")[:1], pa.array([packed], pa.binary())], ["block", "queries"])

    def reach(most: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs of a block and a shard with a bound that reaches the floor of a query; of each chunk the ``most`` highest."""
            for batch in batches:
                for block, packed_queries, packed_roots in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    (_, queries, floors), (shards, centres, radii) = pickle.loads(packed_queries), pickle.loads(packed_roots)
                    width = max(centres.shape[1], queries.shape[1])
                    bounds = upper_bounds(_widen(centres, width), radii, _widen(queries, width))
                    open_ = (bounds >= floors[:, None]).any(axis=0)
                    highest = bounds.max(axis=0)
                    order = np.lexsort((shards, -highest))
                    order = order[open_[order]][:most]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), block), pa.int32()), pa.array(shards[order], pa.int32()), pa.array(highest[order])], ["block", "shard", "bound"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_tree, packed_queries in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                if pairs_met is not None:
                    pairs_met.add(1)
                tree, (ids, queries, floors) = pickle.loads(packed_tree), pickle.loads(packed_queries)
                width = max(tree.rows.shape[1], queries.shape[1])
                tree.rows, tree.centres, queries = _widen(tree.rows, width), _widen(tree.centres, width), _widen(queries, width)
                largest = float(np.abs(tree.rows).max()) * float(np.abs(queries).max()) * width
                bounds = upper_bounds(tree.centres, tree.radii, queries)
                found = [search(tree, i, q, b, k, int(f), largest)[:2] for i, q, b, f in zip(ids, queries, bounds, floors)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                    ["query_id", "vec_id", "score"],
                )

    dealt = settled(usable.mapInArrow(assign, "id long, v array<double>, q boolean, centre int"))
    trees = settled(_dealt(dealt, rows_per_shard, 0, "shard").select("shard", "id", "v").groupBy("shard").applyInArrow(pack_shard, "shard int, tree binary, root binary"))
    roots = settled(trees.select("shard", F.expr(f"shard div {ROOTS_PER_CHUNK}").cast("int").alias("chunk"), "root").groupBy("chunk").applyInArrow(pack_chunk, "chunk int, roots binary"))
    trees = trees.select("shard", "tree")
    n_chunks = roots.count()
    queries = dealt.where("q").groupBy("id").agg(F.min(F.struct("v", "centre")).alias("x")).select("id", "x.v", "x.centre")
    queries = _dealt(queries, queries_per_block, 1, "block").select("id", "v", "block")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    met = spark.createDataFrame([], "block int, shard int")
    for most in (1, NEXT_SHARDS, None):
        kth = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        floored = queries.join(kth, "id", "left").select("id", "v", "block", F.coalesce("kth", F.lit(_NO_FLOOR)).alias("floor"))
        blocks = settled(floored.groupBy("block").applyInArrow(pack_block, "block int, queries binary"))
        chunked = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_chunks - 1))))).join(roots, "chunk").select("block", "queries", "roots")
        # a chunk gives as many as the round takes, and as many as were taken before
        pairs = chunked.mapInArrow(reach(None if most is None else most + NEXT_SHARDS), "block int, shard int, bound double").join(met, ["block", "shard"], "left_anti")
        if most is not None:
            highest = Window.partitionBy("block").orderBy(F.col("bound").desc(), "shard")
            pairs = pairs.withColumn("_n", F.row_number().over(highest)).where(F.col("_n") <= most)
        pairs = settled(pairs.select("block", "shard"))
        found = pairs.join(blocks, "block").join(trees, "shard").select("tree", "queries").mapInArrow(run, "query_id long, vec_id long, score long")
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = settled(ranked)
        met = met.unionByName(pairs)
        if most is not None:
            best = best.drop("rank")
    return best.select("query_id", "rank", "vec_id", "score")
