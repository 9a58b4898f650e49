"""N-gram Jaccard self-join with rare-first prefix filtering, and its components.

1. A table of fixed size counts all shingles of all documents; by it each set is
   ordered, rare shingles first.  Any order is right; this one keeps shared
   passages out of the prefixes.
2. Equal sets become one class.  Only a class's prefix is posted: two sets with
   Jaccard t or more share a shingle in the longer one's first ``n - ceil(t n) + 1``
   and the shorter one's first ``n - ceil(2t / (1 + t) n) + 1``.
3. Each posting list has a hub, its smallest class; each class takes as its
   neighbourhood the smallest hub of its lists.  Near copies nearly always meet in
   one neighbourhood, so their links are found there and no list is expanded into
   its pairs.  Pairs in a list that lie in different neighbourhoods are formed one
   by one, past the length and positional filters.  Lists of frequent shingles are
   cut into parts, whose hubs meet afterwards, so no list lies in one task.
4. A neighbourhood with more shingles than ``GROUP_SHINGLES`` or more sets than
   ``GROUP_MEMBERS`` is cut into blocks.  Each block, each two blocks of a
   neighbourhood, and each two blocks of two neighbourhoods that such pairs join,
   is a group; every pair of sets can meet in one group only.  First only the sets'
   sizes and counts by hash range meet in a group: those bound every overlap (the
   suffix filter), and sets without a partner within the bounds drop out.  The
   sets that remain are sent once to each of their groups, and joined there by
   prefix index, length, suffix and exact verification, once per pair.
5. Components of the links are contracted by alternating stars.

Rows of one class, classes of one label or component, and edges of one node may be a
large share of all: such keys, of which there can be few only, are joined where their
rows are (``session.joined_by_key``).

Sets are compared through 64-bit hashes of shingles and classes through a 64-bit
fingerprint of the set.

Defined results: null, empty and wordless texts have no shingles, link with
nothing and are their own component; fewer than five words are one shingle;
repeated rows and ids are documents each, rows with equal texts exact copies of
each other; very long texts are read whole; pairs that just tie with the threshold
link; an empty table gives an empty result; extra columns are ignored.  Ids are
integers; a row with a null id gets a component only from others that have one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bound_batches, joined_by_key, settled, unused_names
from .shingles import TABLE_BITS, cells, log_scale, ranked_sets, shingle_hashes, summed_table, table_parts, tables_of
from .textblocks import blocks_of, mix64, texts_of

SHINGLE_WORDS = 5
#: Similarity in percent.
THRESHOLD = 75
#: Shingles that one verification task holds at a time.
GROUP_SHINGLES = 2_000_000
#: Sets of a neighbourhood that one task compares at a time.
GROUP_MEMBERS = 4096
#: Posts of a frequent shingle that one task handles at a time.
LIST_ROWS = 1024
#: A character of a word.
_WORD = r"[^\x20\x09-\x0D]"
_RANGES = 64
_FILTER_BITS = 23
_U64 = np.uint64


def ceil_div(a, b):
    return -(-a // b)


def probe_length(n, t: int):
    """Prefix that a set shows to sets no longer than it."""
    return n - ceil_div(t * n, 100) + 1


def index_length(n, t: int):
    """Prefix that a set shows to sets no shorter than it."""
    return n - ceil_div(2 * t * n, 100 + t) + 1


def least_overlap(a, b, t: int):
    """Shingles that sets of ``a`` and ``b`` must share to be linked."""
    return ceil_div(t * (a + b), 100 + t)


def _block_sets(texts, k: int, rarity: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, sets end to end, edges, class of each row) for each block."""
    for first, last, block in blocks_of(texts):
        docs, hashes = shingle_hashes(block, k)
        sets, edges = ranked_sets(docs, hashes, block.n_docs, rarity)
        total = np.zeros(len(sets) + 1, _U64)
        np.cumsum(mix64(sets), out=total[1:])
        classes = mix64(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(_U64)).view(np.int64)
        yield first, last, sets, edges, classes


def _pieces(sets: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return sets[np.arange(total) - np.repeat(ends - lengths - starts, lengths)], np.concatenate([[0], ends])


class Fresh:
    """Tells which classes a task hasn't met yet; copies in one task are then sent on once."""

    LIMIT = 1_000_000

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def among(self, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
        out = []
        for i, c in zip(rows.tolist(), classes[rows].tolist()):
            if c not in self.seen:
                self.seen.add(c)
                out.append(i)
        return np.array(out, dtype=np.int64)


def list_parts(rarity: np.ndarray) -> np.ndarray:
    """For each byte of the frequency table, the parts that a list of such a shingle is cut into.

    A part holds about ``LIST_ROWS`` posts, or eight times the mean of all cells if
    that is more: beyond, a cell's count says little about a single shingle.
    """
    counts = 2 ** (np.arange(256) / 8) - 1
    mean = float(np.bincount(rarity, minlength=256) @ counts) / max(1, len(rarity))
    return np.maximum(1, np.ceil(counts / max(LIST_ROWS, 8 * mean))).astype(np.int32)


def classes_and_counts(source: DataFrame, k: int) -> DataFrame:
    """Rows (id, mark, n, cls, spread) of all documents (id, text, mark), and among them each partition's shingle counts as (chunk, part).

    ``spread`` counts a set's hashes by 256 ranges, a byte each; 255 means that or more.
    """
    flat = np.zeros(1 << TABLE_BITS, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint16)  # saturating: only the order depends on it
        for batch in batches:
            n, cls, spread, hit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int32)]
            for first, last, sets, edges, classes in _block_sets(texts_of(batch.column(1)), k, flat):
                hit.append(cells(sets).astype(np.int32))
                n.append(np.diff(edges))
                cls.append(classes)
                of_set = np.repeat(np.arange(last - first), np.diff(edges))
                counts = np.bincount(of_set * _SPREAD + (sets >> _U64(56)).astype(np.int64), minlength=(last - first) * _SPREAD)
                packed = np.minimum(counts, 255).astype(np.uint8).tobytes()
                spread += [packed[_SPREAD * i : _SPREAD * (i + 1)] for i in range(last - first)]
            cell, times = np.unique(np.concatenate(hit), return_counts=True)
            table[cell] = np.minimum(table[cell] + times, 0xFFFF)
            n, cls, none = np.concatenate(n), np.concatenate(cls), batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(cls), pa.array(spread, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], _ROW_NAMES)
        chunks, packed = table_parts(table)
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(chunks), pa.binary()), pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], _ROW_NAMES)

    return source.mapInArrow(run, "id long, mark long, n long, cls long, spread binary, chunk int, part binary")


_ROW_NAMES = ["id", "mark", "n", "cls", "spread", "chunk", "part"]
_SPREAD = 256


class Members:
    """Sets of one verification task, as ids of shingles in prefix order."""

    def __init__(self, classes: np.ndarray, sets: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((classes, counts))
        starts = (np.cumsum(counts) - counts)[order]
        self.order, self.n = order, counts[order]
        flat, self.edges = _pieces(sets, starts, self.n)
        distinct, self.flat = np.unique(flat, return_inverse=True)
        self.n_distinct = len(distinct)
        member = np.repeat(np.arange(len(order)), self.n)
        width = _U64(64 - int(_RANGES).bit_length() + 1)
        self.ranges = np.bincount(member * _RANGES + (flat >> width).astype(np.int64), minlength=len(order) * _RANGES).reshape(-1, _RANGES)
        self.member = member


def join_members(m: Members, t: int, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (as places in length order, longer first) with Jaccard t percent or more.

    Only members of one group and of different sides meet; those of side -1 meet all of their group.
    """
    group, side = group[m.order], side[m.order]
    place = np.arange(len(m.flat)) - m.edges[m.member]
    posted = place < index_length(m.n, t)[m.member]
    shingle, owner = m.flat[posted], m.member[posted]
    by = np.argsort(shingle, kind="stable")
    owner, lists = owner[by], np.searchsorted(shingle[by], np.arange(m.n_distinct + 1))
    mark = np.zeros(m.n_distinct, np.int8)
    left, right = [], []
    probe = probe_length(m.n, t)
    for i in range(len(m.n)):
        n, mine = m.n[i], m.flat[m.edges[i] : m.edges[i + 1]]
        shown = mine[: probe[i]]
        found, _ = _pieces(owner, lists[shown], lists[shown + 1] - lists[shown])
        found = np.unique(found[found < i])
        found = found[(100 * m.n[found] >= t * n) & (group[found] == group[i]) & ((side[found] != side[i]) | (side[i] < 0))]
        if not len(found):
            continue
        need = least_overlap(n, m.n[found], t)
        found = found[np.minimum(m.ranges[found], m.ranges[i]).sum(axis=1) >= need]
        if not len(found):
            continue
        mark[mine] = 1
        theirs, edges = _pieces(m.flat, m.edges[found], m.n[found])
        shared = np.add.reduceat(mark[theirs], edges[:-1], dtype=np.int64)
        mark[mine] = 0
        linked = found[100 * shared >= t * (n + m.n[found] - shared)]
        left.append(np.full(len(linked), i))
        right.append(linked)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The component of each of n nodes, as its smallest member."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        now = root.copy()
        np.minimum.at(now, root[left], least)
        np.minimum.at(now, root[right], least)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def _may_link(n: np.ndarray, spread: np.ndarray, side: np.ndarray, t: int) -> np.ndarray:
    """Which sets of a group pass the length and suffix filters with another one, of another side (or any, if it is -1)."""
    order = np.argsort(n, kind="stable")
    n, spread, side = n[order], spread[order], side[order]
    unbounded = (spread == 255).any(axis=1)
    passed = np.zeros(len(n), bool)
    least = np.searchsorted(100 * n, t * n)
    for i in range(len(n)):
        j = np.arange(least[i], i)
        if side[i] >= 0:
            j = j[side[j] != side[i]]
        if len(j):
            most = np.minimum(spread[j], spread[i]).sum(axis=1, dtype=np.int64)
            near = j[(most >= least_overlap(n[i], n[j], t)) | (unbounded[i] & unbounded[j])]
            passed[near] = True
            passed[i] |= len(near) > 0
    out = np.zeros(len(n), bool)
    out[order] = passed
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows that are sorted by their first column, one group at a time."""
    waiting: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if waiting and keys[a] != key:
                yield waiting
                waiting = []
            waiting.append(batch.slice(a, b - a))
            key = keys[a]
    if waiting:
        yield waiting


def _filter_groups(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            table = pa.Table.from_batches(rows).combine_chunks()
            spread = np.frombuffer(b"".join(table.column("spread").to_pylist()), np.uint8).reshape(-1, _SPREAD)
            passed = _may_link(table.column("n").to_numpy(), spread, table.column("side").to_numpy(), t)
            if passed.any():
                yield from table.filter(pa.array(passed)).drop_columns(["n", "spread"]).combine_chunks().to_batches()

    return run


def _verify(rows: list[pa.RecordBatch], t: int) -> pa.RecordBatch:
    """Links among the sets of whole groups: (class, root, links) for each linked class."""
    table = pa.Table.from_batches(rows).combine_chunks()
    group, side, classes, n, size = (table.column(c).to_numpy() for c in ("gkey", "side", "cls", "n", "size"))
    sets = np.frombuffer(b"".join(table.column("shingles").to_pylist()), _U64)
    members = Members(classes, sets, n.astype(np.int64))
    left, right = join_members(members, t, group, side)
    left, right = members.order[left], members.order[right]
    root_row = local_roots(len(n), left, right)
    least = classes.copy()
    np.minimum.at(least, root_row, classes)
    roots = least[root_row]
    links = np.bincount(left, size[right], len(n)) + np.bincount(right, size[left], len(n))
    linked = np.zeros(len(n), bool)
    linked[left] = linked[right] = True
    return pa.RecordBatch.from_arrays([pa.array(classes[linked]), pa.array(roots[linked]), pa.array(links[linked].astype(np.int64))], ["cls", "root", "links"])


def _verify_groups(t: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for rows in _whole_groups(batches):
            waiting += rows
            held += sum(int(batch.column("n").to_numpy().sum()) for batch in rows)
            if held >= limit:
                yield _verify(waiting, t)
                waiting, held = [], 0
        if waiting:
            yield _verify(waiting, t)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the edges, by alternating large and small stars.

    Each round at least halves the distance to the roots on paths; rounds go on
    until no edge changes.
    """
    now = settled(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state, n_edges = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_degree"))
        large = joined_by_key(both, least, "a", "_degree", 2 * n_edges).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settled(large.where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_degree"))
        small = joined_by_key(large, least, "a", "_degree", large.count())
        moved = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(moved.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n_edges = seen, seen[0]


def _in_lists(posts: DataFrame, value: str) -> DataFrame:
    """Posts, once each, with the least and largest ``value`` of their list, as ``_least`` and ``_most``.

    A list that may be long lies in several parts, each a group of its own; the
    parts' results are few, and only they meet.  A class that several tasks have
    posted stands in a list once from here on.
    """
    part = Window.partitionBy("part", "h")
    posts = posts.withColumn("_least", F.min(value).over(part)).withColumn("_most", F.max(value).over(part))
    kept = posts.where("parts > 1 OR _least <> _most").dropDuplicates(["part", "h", "cls"])
    return settled(kept.withColumn("_most", F.when(F.col("parts") > 1, F.col("_most"))))


def _over_parts(posts: DataFrame) -> DataFrame:
    """Posts of ``_in_lists`` with the results of their lists' parts put together; lists with one value only are left out."""
    whole = (
        posts.where("parts > 1")
        .groupBy("h")
        .agg(F.min("_least").alias("least"), F.max("_most").alias("most"), F.max("parts").alias("_n"))
        .where("least <> most")
        .select("h", "least", "most", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"))
    )
    long = posts.where("parts > 1").drop("_least", "_most").join(whole, ["part", "h"])
    short = posts.where("parts = 1").withColumnsRenamed({"_least": "least", "_most": "most"})
    return short.unionByName(long)


def _joined(source: DataFrame, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, n, cls) of all documents, and (cls, root, component_id, n_links) of all classes, for ``source`` (id, text, mark)."""
    spark = source.sparkSession
    bound_batches(spark)
    read = settled(classes_and_counts(source, k))
    rows = read.where("chunk IS NULL").select("id", "mark", "n", "cls")
    table = summed_table(read.where("chunk IS NOT NULL").select("chunk", "part"), log_scale)
    table = table if table is not None else np.zeros(1 << TABLE_BITS, np.uint8)
    rarity, parts_of = spark.sparkContext.broadcast(table), list_parts(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (part, parts, h, cls, n and place) for each shingle in the prefix of each set."""
        fresh = Fresh()
        for batch in batches:
            for _, _, sets, edges, classes in _block_sets(texts_of(batch.column(0)), k, rarity.value):
                counts = np.diff(edges)
                chosen = fresh.among(classes, np.flatnonzero(counts > 0))
                n = counts[chosen]
                shown = probe_length(n, t)
                h, to = _pieces(sets, edges[:-1][chosen], shown)
                place = np.arange(len(h)) - np.repeat(to[:-1], shown)
                cls = np.repeat(classes[chosen], shown)
                parts = parts_of[rarity.value[cells(h)]]
                part = (mix64(cls.view(_U64)) % parts.astype(_U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(parts), pa.array(h.view(np.int64)), pa.array(cls), pa.array(np.repeat(n, shown) << 32 | place)], ["part", "parts", "h", "cls", "at"])

    classes = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    # part and parts are nearly always the same: beside each other, and first, they take next to nothing in a shuffle
    posts = source.select("text").mapInArrow(post, "part int, parts int, h long, cls long, at long")
    shared = _over_parts(_in_lists(posts, "cls")).select("part", "parts", "h", "cls", "at", F.col("least").alias("hub"))
    labels = settled(shared.groupBy("cls").agg(F.min("hub").alias("label"), F.first(F.shiftright("at", 32)).alias("n")))
    sizes = settled(labels.groupBy("label").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_members")))
    labels = settled(
        joined_by_key(labels, sizes, "label", "_members", labels.count())
        .withColumn("blocks", F.greatest(F.ceil(F.col("_total") / GROUP_SHINGLES), F.ceil(F.col("_members") / GROUP_MEMBERS)).cast("long"))
        .select("cls", "label", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("block"), "_members")
    )
    # inside neighbourhoods: each block meets itself (side -1) and each other one (sides 0 and 1)
    first_of = F.least("block", F.col("_other"))
    second_of = F.greatest("block", F.col("_other"))
    inside = (
        labels.where("_members > 1")
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("side", F.when(F.col("block") == F.col("_other"), -1).when(F.col("block") < F.col("_other"), 0).otherwise(1))
        .select("cls", "side", F.xxhash64("label", first_of, second_of).alias("gkey"))
    )
    # between neighbourhoods: pairs in lists that hold more than one
    # labels grow with the input: they are never broadcast, however few they are
    labelled = shared.join(labels.select("cls", "label").hint("merge"), "cls").select("part", "parts", "h", "cls", "at", "label")
    spread = settled(
        _over_parts(_in_lists(labelled, "label"))
        .join(labels.select("cls", "block").hint("merge"), "cls")
        .select("h", "cls", "label", "block", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"))
    )
    x, y = spread.alias("x"), spread.alias("y")
    shorter = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.cls") < F.col("x.cls")))
    most = F.least("x.pos", "y.pos") + 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    y_index = F.expr(f"y.n - cast(ceil({2 * t} * y.n / {100 + t}.0D) as int) + 1")
    # a group is two blocks of two neighbourhoods; the side says which of the two
    first = F.col("xl") < F.col("yl")
    low_block, high_block = F.when(first, F.col("xb")).otherwise(F.col("yb")), F.when(first, F.col("yb")).otherwise(F.col("xb"))
    pairs = (
        x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & shorter & (100 * F.col("y.n") >= t * F.col("x.n")) & (F.col("y.pos") <= y_index) & ((100 + t) * most >= t * (F.col("x.n") + F.col("y.n"))))
        .select(*(F.col(f"{a}.{b}").alias(a + b[0]) for a in "xy" for b in ("cls", "label", "block")))
        .withColumn("gkey", F.xxhash64(F.least("xl", "yl"), low_block, F.greatest("xl", "yl"), high_block, F.lit("between")))
        .withColumn("x_side", F.when(first, 0).otherwise(1))
    )
    ends = F.array(F.struct(F.col("xc").alias("cls"), F.col("x_side").alias("side")), F.struct(F.col("yc").alias("cls"), (1 - F.col("x_side")).alias("side")))
    between = pairs.select("gkey", F.inline(ends)).distinct()
    met = inside.unionByName(between.select("cls", "side", "gkey"))
    # copies are put together before classes are dealt out by their number
    spreads = read.where("n > 0").select("cls", "n", "spread").dropDuplicates(["cls"]).join(labels.hint("merge"), "cls", "left_semi")
    groups = settled(
        met.join(spreads, "cls")
        .select("gkey", "side", "cls", "n", "spread")
        .repartition("gkey")
        .sortWithinPartitions("gkey")
        .mapInArrow(_filter_groups(t), "gkey long, side int, cls long")
    )

    def flags(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(1 << _FILTER_BITS, np.uint32)
        for batch in batches:
            table[batch.column(0).to_numpy().view(_U64) >> _U64(64 - _FILTER_BITS)] = 1
        return table

    bits = summed_table(tables_of(groups.select("cls"), flags), lambda c: c > 0)
    wanted = spark.sparkContext.broadcast(np.packbits(bits if bits is not None else np.zeros(1 << _FILTER_BITS, np.uint8)))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the rows whose class may be in a group: a filter of fixed size, exact after the join."""
        fresh = Fresh()
        for batch in batches:
            for _, _, sets, edges, classes in _block_sets(texts_of(batch.column(0)), k, rarity.value):
                at = (classes.view(_U64) >> _U64(64 - _FILTER_BITS)).astype(np.int64)
                passed = (wanted.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) & (np.diff(edges) > 0)
                chosen = fresh.among(classes, np.flatnonzero(passed))
                packed = [sets[edges[i] : edges[i + 1]].tobytes() for i in chosen.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(classes[chosen]), pa.array(np.diff(edges)[chosen]), pa.array(packed, pa.binary())], ["cls", "n", "shingles"])

    sets = source.select("text").mapInArrow(whole_sets, "cls long, n long, shingles binary").dropDuplicates(["cls"])
    grouped = (
        groups.join(classes.select("cls", "size"), "cls")
        .join(sets, "cls")
        .select("gkey", "side", "cls", "n", "size", "shingles")
        .repartition("gkey")
        .sortWithinPartitions("gkey")
    )
    links = settled(grouped.mapInArrow(_verify_groups(t, GROUP_SHINGLES), "cls long, root long, links long"))
    roots = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    degrees = links.groupBy("cls").agg(F.sum("links").alias("_links"))
    placed = settled(
        classes.join(roots, F.col("cls") == F.col("node"), "left")
        .select("cls", "rep", "size", F.coalesce("root", "cls").alias("root"))
        .join(degrees, "cls", "left")
    )
    smallest = settled(placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_classes")))
    placed = joined_by_key(placed, smallest, "root", "_classes", placed.count())
    return rows, placed.select("cls", "root", "size", "component_id", (F.col("size") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), n_links."""
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("mark"))
    rows, of_class = _joined(source, k, threshold)
    worded = rows.where("n > 0").select("id", "n", "cls")
    filled = joined_by_key(worded, settled(of_class), "cls", "size", worded.count()).select("id", "n", "component_id", "n_links")
    bare = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.unionByName(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id.

    Rows are told apart by their id and a fingerprint of all their columns, so ids may
    repeat: of a component's rows with its smallest id the one with the smallest
    fingerprint stays (rows equal in all columns are one), and rows of other components
    with that id are judged apart.  Rows without an id come after all others.  Texts
    without words link with nothing; all their rows stay.
    """
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    mark = F.xxhash64(*hashed)
    worded = F.coalesce(F.col(text_col).rlike(_WORD), F.lit(False))
    source = documents.where(worded).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))
    rows, of_class = _joined(source, k, threshold)
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    # a class's copies are put together before it meets its component
    of_copies = rows.groupBy("cls").agg(F.min(row).alias("row"))
    chosen = of_copies.join(of_class.select("cls", "root"), "cls").groupBy("root").agg(F.min("row").alias("row"))
    id_key, mark_key = unused_names(documents.columns, "id_key", "mark_key")  # the fingerprint tells a null id from 0
    chosen = chosen.select(F.coalesce("row.id", F.lit(0)).alias(id_key), F.col("row.mark").alias(mark_key))
    marked = documents.where(worded).withColumns({id_key: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), mark_key: mark})
    kept = marked.join(chosen, [id_key, mark_key], "left_semi").dropDuplicates([id_key, mark_key]).drop(id_key, mark_key)
    return kept.select(*(F.col(f"`{c}`") for c in documents.columns)).unionByName(documents.where(~worded))
