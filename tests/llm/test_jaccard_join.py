import random
import re

import numpy as np

from tarnframe.llm import jaccard_join as j
from tarnframe.llm import session
from tarnframe.llm import shingles as shingle_tables

from .conftest import PROSE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))
    links = [0] * len(pairs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], links[i]) for i, (doc, _) in enumerate(pairs))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


def family(rng, base, n, rate, at):
    out = []
    for i in range(n):
        words = [w if rng.random() > rate else "new%d" % rng.randrange(10**6) for w in base]
        out.append((at + i, " ".join(words)))
    return out


def corpus():
    rng = random.Random(8)
    words = PROSE.split()
    base = [[rng.choice(words) + str(rng.randrange(300)) for _ in range(rng.randrange(40, 160))] for _ in range(8)]
    passage = " ".join("shared%d" % i for i in range(60))
    pairs = [p for k, b in enumerate(base) for p in family(rng, b, 14, 0.01 + 0.006 * k, 1000 * k)]
    pairs += [(20_000 + i, " ".join("own%d" % rng.randrange(10**6) for _ in range(25)) + " " + passage) for i in range(30)]
    pairs += [(30_000 + i, pairs[i][1].upper()) for i in range(5)] + [(31_000 + i, pairs[3][1]) for i in range(40)]
    return pairs


def test_equals_brute_force(frame, awkward):
    pairs = corpus() + [(i, t) for i, t in awkward if i is not None]
    assert found(j.near_duplicates(frame(pairs).repartition(6))) == brute(pairs)


def test_small_blocks_and_groups(frame, monkeypatch):
    monkeypatch.setattr(j, "GROUP_SHINGLES", 600)
    pairs = corpus()
    assert found(j.near_duplicates(frame(pairs))) == brute(pairs)


def test_long_lists_in_parts(frame, monkeypatch):
    monkeypatch.setattr(j, "LIST_ROWS", 3)
    monkeypatch.setattr(j, "GROUP_MEMBERS", 5)
    pairs = corpus()
    assert found(j.near_duplicates(frame(pairs).repartition(5))) == brute(pairs)


def test_large_families_that_share_passages(frame, monkeypatch):
    monkeypatch.setattr(j, "GROUP_MEMBERS", 16)
    rng = random.Random(5)
    shared = ["common%d" % i for i in range(70)]
    bases = [["%s%d" % (name, i) for i in range(45)] + shared for name in ("first", "second", "third")]
    pairs = [p for k, base in enumerate(bases) for p in family(rng, base, 50, 0.01, 1000 * k)]
    assert found(j.near_duplicates(frame(pairs).repartition(4))) == brute(pairs)


def test_words_of_two_letters_in_thue_morse_order_differ(frame):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    pairs = [(1, one), (2, other), (3, one.upper()), (4, " ".join(one)), (5, " ".join(other))]
    assert found(j.near_duplicates(frame(pairs))) == brute(pairs)


def kept_by_brute_force(pairs):
    """Texts that stay, with ids: of each component the row with the smallest id (null last), whichever text it has."""
    indexed = [(i, t) for i, (_, t) in enumerate(pairs)]
    groups = {}
    for i, n, component, _ in brute(indexed):
        groups.setdefault(component if n else (i,), []).append(i)
    out = []
    for members in groups.values():
        best = min((pairs[i][0] is None, pairs[i][0] or 0) for i in members)
        out.append((best, {pairs[i] for i in members if (pairs[i][0] is None, pairs[i][0] or 0) == best}))
    return out


def check_kept(docs, pairs):
    kept = j.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    expected = kept_by_brute_force(pairs)
    assert len(rows) == len(expected)
    for _, choice in expected:
        assert sum(rows.count(row) for row in choice) >= 1
    assert sorted(rows, key=repr) == sorted((next(r for r in rows if r in choice) for _, choice in expected), key=repr)


def test_keeps_one_of_each(frame, awkward):
    pairs = corpus() + awkward
    check_kept(frame(pairs), pairs)


def test_repeated_ids_of_different_texts_lose_nothing(frame):
    a, b, c = ("%s " * 30 % tuple(name + str(i) for i in range(30)) for name in "abc")
    pairs = [(3, a), (5, a + "more"), (5, b), (7, c), (7, c), (None, b), (None, a + "x"), (None, "only here it stands"), (5, b), (9, ""), (9, None)]
    check_kept(frame(pairs).repartition(3), pairs)
    ids = sorted((r.doc_id, r.text) for r in j.keep_one_of_each(frame(pairs)).where("doc_id < 9").collect())
    assert ids == [(3, a), (5, b), (7, c)]


def test_empty_and_null_ids(frame):
    assert j.near_duplicates(frame([])).collect() == []
    rows = j.near_duplicates(frame([(None, PROSE), (4, PROSE), (None, "alone here")])).collect()
    assert sorted((r.component_id is None, r.component_id) for r in rows) == [(False, 4), (False, 4), (True, None)]


def test_prefix_lengths_admit_every_link():
    for n in range(1, 400):
        for m in range(n, min(400, n * 4 // 3 + 2)):
            need = j.least_overlap(n, m, 75)
            assert need >= (75 * m + 99) // 100 or 100 * n < 75 * m
            assert n - need + 1 <= j.index_length(n, 75) and (100 * n < 75 * m or m - need + 1 <= j.probe_length(m, 75))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in j.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100}


def test_local_roots():
    assert j.local_roots(6, np.array([1, 2, 5]), np.array([2, 3, 4])).tolist() == [0, 1, 1, 1, 4, 4]


def test_tables_add_up_in_two_levels(spark, monkeypatch):
    def table(batches):
        out = np.zeros(640, np.uint32)
        for batch in batches:
            np.add.at(out, batch.column(0).to_numpy() % 640, 1)
        return out

    numbers = spark.range(0, 50_000, 1, 9)
    expected = np.bincount(np.arange(50_000) % 640)
    for together in (256, 2):
        monkeypatch.setattr(shingle_tables, "PARTS_TOGETHER", together)
        parts = shingle_tables.tables_of(numbers, table)
        assert (shingle_tables.summed_table(parts, lambda x: x, np.uint64) == expected).all()
    for counts in ([0, 1, 254, 255, 256, 70_000], [0], [1] * 9):
        assert shingle_tables.unpacked_counts(shingle_tables.packed_counts(np.array(counts))).tolist() == counts


def test_hot_keys_join_like_others(spark, monkeypatch):
    rng = random.Random(4)
    keys = [7] * 300 + [8] * 120 + [rng.randrange(100, 160) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k long").repartition(5)
    by_key = spark.createDataFrame([(k, keys.count(k), k * k) for k in set(keys)], "k long, size long, v long")
    expected = sorted((k, i, keys.count(k), k * k) for i, k in enumerate(keys))
    for most in (2, 4, 4096):
        monkeypatch.setattr(session, "HOT_KEYS", most)
        assert sorted(tuple(r) for r in session.joined_by_key(rows, by_key, "k", "size", len(keys)).collect()) == expected
    empty = rows.limit(0)
    assert session.joined_by_key(empty, by_key.limit(0), "k", "size", 0).collect() == []


def test_copies_and_components_of_most_rows(frame, monkeypatch):
    monkeypatch.setattr(session, "HOT_KEYS", 4)
    pairs = corpus() + [(40_000 + i, PROSE) for i in range(200)]
    assert found(j.near_duplicates(frame(pairs).repartition(6))) == brute(pairs)
