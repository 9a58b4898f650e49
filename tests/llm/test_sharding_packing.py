import itertools
import re
import zlib
from collections import Counter

import numpy as np

from tarnframe.llm import packing, registry, sharding, token_counts


def brute_shards(pairs, n):
    rows = sorted(((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), i) for i, t in pairs))
    total, before, slots, out = sum(r[2] for r in rows), 0, [0] * n, []
    for _, _, size, crc, i in rows:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((str(i), size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return sorted(out, key=repr)


def test_shards_equal_brute_force(frame, awkward):
    pairs = awkward + [(50 + i, "w" * (i * 37 % 900)) for i in range(400)] + [(60, "w")] * 3
    found = sharding.balanced_shards(frame(pairs).repartition(5)).collect()
    assert sorted(((str(r.doc_id), *r[1:]) for r in found), key=repr) == brute_shards(pairs, 24)


def test_shards_are_near_equal(frame):
    pairs = [(i, "x" * (i * 31 % 500)) for i in range(3000)]
    rows = sharding.balanced_shards(frame(pairs)).toPandas()
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= 2 * rows["size"].max()
    assert rows.sort_values("doc_id")["shard"].is_monotonic_increasing


def test_empty_table(frame):
    assert sharding.balanced_shards(frame([])).collect() == []
    assert packing.pack(frame([])).collect() == []


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m = int(rng.integers(1, 9))
        longest, counts = np.sort(rng.choice(60, m, replace=False)), rng.integers(1, 20, m)

        def cost(ends):
            return sum(c * (longest[min(e for e in ends if e >= j)] - longest[j]) for j, c in enumerate(counts))

        for k in range(1, 5):
            ends = packing.optimal_boundaries(longest, counts, k)
            best = min(cost([*some, m - 1]) for some in itertools.combinations(range(m - 1), min(k, m) - 1))
            assert ends[-1] == m - 1 and len(ends) == min(k, m) and cost(ends.tolist()) == best


def test_batches(frame, awkward):
    pairs = awkward + [(100 + i, "w " * (i * 13 % 700)) for i in range(900)]
    rows = packing.pack(frame(pairs), n_buckets=6, token_budget=2000).toPandas()
    assert len(rows) == len(pairs)
    words = {}
    for i, t in pairs:
        words.setdefault(i, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    known = rows.dropna(subset=["doc_id"])
    assert all(r.n_tokens in words[r.doc_id] for r in known.itertuples())
    assert (rows.padding == rows.padded_tokens - rows.n_tokens).all() and (rows.padding >= 0).all()
    assert rows.groupby("bucket").padded_tokens.nunique().max() == 1 and rows.bucket.nunique() <= 6
    for (_, _), batch in rows.groupby(["bucket", "batch"]):
        assert sorted(batch.slot) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch.padded_tokens.iloc[0] <= 2000
    full = rows.groupby(["bucket", "batch"]).size().reset_index(name="n")
    for _, of_bucket in full.groupby("bucket"):
        assert (of_bucket.sort_values("batch").n.iloc[:-1] == of_bucket.n.max()).all()


def test_query_packs_tokens(spark, frame, tmp_path):
    texts = {1: "a b c", 2: "", 3: "漢字仮名交じり文" * 300, 4: "Qx9!zz#" * 500, 5: "plain words " * 4000, 6: None}
    frame(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["op7_length_buckets"](spark, str(tmp_path)).collect()
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(list(texts.items()))).collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == counted and counted[3] > 100 and counted[4] > 100
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r.padded_tokens)
    assert all(len(b) == 1 or sum(b) <= packing.TOKEN_BUDGET for b in batches.values())


def least_padding(lengths, n_buckets):
    """The least total padding, by trying every last boundary below each length."""
    counts = sorted(Counter(lengths).items())
    best = {0: 0}
    for _ in range(n_buckets):
        following = dict(best)
        for upto in range(1, len(counts) + 1):
            longest = counts[upto - 1][0]
            for first in range(upto):
                if first in best:
                    cost = best[first] + sum(n * (longest - x) for x, n in counts[first:upto])
                    following[upto] = min(following.get(upto, cost), cost)
        best = following
    return best[len(counts)]


def check_packed(rows, lengths, n_buckets, budget):
    """Whether rows are these (id, length) pairs in buckets of least padding and full batches."""
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == sorted(lengths, key=repr)
    longest = {}
    for r in rows:
        longest[r.bucket] = max(longest.get(r.bucket, 0), r.n_tokens)
    assert all(r.padded_tokens == longest[r.bucket] and r.padding == r.padded_tokens - r.n_tokens for r in rows)
    assert len(longest) <= n_buckets and sum(r.padding for r in rows) == least_padding([n for _, n in lengths], n_buckets)
    for bucket, top in longest.items():
        room = max(1, budget // max(top, 1))
        places = sorted((r.batch, r.slot) for r in rows if r.bucket == bucket)
        assert places == [divmod(i, room) for i in range(len(places))]


def test_packing_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SPLIT", 40)
    rng = np.random.default_rng(5)
    lengths = [(int(i % 300), int(n)) for i, n in enumerate(rng.choice([0, 3, 9, 40, 700, 1025, 1030, 1500, 2600, 2601, 9001, 20_000], 500))]
    lengths += [(None, 5)] * 200 + [(None, 1026), (7, 9000)]
    rows = packing.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens long").repartition(5), 5, 4096)
    check_packed(rows.collect(), lengths, 5, 4096)


def test_long_lengths_are_padded_least(frame):
    # 9001 and 9002 were one class, and no boundary could part them
    rows = packing.pack(frame([(i, "w " * n) for i, n in enumerate([9001] * 5 + [9002])]), n_buckets=2).toPandas()
    assert rows.padding.sum() == 0 and rows.bucket.nunique() == 2


def test_wide_classes_still_pack(frame):
    rows = packing.pack(frame([(i, "w " * n) for i, n in enumerate([1, 5, 1500, 1503, 2600, 9000])]), n_buckets=3).toPandas()
    assert (rows.padding >= 0).all() and rows.padding.sum() <= 2600
