"""The pipeline's near-duplicate stage against brute force over all pairs."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa

from groundwave.llm import common, pipeline
from groundwave.llm import similar

SCHEMA = "doc_id long, text string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each id's class."""
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def corpus(spark):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):  # a group that only its first text holds together, and pairs on both sides of 0.8
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 6)):
            words[at] = f"x{i}"
        rows.append((10_000 + i, " ".join(words)))
    for i in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(60 + i)]
        rows.append((20_000 + i, " ".join(words)))
        words[rng.randrange(len(words))] = "Y"
        words[rng.randrange(len(words))] = "Z"
        rows.append((30_000 + i, " ".join(words).upper()))
    return rows + [(40_000, " ".join(base)), (40_001, None), (40_002, " \n"), (40_003, "a b"), (40_004, "A b")]


def test_stage_drops_all_near_copies_and_nothing_else(spark):
    rows = corpus(spark)
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"]: r["component"] for r in similar.classes(df).collect()} == want
    kept = pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    for n in (3, 40, 300, 5000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8], rng.integers(-(2**63), 2**63, n // 7))))
        bits = int(np.bitwise_count((similar.sketch(a) ^ similar.sketch(b)).view(np.uint64)).sum())
        apart = len(np.setxor1d(a, b))
        assert bits <= apart and (bits > 0.5 * apart or n > 40)


def test_large_open_groups_by_brute_force(spark):
    """Copies with 0 to 12 changed words of two texts, changed to a word of their own or to one for all: most buckets are large and stay open."""
    rng = random.Random(9)
    rows = []
    for g in range(2):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(140)]
        for i in range(260):
            words = list(base)
            for at in rng.sample(range(140), rng.randrange(13)):
                words[at] = rng.choice(["edited", "changed", f"own{i}"])
            rows.append((1000 * g + i, " ".join(words)))
    want = brute(rows)
    assert {r["id"]: r["component"] for r in similar.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert 50 < len(set(want.values())) < 500


def test_bits_differ_as_the_angle_says():
    rng = np.random.default_rng(3)
    words = 40
    for n, m, both in ((9, 9, 8), (10, 8, 8), (45, 45, 40), (450, 450, 400), (50, 40, 40)):  # all of similarity 0.8
        share = []
        for _ in range(40):
            x = rng.integers(0, 2**64, n + m - both, dtype=np.uint64)
            one, two = (similar.fingerprint(np.sort(y), words) for y in (x[:n], x[n - both :]))
            share.append(np.bitwise_count(one ^ two).sum() / (64 * words))
        assert np.mean(share) < similar.apart(0.8) + 0.01


def test_shards_miss_no_pair_of_the_similarity():
    for n in (100, 10**5, 10**7):
        width, blocks = similar.shape(n)
        assert (1 - (1 - similar.apart(0.8)) ** width) ** blocks <= similar.MISS and n / 2**width <= similar._SHARD


def test_classes_of_a_shard_by_all_pairs():
    rng = np.random.default_rng(4)
    shard = np.sort(rng.integers(0, 40, 2000))
    items = rng.integers(-(2**63), 2**63, (2000, 2))
    near = rng.integers(0, 2000, 600)
    items[near] = items[rng.integers(0, 2000, 600)] ^ (np.int64(1) << rng.integers(0, 63, (600, 2)))
    items[:30] = items[0]
    want = np.arange(2000)
    close = (np.bitwise_count((items[:, None] ^ items[None]).view(np.uint64)).sum(2) <= similar.RADIUS) & (shard[:, None] == shard)
    for _ in range(2000):
        least = np.where(close, want, 2000).min(1)
        if (least == want).all():
            break
        want = least
    got = similar.local_classes(shard, items, similar.RADIUS)
    assert (got == want).all() and (got != np.arange(2000)).any()


def test_shards_cut_by_batches_and_large_ones():
    rng = np.random.default_rng(6)
    size = [1, 3, similar._LARGE + 500, 40, 3 * similar._LARGE, 2]
    shard = np.repeat(np.arange(len(size)), size)
    items = rng.integers(-(2**63), 2**63, (len(shard), 2))
    items[1:4, 0] = items[1, 0]
    items[1:4, 1] = items[1, 1] ^ np.arange(3)
    items[-2:, 1] = items[-1, 1]
    items[-2:, 0] = items[-1, 0] ^ np.arange(2)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[at : at + 700]) for x in (shard, *items.T)], names=["shard", "c0", "c1"]) for at in range(0, len(shard), 700)]
    found = collections.defaultdict(set)
    for batch in similar._buckets(similar.RADIUS)(iter(batches)):
        for r in batch.to_pylist():
            found[r["bucket"]].add((r["c0"], r["c1"]))
    want = [set(map(tuple, items[shard == s].tolist())) for s in (1, 2, 4, 5)]
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))


def test_pairs_come_from_fingerprints(spark, monkeypatch):
    """The stage's candidates are those of SimHash shards and their BK-trees: with a radius below any distance only equal texts meet."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60 + i)]
        rows += [(i, " ".join(words)), (100 + i, " ".join([*words[:-1], "else"])), (200 + i, " ".join(words).upper())]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(pipeline.near_duplicates(spark, df, "").collect()) == 60
    monkeypatch.setattr(similar, "radius", lambda similarity: -1)
    assert len(pipeline.near_duplicates(spark, df, "").collect()) == 120


def test_short_texts_that_one_word_parts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(2000):  # four shingles and five of which four are the same
        words = [f"w{rng.randrange(10**6)}" for _ in range(8)]
        rows += [(i, " ".join(words)), (10_000 + i, " ".join([*words, "end"] if i % 2 else ["start", *words]))]
    rows += [(20_000 + i, f"a b c d e f g h x{i}") for i in range(1200)] + [(None, "a b c d e f g h"), (30_000, "A b c d e f g h")]
    got = {r["id"]: r["component"] for r in similar.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == got[10_000 + i] == i for i in range(2000))
    assert {got[20_000 + i] for i in range(1200)} == {20_000} == {got[30_000], got[None]}


def test_a_large_group_meets_once_and_what_a_stage_writes_goes(spark, monkeypatch, tmp_path):
    """A node is in one row of the tables of pairs to come, in however many shards it meets others; but for the rows and the ids that stay, tables are deleted."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"own{i}", *base[i % 150 + 1 :]])) for i in range(400)]
    counts, write = {}, similar.materialize

    def counted(df, name, *args, **options):
        out = write(df, name, *args, **options)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert [r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [0]
    assert max(counts.values()) <= 400
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["keep", "rows"]


def test_stars_of_a_large_shard_meet_across_batches():
    rng = np.random.default_rng(7)
    n = 3 * similar._LARGE
    items = rng.integers(-(2**63), 2**63, (n, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[at : at + 700]) for x in (np.zeros(n, np.int64), *items.T)], names=["shard", "c0", "c1"]) for at in range(0, n, 700)]
    stars = [r for batch in similar._stars(similar.RADIUS)(iter(batches)) for r in batch.to_pylist()]
    assert {r["a"] for r in stars} == set(similar.codes(items).view(np.int64).tolist()) and len(stars) == n
    assert len({r["b"] for r in stars}) == 1
