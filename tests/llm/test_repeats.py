"""Repeated strings against brute force over all strings of the length."""

import collections
import hashlib
import random

import numpy as np
import pytest

from groundwave.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    texts = [(x or "").encode() for _, x in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = collections.Counter()
    for (name, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[(name, len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    return out


def check(spark, rows, length, large=repeats.LARGE):
    got = repeats.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length, large=large).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, length)


def pieces(seed, n):
    """Texts of shared and own pieces, runs of one letter and of periods, copies and near copies."""
    rng = random.Random(seed)
    word = lambda k, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(k))
    shared = [word(rng.randint(5, 90)) for _ in range(6)] + ["x" * 40, "xy" * 30, "abc" * 25]
    texts = ["".join(rng.choice([lambda: word(rng.randint(0, 30)), lambda: rng.choice(shared), lambda: rng.choice(shared)[rng.randint(0, 9) :]])() for _ in range(rng.randint(0, 7))) for _ in range(n)]
    texts += [t for t in texts[: n // 5]] + [t[: len(t) // 2] + "!" + t[len(t) // 2 :] for t in texts[: n // 4]] + [None, "", None]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "length"), [(1, 20), (2, 33), (3, 8)])
def test_equals_brute_force(spark, seed, length):
    check(spark, pieces(seed, 60), length)


def test_short_lengths(spark):
    check(spark, [(1, "aab"), (2, "ba"), (3, "xyz"), (4, "")], 1)


def test_large_groups_are_counted_by_hash(spark):
    check(spark, pieces(5, 60), 24, large=1)


def test_whole_corpus_of_the_production_length(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = "".join(random.Random(7).choices("abcdefghij ", k=60_000))
    rows += [(9001, long), (9002, "1" + long[1000:1399]), (9003, long[2000:2400]), (9004, "=" * 900), (9005, "=" * 399), (None, long[50_000:50_500] + "end")]
    check(spark, rows, repeats.LENGTH)


def test_empty_table(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_samples_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (0, 5, 40, 41, 300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    reach, _, size = repeats.cover(40)
    want = set()
    for t, start in zip(texts, offsets[:-1], strict=True):
        for p in range(len(t) - 39):
            part = np.frombuffer(t[p : p + reach + size - 1], np.uint8)
            want.add(int(start) + p + int(np.argmin(repeats._gram_hashes(part.copy(), size) >> np.uint64(32))))
    got = repeats.samples(data, offsets[:-1], offsets[1:], 40)
    assert set(got.tolist()) == want
    monkey = repeats._SLICE
    repeats._SLICE = 16
    try:
        assert set(repeats.samples(data, offsets[:-1], offsets[1:], 40).tolist()) == want
    finally:
        repeats._SLICE = monkey
