"""The prefix trie against one made of tuples, with awkward rows and small blocks."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from groundwave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """Nodes of the contract, from sets of tuples."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    if rebuild:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - int(math.fmod(c, 5)), [])[: cut[c]] + v[cut[c] :] for c, v in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    saved, leaves, children = collections.Counter(), collections.Counter(), collections.Counter(n[:-1] for n in members if n)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if len(own[c]) == len(n)).encode()).hexdigest()
    return collections.Counter((convs[0], len(n), members[n[:-1]][0] if n else None, len(convs), children[n], leaves[n], saved[n], ends(n)) for n, convs in members.items())


def small(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


AWKWARD = [(None, 0, "user", "x"), (5000, None, None, None), (5000, None, "user", "é"), (5000, 1, "", ""), (5000, 1, "", ""), (5001, 0, "user", "é"), (5003, 7, "b", "c"), (-3, 0, "user", "n"), (-5, 0, "user", "m"), (0, 99, "user", "z" * 100_000)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = small(spark) + AWKWARD + [(6000 + c, t, "user", f"same {t}") for c in range(300) for t in range(12)]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", conv long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = trie.query(spark, str(tmp_path))
    assert dict(got.dtypes)["depth"] == "bigint"
    assert collections.Counter(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_and_chunks_of_any_size(spark, monkeypatch, block):
    rows = [(c, t, "user", str(c * t // 7 % 3)) for c in range(120) for t in range(c % 5)] + [(c, 0, "user", "hot") for c in range(200, 400)]
    monkeypatch.setattr(trie, "CHUNK", 50)
    turns = spark.createDataFrame(rows, SCHEMA)
    got = trie.trie(trie.sequences(trie.whole(trie.turn_keys(turns, "conv_id", "turn", "role", "text"))), block)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute(rows, False)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_sums(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("at"), (F.col("id") * 3 % 11).alias("v"))
    got = {r["at"]: r["sum_v"] for r in trie.prefix_sums(rows, "at", ["v"], 64).collect()}
    total = 0
    for i in range(1000):
        total += i * 3 % 11
        assert got[i] == total
