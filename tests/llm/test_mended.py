"""Texts and conversations of sizes and kinds that once crashed, took square time or lost content."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwave.llm import chat, langid, media, mixing, packing


@pytest.mark.parametrize(("lengths", "counts", "budget"), [
    ([200_000], [5_000], 2_500 * 200_000 + 150_000), ([200_000], [5_000], 2_500 * 200_000 + 50_000), ([140_000, 400_000], [3_000, 3_000], 700_123_456),
    ([1, 200_000], [100_000, 5_000], 400_150_000), (list(range(150_000, 250_000, 37)), [3] * 2703, 600_000_007), ([131_073], [40_000], 1_000_000_000),
])
def test_many_long_texts_are_fitted(lengths, counts, budget):
    lengths, counts = np.array(lengths), np.array(counts)
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    off = abs(int((take * lengths).sum()) - budget)
    assert off <= (lengths.max() / 2 if len(lengths) < 3 else 100)


def test_what_a_long_text_has_too_much_is_given_back():
    lengths, counts = np.array([700, 900, 1_000_000]), np.array([3_000, 3_000, 40])
    for budget in (10_400_000, 22_222_222, 39_999_999):
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= 100


def test_equal_rows_of_one_id_are_ranked_in_parts(spark):
    rows = spark.range(6_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("d e f").alias("text"), F.lit("t").alias("source")))
    rows = rows.unionByName(spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("g h").alias("text"), F.lit("u").alias("source")))
    out = mixing.mix(rows.repartition(4))
    assert out.count() == 9_100
    for r in out.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 3


def spoken(spark, tmp_path, name, turns):
    path = str(tmp_path / name)
    rows = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.lit("é"), (F.col("id") % 7).cast("string")), 120).alias("text"))
    rows.write.parquet(f"{path}/conversations.parquet")
    began = time.time()
    got = {r["conv_id"]: r for r in chat.query(spark, path).collect()}
    assert got[1]["n_turns"] == turns and got[1]["loss_chars"] == turns // 2 * 240
    return time.time() - began


def test_time_of_a_long_conversation(spark, tmp_path):
    spoken(spark, tmp_path, "warm", 100)
    small = spoken(spark, tmp_path, "small", 2_000)
    assert spoken(spark, tmp_path, "large", 16_000) < small + 5


def test_masked_texts_are_those_of_the_spans(spark):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 3 else "user", "x" * (i % 5) + "[INST]é" * (i % 4)) for i in range(40)] + [(2, 0, "user", "no answer"), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns).withColumn("cut", F.transform("loss_spans", lambda s: F.substring("formatted", s["start"] + 1, s["length"]))).withColumn("masked", chat.masked_texts(F.col("formatted"), F.col("loss_spans")))
    rows = out.collect()
    assert len(rows) == 3 and all(r["cut"] == r["masked"] for r in rows) and sum(len(r["masked"]) for r in rows) == 27


@pytest.mark.parametrize("text", ["İ" * 300_000, ("İb" * 140_000) + "C" * 9, "ΑΣ " * 100_000])
def test_texts_whose_lower_case_is_longer_are_scored_whole(text):
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    want = {n: np.bincount(h, minlength=256) for n, h in langid._grams(codes, 256)}
    for order in langid.ORDERS:
        got = np.zeros(256, np.int64)
        for part, more in langid._slices(text):
            for n, h in langid._grams(part, 256):
                if n == order:
                    got += np.bincount(h[: langid._SLICE] if more else h, minlength=256)
        assert (got == want[order]).all()
    rng = np.random.default_rng(3)
    logp, prior = rng.normal(size=(256, 2)).astype(np.float32), np.zeros(2)
    total = sum((want[n][:, None] * logp).sum(0) for n in langid.ORDERS)
    assert langid.score_batch([text, "x"], logp, prior)[0][0] == total.argmax()


def test_shards_of_empty_texts_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array([None, ""] * 5_000, pa.string())], names=["doc_id", "text"])
    sizes = [t.num_rows for t in packing.shards((batch for _ in range(200)), packing.SHARD_BYTES)]
    assert sum(sizes) == 2_000_000 and max(sizes) <= packing.SHARD_BYTES // packing.ROW_BYTES + 1


def test_pages_lose_no_content():
    items = lambda page: [(x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse_page(page)]
    text = lambda *words: [("text", w, None, None) for w in words]
    assert items("<template>a<p>b text") == text("a", "b text")
    assert items("<template><title>x</template>lost?") == text("lost?")
    assert items("<template>gone</template>kept") == text("kept")
    assert items("<script>a = '<p>'</script>kept<style>p {}</style>") == text("kept")
    assert items("<title>open<p>body text") == text("open", "body text")
    assert items("<script>x<template>y<p>z") == text("xy", "z")
    assert items("<template>" * 2_000 + "end") == text("end")
    assert items('<video><source src="sha256:9"><source src="sha256:8"></video><source src=z>') == [("video", None, "9", None)]
    assert items('<audio src="sha256:1"><source src="sha256:2"></audio>') == [("audio", None, "1", None)]
    assert items("<figure><figcaption>A<figure><img src=q>") == [("img", None, "q", "A")]
    assert items("<figure><img src=a><figcaption>A<figure><img src=b><figcaption>B") == [("img", None, "a", "A"), ("img", None, "b", "B")]
    assert items("<figure><figure><img src=a></figure><figure><img src=b><figcaption>own</figcaption></figure><figcaption>both</figcaption></figure>") == [("img", None, "a", "both"), ("img", None, "b", "own")]
    assert items("a<hr>b<pre>c</pre><dl><dt>d<dd>e</dl><select><option>f<option>g</select>") == text(*"abcdefg")


def test_ascii_words_are_encoded_by_pieces():
    import random

    encoder, rng = packing.WordEncoder(packing.default_tokenizer()), random.Random(5)
    letters = [chr(c) for c in range(1, 128) if not chr(c).isspace() or c in (28, 29, 30, 31)]
    words = ["".join(rng.choice(letters if rng.random() < 0.5 else "aB'sTreVmlLd019.,-_") for _ in range(rng.randint(1, 14))) for _ in range(5_000)]
    assert all(encoder.word(w) == encoder.whole(w) for w in words if "<|" not in w)
