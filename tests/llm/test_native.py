"""PII, chat formatting and sharding against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from groundwave.llm import chat, pii, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

TEXTS = [
    None, "", " ", "a@b.c_d@e.f x@y z@q.", "é mail é.x@mail.example.com, +1 (743) 555-3824 end", "ip 1.2.3.4.5.6.7.8 and 999.1.1.1 01.002.3.255 1.2.3",
    "card 4495114827612972 4495-1148-2761-2972 4495 1148 2761 2973", "+1 4495114827612972", "+12", "++1 2345678901", "a" * 5000 + "@" + "b." * 3000 + "c",
    "1 " * 20000, "1." * 9000, "%+-@-.-.", "x@y.z x@y.z", "𝔘 12 a@b.cd 𝔘 a@b.cd", "tel +1.2.3.4.5.6.7.8.9.0.1", "a@b.c@d.e", "_@a.b\n+1\t23456789012",
]

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for no, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {r["id"]: r["s"] for r in pii.detect(df).select("id", pii.digest(F.col("base")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_base_spans_of_the_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r[0]: r[1:] for r in pii.query(spark, "/root/testdata/sf0.001").select("doc_id", "base_sha256", "n_email").collect()}
    for r in rows.collect():
        want = brute(r["text"])
        assert got[r["doc_id"]] == (hashlib.sha256(want.encode()).hexdigest(), want.count("email:"))


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 {200 + i} 555-01{10 + i} today") for i in range(6)]
    rows += [(100, "so call me at 743-555-3824, ok"), (101, "it was 743-555-3825 then"), (102, "call me at 7pm"), (103, None), (104, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["n"] for r in pii.detect(df, min_confidence=0.7, min_score=0.6).select("id", (F.size("spans") - F.size("base")).alias("n")).collect()}
    assert {k for k, n in got.items() if n} == {100}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df, min_confidence=0.7, min_score=0.6).collect()}
    assert masked[100] == "so call me at [PHONE], ok" and masked[0] == "please call me at [PHONE] today" and masked[103] is None and masked[101] == rows[7][1]
    assert len(masked) == len(rows)


def test_pii_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.detect(df).count() == 0 and pii.mask(df).count() == 0


CONVERSATIONS = [
    (1, 0, "user", "hi \\ <|im_start|> </s> [INST] <<SYS>> [/INST] <s>"), (1, 1, "assistant", "a"), (1, 2, "assistant", ""), (1, 3, "assistant", "b<|im_sep|>c"), (1, 4, "user", None),
    (2, 5, "assistant", "\n<|im_end|>\n\\|"), (2, 1, "system", "é𝔘"), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"),
    (5, 0, "sys\ntem", "hello"), (5, 1, "sys", "tem\nhello"), (5, 2, "\n", "\n"), (5, 3, "a\\\nb\\", "\\"), (5, 4, "<|im_end|>\n", "x"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("first", F.lit(1))
    out = chat.format_conversations(turns).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = {}
    for c, _, role, text in sorted(CONVERSATIONS, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        learnt = [re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]]
        assert learnt == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        plain = r["formatted"].replace(chat.START, "").replace(chat.SEP, "").replace(chat.END, "")
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", plain)
    merged = next(r for r in out if r["conv_id"] == 1)["formatted"]
    assert merged.count(chat.START) == 3 and merged.count(chat.SEP) == 2
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text {i} <s>") for i in range(20_000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    learnt = [re.sub(r"(?s)\\(.)", r"\1", out["formatted"][s["start"] : s["start"] + s["length"]]) for s in out["loss_spans"]]
    assert learnt == [t for *_, role, t in rows if role == "assistant"]


@pytest.mark.parametrize("limit", [1, 50, 400, 10**6])
def test_shards_fit_and_are_shallow(spark, limit):
    rows = [(i % 90, "x" * (i * 7 % 60)) for i in range(300)] + [(500, None), (None, "y"), (7, "z" * 900)] + [(8, "c" * 30)] * 5
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(0)), "doc_id", "text", limit).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    sums = {}
    for r in got:
        sums.setdefault(r["shard"], []).append(r["n_bytes"])
        assert len(r["shard"]) == r["depth"]
    names = list(sums)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for r in got:
        assert (r["shard_bytes"], r["shard_rows"]) == (sum(sums[r["shard"]]), len(sums[r["shard"]]))
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1 or r["depth"] == shards.ALL_BITS
        if r["depth"]:  # the parent would not fit
            parent = [n for k, v in sums.items() if k.startswith(r["shard"][:-1]) for n in v]
            assert sum(parent) > limit


def test_shards_empty_table(spark):
    assert shards.assign(spark.createDataFrame([], SCHEMA), "doc_id", "text", 10).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i % 40, "x" * (i % 9)) for i in range(120)] + [(None, "y"), (None, "y"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards.write(df, "doc_id", "text", 50, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"])) for r in back.collect())
    sizes = {}
    for r in back.collect():
        sizes.setdefault(r["shard"], []).append(len(r["text"] or ""))
    assert len(sizes) > 5 and all(s[0] == "b" for s in sizes)
    shards.write(df.withColumn("shard", F.lit(3)), "doc_id", "text", 10**6, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).select("row.shard").distinct().collect() == [(3,)]
