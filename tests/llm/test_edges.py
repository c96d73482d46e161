"""Every stage and operator over awkward tables: nulls everywhere, repeated rows, one huge text, clashing columns, no rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from groundwave.llm import chat, langid, media, mixing, packing, pii, pipeline, quality, repair, repeats, shards, similar, simhash, trie, warc
from groundwave.llm.common import shared_folder

#: Names the operators use inside themselves, and those of their results.
CLASHES = """id row fp _id _text _copy text_key base spans extra component root node lang_pred score size source_size target times doc
_pii_key _pii_spans _pii_extra hash n_bytes shard depth host key kept bits mask digest media html items position start length _r
conv pos seq audit blank initial copied at x y triple parent n found removed spans_ block sum_leaf""".split()
WORDS = "the cat sat on a mat and saw der hund la casa blanca with some more words to say"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, f"{WORDS} number {i} {'x' * i} mail a{i}@example.org", "en" if i % 2 else "de", f"s{i % 3}", i) for i in range(12)]
    rows += [(20, None, "en", "s0", None), (21, "", None, None, None), (22, " \n\t", "en", "s1", 3), (None, "no id here and a few words", "de", "s1", 1), (None, None, None, None, None)]
    rows += [(23, "same text of copies " * 6, "en", "s2", 9)] * 4 + [(24, "same text of copies " * 6, "en", "s2", 9), (25, "12 34 - !", "en", "s0", 1)]
    rows += [(26, f"{WORDS} 555 " * 2000, "en", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})


def same_extras(out):
    """The rows' clashing columns still hold what they held."""
    return out.where(" or ".join(f"not ({c} <=> concat('{c}', cast(doc_id as string)))" for c in CLASHES)).count() == 0


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_stages_keep_columns_and_rows(spark, awkward, name, stage):
    out = stage(spark, awkward, "")
    assert out.columns == awkward.columns and same_extras(out)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    every = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in awkward.select("doc_id").collect())
    if name == "private_data":
        assert got == every and out.where("text like '%@%'").count() == 0
    elif name == "near_duplicates":
        ids = [i for none, i in got if not none]
        assert len(ids) == len(set(ids)) and 23 in ids and 24 not in ids and 26 in ids
    elif name == "language":
        assert {(False, i) for i in range(12)} <= set(got) and not {(False, 20), (False, 21), (False, 22), (False, 25)} & set(got)
    else:
        assert set(got) <= set(every)
    empty = stage(spark, awkward.limit(0), "")
    assert empty.columns == awkward.columns and empty.count() == 0


def test_last_stage_packs_every_row(spark, awkward):
    out = pipeline.STAGES[-1][1](spark, awkward, "")
    assert out.where("start = 0").count() == awkward.count()
    assert pipeline.STAGES[-1][1](spark, awkward.limit(0), "").count() == 0


@pytest.mark.parametrize("operator", [
    lambda d: pii.detect(d), lambda d: langid.predict(d, langid.fit(d)), lambda d: simhash.classes(d), lambda d: mixing.mix(d), lambda d: quality.judge(d),
    lambda d: shards.assign(d, "doc_id", "text", 4096), lambda d: media.resolve(media.parse(media.pages_of(d, "doc_id", "text"), "id", "html"), media.features(media.store(d, "text"))).where("kind = 'img'"),
    lambda d: packing.pack(d, packing.default_tokenizer()).where("start = 0"), lambda d: repeats.cut_repeats(d, length=50),
], ids=["pii", "langid", "simhash", "mixing", "quality", "shards", "media", "packing", "repeats"])
def test_operators_return_every_row(awkward, operator):
    assert operator(awkward).count() == awkward.count()
    assert operator(awkward.select([F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])).count() == awkward.count()


def test_archives_and_chats_of_awkward_tables(spark, awkward):
    nulls = awkward.select([F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])
    for df in (awkward, nulls, awkward.limit(0)):
        pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[c for c in CLASHES if c not in ("html", "url", "page_id")])
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        out = warc.read_archives(warc.write_archives(pages, folder, archive_bytes=2000), folder)
        assert out.count() == df.count()
        texts = df.select(F.coalesce("text", F.lit(""))).distinct().count()
        assert out.where("record_type = 'response'").count() == texts
        turns = df.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", *[c for c in CLASHES if c not in ("conv_id", "turn", "role")])
        said = chat.format_conversations(turns).withColumn("turns", chat.parse(F.col("formatted")))
        assert said.select(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0] == df.count()
        assert said.count() == df.select("doc_id").distinct().count()


def test_tries_and_repairs_of_awkward_tables(spark, awkward):
    nulls = awkward.select([F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])
    for df in (awkward, nulls, awkward.limit(0)):
        turns = df.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", *[c for c in CLASHES if c not in ("conv_id", "turn", "role", "text")])
        root = trie.prefix_trie(turns).where("depth = 0").collect()
        named = df.where("doc_id is not null").select("doc_id").distinct().count()
        assert [r["n_convs"] for r in root] == ([named] if named else [])
        fixed = repair.repair(turns).collect()
        assert len(fixed) == df.select("doc_id").distinct().count()
        left = repair.repaired_turns(turns).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "role"))), lambda t: F.substring(t["role"], 1, 1)), "").alias("r")).collect()
        assert all(r["r"].removeprefix("s").replace("ua", "") == "" for r in left)


def test_copies_without_an_id_and_texts_under_one_id(spark, awkward):
    for module in (simhash, similar):
        out = module.deduplicate(awkward)
        assert out.columns == awkward.columns and same_extras(out)
        texts = [r["text"] for r in out.select("text").collect()]
        assert len(texts) == len(set(texts)) and sum(not (t or "").split() for t in texts) == 1
        every = {" ".join((r["text"] or "").lower().split()) for r in awkward.select("text").collect()}
        assert {" ".join((t or "").lower().split()) for t in texts} <= every


def test_long_texts_with_many_spans(spark):
    text = "é " + "write to a.b@mail.example.org or +1 743 555 3824 or 10.0.0.1, " * 5000
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.detect(row).select(F.size("base")).first()[0]
    assert found == 15000 and pii.mask(row).first()["text"] == "é " + "write to [EMAIL] or [PHONE] or [IP], " * 5000
