"""Discovery at the parameters that op1_pii and the pipeline run."""

from pyspark.sql import functions as F

from groundwave.llm import pipeline
from groundwave.llm import pii

SCHEMA = "doc_id long, text string"


def found(df):
    return {r["id"] for r in pii.detect(df).where(F.size("spans") > F.size("base")).select("id").collect()}


def test_a_token_of_another_shape_is_no_evidence(spark):
    rows = [(i, f"please call me at +1 {200 + i} 555-01{10 + i} today") for i in range(6)]
    rows += [(100, "so call me at 743-555-3824, ok"), (101, "it was 743-555-3825 then"), (102, "call me at 7pm"), (103, None), (104, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {100}
    masked = {r["doc_id"]: r["text"] for r in pipeline.private_data(spark, df, "").collect()}
    assert masked[100] == "so call me at [PHONE], ok" and masked[101] == rows[7][1]


def test_one_word_before_and_the_word_after_are_contexts(spark):
    openings = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows = [(i, f"{w} ring +1 {200 + i} 555-01{10 + i} . end") for i, w in enumerate(openings)]
    rows += [(10 + i, f"{w}{w} +1 {300 + i} 555-01{10 + i} evenings") for i, w in enumerate(openings)]
    rows += [(100, "gg ring 743-555-3824 ."), (101, "hh 743-555-3825, evenings"), (102, "hh 743-555-3826. Evenings"), (103, "ii was 743-555-3827 mornings")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {100, 101}


def test_chains_are_followed_to_their_end(spark):
    number = lambda level, i: f"{700 + level}-555-{i:04d}"
    texts = [f"goz onez +1 {number(0, i)} newz" for i in range(625)] + [f"goz onez {number(1, i)} newz" for i in range(125)]
    for level, n in ((2, 25), (3, 5), (4, 1)):
        texts += [f"go{'abcde'[level]} one{'abcde'[level]} {number(level - 1, i)} new{'abcde'[level]}" for i in range(n * 5)]
        texts += [f"go{'abcde'[level]} one{'abcde'[level]} {number(level, i)} new{'abcde'[level]}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert found(df) == set(range(625, len(texts)))
