"""The stages of the corpus pipeline; each calls one operator and hands its rows on as Parquet.

Every stage but the last returns the columns of its input, whatever they are named, as it keeps the rows in a struct. In
all of them repeated rows are rows of their own until near_duplicates keeps one, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, packing, pii, similar
from .common import scratch, shared_folder, whole_row

#: A document is rejected if no language is at least this likely; with four languages a guess has 0.25.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, null texts and texts without a letter go. The model learns from the labelled rows
    that are not held out; without any, all documents go. A tie of languages goes to the first by code point."""
    rows = docs.select("doc_id", "text", whole_row(docs).alias("doc"))
    found = langid.predict(rows, langid.fit(docs), keep=("doc",))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id, null
    ids last, and of equal ids the first stored. Null and empty texts are copies of each other. Texts are compared whole."""
    return similar.deduplicate(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; null texts stay null."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null and empty texts go. A null source is a source, the last."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences (see op6_packing); a null text is its end id alone. Other columns than id and text are not read."""
    return packing.summary(packing.pack(docs, packing.default_tokenizer()))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on documents, in order. What stages write for themselves is deleted once their result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
