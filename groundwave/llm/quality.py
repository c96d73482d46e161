"""Quality rules judged by host.

Every document is measured in tasks (Arrow and numpy). A rule failure is a document with too few
words or with too many words inside repeated 8-word windows. Failures are summed by host; a host's
rate is shrunk towards the corpus rate by a beta prior fitted to the hosts by moments; documents of
hosts whose shrunk rate is over the limit are not kept.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows
count each; with one host or none the prior is as strong as it may be; an empty table gives an empty
table. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, unsliced

WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 20, 30, 0.5
_PRIOR_MIN, _PRIOR_MAX = 1.0, 1e6
_SLICE_BYTES = 4 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of every text."""
    texts = unsliced(texts)
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    doc = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    words, doc = flat.filter(pa.array(full)), doc[full]
    n_words = np.bincount(doc, minlength=n)
    chars = np.bincount(doc, pc.utf8_length(words).to_numpy(zero_copy_only=False), n).astype(np.int64)
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    # numbers of windows of 1, 2, 4, 8 words: each from two of half the length
    gram, kinds = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words)
    size = 1
    while size < WINDOW_WORDS and len(gram) > size:
        gram, kinds = _dense(gram[:-size] * (kinds + 1) + gram[size:])
        size *= 2
    repeated = np.zeros(n, np.int64)
    if size == WINDOW_WORDS and len(gram):
        start = doc[: len(gram)]
        inside = start == doc[WINDOW_WORDS - 1 :]
        key, found = _dense(start[inside] * (kinds + 1) + gram[inside])
        twice = np.flatnonzero(inside)[np.bincount(key, minlength=found)[key] > 1]
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW_WORDS, -1)
        repeated = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten()
    owner = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    said = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(line)), 0).to_numpy(zero_copy_only=False)
    line, owner = line.filter(pa.array(said)), owner[said]
    code = line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.bincount(np.unique(owner * (len(line) + 1) + code) // (len(line) + 1), minlength=n)
    dup = np.bincount(owner, minlength=n) - distinct
    return dict(zip(MEASURES, (n_words, chars, symbols, dup, repeated), strict=True))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, measures, base_failed), as a written table."""

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES)))
                part = batch.slice(at, to - at)
                found = measure(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(found[m]).cast(pa.int64()) for m in MEASURES]], names=["id", "host", *MEASURES])
                at = to

    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    schema = rows.select("id", "host", *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return materialize(rows.mapInArrow(run, schema).withColumn("base_failed", failed), "quality")


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, docs, failed, rate): rates shrunk by the empirical beta prior."""
    hosts = materialize(measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    whole = hosts.agg(F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k")).first()
    if not whole["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    p = whole["f"] / whole["n"]
    spread = hosts.agg(F.sum(F.col("docs") * F.pow(F.col("failed") / F.col("docs") - p, 2)) / whole["n"]).first()[0]
    between = spread - p * (1 - p) * whole["k"] / whole["n"]  # what chance alone doesn't explain
    strength = min(_PRIOR_MAX, max(_PRIOR_MIN, p * (1 - p) / between - 1)) if between > 0 else _PRIOR_MAX
    return hosts.withColumn("rate", (F.col("failed") + p * strength) / (F.col("docs") + strength))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(id, host, measures, base_failed, host_rate, kept)."""
    measured = rules(docs, id_col, text_col, host_col)
    key = F.struct(F.col("host").isNull(), F.coalesce("host", F.lit("")))
    rates = materialize(host_rates(measured).select(key.alias("key"), F.col("rate").alias("host_rate")), "host-rates")
    joined = join_lookup(measured.withColumn("key", key), rates, ["key"]).drop("key")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), *MEASURES, "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, list_transform(range(1, greatest(len(ws) - 6, 1)), lambda i: array_to_string(ws[i : i + 7], ' ')) AS grams FROM w),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM (SELECT r, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM x)
), c AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM g, range(0, 8) t(j) WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN l USING (r)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM f GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS p, sum(n) AS n, count(*) AS k FROM h),
s AS (SELECT any_value(p.p) AS p, sum(h.n * pow(h.f / h.n - p.p, 2)) / any_value(p.n) - any_value(p.p * (1 - p.p) * p.k / p.n) AS b FROM h, p),
t AS (SELECT p, CASE WHEN b > 0 THEN least(1e6, greatest(1.0, p * (1 - p) / b - 1)) ELSE 1e6 END AS m FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.f + t.p * t.m) / (h.n + t.m) <= 0.5 AS kept, round((h.f + t.p * t.m) / (h.n + t.m), 9) AS host_rate
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, t
"""
