"""Sharding by extendible hashing, in Spark expressions only.

A row's hash is md5 of its key. The directory is indexed by leading hash bits; a bucket whose bytes
exceed the limit is split on one more bit, others stay, so every shard has the shortest prefix whose
rows fit. All depths are counted from one histogram of fine prefixes instead of one pass a split.
Only buckets that are still too large at the finest prefix are counted again with more bits.

Defined results: a null text has 0 bytes; a null key hashes like an empty one; rows with one key
share a bucket until the key's 60 bits are used up, after which they are divided by a second hash of
the key and the row's text; a bucket of one row is never split, even if that row is over the limit;
identical rows (key and text) beyond the limit stay together; an empty table gives an empty table; of
assign's input only key and text are read, and write keeps the other columns in a struct, so none can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, whole_row

#: Bits of the first hash and of both.
KEY_BITS, ALL_BITS, _STEP = 60, 120, 6


def _bits(text: Column, digits: int) -> Column:
    """The leading hex digits of an md5 as a string of bits."""
    return F.lpad(F.conv(F.substring(F.md5(text), 1, digits), 16, 2), digits * 4, "0")


def _hash(key: str, text: str) -> Column:
    """The bits of a row: those of its key, then those of key and text."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.concat(_bits(name, KEY_BITS // 4), _bits(F.concat(name, F.lit("/"), F.coalesce(F.col(text), F.lit(""))), KEY_BITS // 4))


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows) of written rows (hash, n_bytes), as a written table."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    found, fine, open_rows, start = None, min(ALL_BITS, max(4, math.ceil(math.log2(max(1, total) / limit + 1)) + _STEP)), rows, 0
    while True:
        histogram = open_rows.groupBy(F.substring("hash", 1, fine).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        # every depth's bucket sums from the one histogram
        depths = histogram.select("*", F.explode(F.sequence(F.lit(start), F.lit(fine))).alias("depth"))
        buckets = depths.groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1) | (F.col("depth") == ALL_BITS))
        # a bucket is in the directory if its parent had to be split
        parents = buckets.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        leaves = fits.withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(parents, ["depth", "parent"], "left_semi").select("shard", "depth", "shard_bytes", "shard_rows")
        if start == 0:
            leaves = leaves.unionByName(fits.where("depth = 0").select("shard", "depth", "shard_bytes", "shard_rows"))
        leaves = materialize(leaves, "shard-directory")
        found = leaves if found is None else found.unionByName(leaves)
        if fine == ALL_BITS:
            break
        large = materialize(histogram.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("prefix"), "shard-large")
        if large.isEmpty():
            break
        open_rows = join_lookup(open_rows.withColumn("prefix", F.substring("hash", 1, fine)), large, ["prefix"], "left_semi").select("hash", "n_bytes")
        start, fine = fine, min(ALL_BITS, fine + 2 * _STEP)
    return materialize(found, "shard-all")


def place(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of the directory in place of hash; every row meets one shard, by one of the few depths in use."""
    used = [r["depth"] for r in table.select("depth").distinct().collect()]
    candidates = rows.withColumn("shard", F.explode(F.array(*[F.substring("hash", 1, d) for d in sorted(used)]))) if used else rows.withColumn("shard", F.lit(""))
    return join_lookup(candidates, table, ["shard"], "inner").drop("hash")


def assign(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """df's key and text size with shard (hash-prefix bits), depth, and the shard's bytes and rows."""
    rows = materialize(df.select(F.col(key), _size(text).alias("n_bytes"), _hash(key, text).alias("hash")), "shard-rows")
    return place(rows, directory(rows, limit))


def write(df: DataFrame, key: str, text: str, limit: int, path: str) -> None:
    """Write every row of df to path, one folder for each shard, named b and its bits. Columns of df are inside struct `row` if one of them is named shard.
    Shards are looked up by the hashes alone; the rows are shuffled to their hash's shard, and then to few files of it."""
    hashes = materialize(df.select(_size(text).alias("n_bytes"), _hash(key, text).alias("hash")), "shard-rows")
    distinct = hashes.select("hash").distinct()
    shard_of = materialize(place(distinct.withColumn("full", F.col("hash")), directory(hashes, limit)).select(F.col("full").alias("hash"), "shard"), "shard-places")
    placed = df.select(whole_row(df).alias("row"), _hash(key, text).alias("hash")).join(shard_of.hint("merge"), "hash")
    clash = "shard" in [c.lower() for c in df.columns]
    placed = placed.select("row" if clash else "row.*", F.concat(F.lit("b"), "shard").alias("shard"))
    placed.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)


#: The query's byte limit.
LIMIT = 1 << 20


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = assign(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", LIMIT)
    return out.select("doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows")


ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents
), b AS (
  SELECT d.depth, h >> (32 - d.depth) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM r, range(0, 33) d(depth) GROUP BY ALL
), j AS (
  SELECT doc_id, n_bytes, h, b.depth, shard_bytes, shard_rows,
    row_number() OVER (PARTITION BY doc_id, n_bytes, h ORDER BY b.depth) AS n
  FROM r JOIN b ON b.p = r.h >> (32 - b.depth) WHERE shard_bytes <= {LIMIT} OR shard_rows <= 1
)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 32, '0'), 1, depth) AS shard, depth, shard_bytes, shard_rows FROM j WHERE n = 1
"""
