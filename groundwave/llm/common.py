"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes (space and \x09-\x0D).
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset: it gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def materialize(df: DataFrame, name: str, codec: str = "snappy", outer: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, lost executors cost nothing.
    An outer table lasts as long as those written outside of the scratch() that it is written in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outer else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like materialize(), dealt to buckets by key: joins on key shuffle only their other side, however often they are made."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    if _scopes:
        _scopes[-1].append(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, so what is to last must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none of their names can clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def join_lookup(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", max_rows: int = 100_000) -> DataFrame:
    """Join a materialised lookup table. It is broadcast only when a count proves it small;
    beyond max_rows both sides are shuffled and adaptive execution splits skewed partitions."""
    small = table.count() <= max_rows
    return df.join(F.broadcast(table) if small else table, on, how)


def running_sum(numbers: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers. Sums are made in blocks of about the root of its length, as an array
    that grows in an aggregate is copied at every step. numbers must be a column, not an expression: every block reads it."""
    step = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    sums = lambda block: F.aggregate(block, F.array().cast("array<int>"), grow)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 1, F.lit(0)), step), lambda at: sums(F.slice(numbers, at + 1, step)))
    before = sums(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))))
    offset = F.concat(F.array(F.lit(0)), before)
    return F.flatten(F.zip_with(blocks, F.slice(offset, 1, F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o)))


def unsliced(texts: pa.Array) -> pa.Array:
    """texts as large strings without nulls that begin at their buffers' start: some string kernels misread slices."""
    return pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_string()).fill_null("")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
