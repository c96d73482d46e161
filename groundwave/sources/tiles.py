"""A cube in tiles: built in batches, restarted where it stopped, read in parts.

folder/data holds the cube partitioned by tile (tx, ty), folder/manifest a row for each tile that is whole. A batch of tiles is
written first, replacing what an earlier run may have left of them, and only then entered; readers see entered tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "tx long, ty long, n long"


def with_tiles(cells: DataFrame, size: int) -> DataFrame:
    return cells.withColumns({"tx": F.floor(F.col("ix") / size), "ty": F.floor(F.col("iy") / size)})


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(tx, ty, n) of the tiles that are whole."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").groupBy("tx", "ty").agg(F.max("n").alias("n"))
    except AnalysisException:  # nothing was ever entered
        return spark.createDataFrame([], MANIFEST)


def build(places: DataFrame, make: Callable[[DataFrame], DataFrame], folder: str, size: int = 64, batches: int = 8) -> int:
    """Builds the tiles of size x size cells that places (ix, iy) lie in and that are not whole yet, and gives their number.

    make gets the tiles (tx, ty) of one batch and gives their cells (ix, iy, ...), whose work should follow from the tiles (a join with them, say).
    Tiles are dealt to batches by hash, so each is about an n-th of what is left. Null places have no tile; a tile that make has no
    cells for is entered with 0.
    """
    spark = places.sparkSession
    wanted = with_tiles(places.where("ix is not null and iy is not null"), size).select("tx", "ty").distinct()
    todo = wanted.join(finished(spark, folder), ["tx", "ty"], "left_anti").withColumn("_batch", F.pmod(F.xxhash64("tx", "ty"), F.lit(batches)))
    counts = {r["_batch"]: r["count"] for r in todo.groupBy("_batch").count().collect()}  # a row for each batch
    # the batches' tiles are what was left when the build began, whatever is entered meanwhile
    todo.write.mode("overwrite").parquet(f"{folder}/todo")
    todo = spark.read.schema("tx long, ty long, _batch long").parquet(f"{folder}/todo")
    for b in sorted(counts):
        tiles = todo.where(F.col("_batch") == b).select("tx", "ty")
        cells = with_tiles(make(tiles), size).join(tiles, ["tx", "ty"], "left_semi")
        cells.repartition("tx", "ty").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tx", "ty").parquet(f"{folder}/data")
        rows = tiles.join(_data(spark, folder).join(tiles, ["tx", "ty"], "left_semi").groupBy("tx", "ty").agg(F.count("*").alias("n")), ["tx", "ty"], "left")
        rows.select("tx", "ty", F.coalesce("n", F.lit(0)).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return sum(counts.values())


def _data(spark: SparkSession, folder: str) -> DataFrame:
    try:
        rows = spark.read.parquet(f"{folder}/data")
    except AnalysisException:  # no tile had a cell
        return spark.createDataFrame([], "ix long, iy long, tx long, ty long")
    return rows.withColumns({"tx": F.col("tx").cast("long"), "ty": F.col("ty").cast("long")})


def read(spark: SparkSession, folder: str, size: int = 64, area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The cells of the tiles that are whole; area (least ix, least iy, greatest ix, greatest iy) reads its own tiles only: the conditions on
    tx and ty prune folders before any file is opened."""
    try:
        rows = spark.read.parquet(f"{folder}/data")
    except AnalysisException:
        return _data(spark, folder).drop("tx", "ty")
    if area:
        x0, y0, x1, y1 = (math.floor(a / size) for a in area)
        rows = rows.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1) & F.col("ix").between(area[0], area[2]) & F.col("iy").between(area[1], area[3]))
    return rows.join(finished(spark, folder).select("tx", "ty"), ["tx", "ty"], "left_semi").drop("tx", "ty")
