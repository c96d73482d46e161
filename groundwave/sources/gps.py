"""Position logs: pairs of a trace line and a GGA line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo


def read_dzg(spark: SparkSession, folder: str) -> DataFrame:
    """(path, trace, lat, lon, z, quality) of well-formed pairs: 3 fields in the trace line, 15 in the GGA line that follows."""
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line", "text"))
    w = W.partitionBy("path").orderBy("line")
    rows = rows.withColumns({"a": F.split("text", ","), "b": F.split(F.lead("text").over(w), ",")})
    rows = rows.where((F.get("a", F.lit(0)) == "$GSSIS") & (F.size("a") == 3) & (F.get("b", F.lit(0)) == "$GPGGA") & (F.size("b") == 15))
    at = lambda i: F.get("b", F.lit(i))
    sign = lambda i, back: F.when(at(i) == back, -1.0).otherwise(1.0)
    return rows.select(
        "path", F.get("a", F.lit(1)).try_cast("long").alias("trace"), (geo.ddmm(at(2).try_cast("double")) * sign(3, "S")).alias("lat"),
        (geo.ddmm(at(4).try_cast("double")) * sign(5, "W")).alias("lon"), at(9).try_cast("double").alias("z"), at(6).try_cast("int").alias("quality"),
    ).where("trace is not null and lat is not null and lon is not null")
