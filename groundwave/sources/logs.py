"""Text lists: positions, coordinates, markers, control points, layer picks; trace-position logs of pulled carts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

#: The columns of each list.
LISTS = {
    "pos": ["trace", "x", "y", "z"],
    "total_station": ["trace", "x", "y", "z"],
    "topography": ["x", "y", "z"],
    "sections": ["x0", "y0", "x1", "y1"],
    "control_points": ["local_x", "local_y", "global_x", "global_y"],
    "markers": ["profile", "x0", "y0", "x1", "y1", "markers"],
    "layer_picks": ["x", "z", "e", "n", "id", "profile", "line", "flag"],
}


def read_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, columns of the kind): lines of numbers between blanks, tabs, commas or semicolons. Lines that begin with anything else, or with too few numbers, are left out."""
    names = LISTS[kind]
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"[\s,;]+").alias("f"))
    rows = rows.select("path", *[F.get("f", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    return rows.where(~F.exists(F.array(*names), F.isnull))


def read_cart(spark: SparkSession, folder: str) -> DataFrame:
    """(path, trace, position, lat, lon, z): a line `Trace #n at position p`, then a GGA sentence; a trace line without one is left out."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.startswith("Trace") | x.startswith("$GPGGA"))
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(lines).alias("line", "text"))
    rows = rows.withColumn("b", F.split(F.lead("text").over(W.partitionBy("path").orderBy("line")), ","))
    at = lambda i: F.get("b", F.lit(i))
    sign = lambda i, back: F.when(at(i) == back, -1.0).otherwise(1.0)
    rows = rows.where(F.col("text").startswith("Trace") & (at(0) == "$GPGGA"))
    return rows.select(
        "path", F.regexp_extract("text", r"#\s*(\d+)", 1).try_cast("long").alias("trace"), F.regexp_extract("text", r"position\s+(-?[0-9.]+)", 1).try_cast("double").alias("position"),
        (geo.ddmm(at(2).try_cast("double")) * sign(3, "S")).alias("lat"), (geo.ddmm(at(4).try_cast("double")) * sign(5, "W")).alias("lon"), at(9).try_cast("double").alias("z"),
    ).where("trace is not null and lat is not null and lon is not null")


def read_cor(spark: SparkSession, path: str) -> DataFrame:
    """(path, trace, lat, lon, z, quality): lines `trace date time lat N lon E height M quality`; others are left out."""
    at = lambda i: F.get("f", F.lit(i))
    sign = lambda i, back: F.when(at(i) == back, -1.0).otherwise(1.0)
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 8)
    rows = rows.select("path", at(0).try_cast("long").alias("trace"), (at(3).try_cast("double") * sign(4, "S")).alias("lat"), (at(5).try_cast("double") * sign(6, "W")).alias("lon"), at(7).try_cast("double").alias("z"), at(9).try_cast("int").alias("quality"))
    return rows.where("trace is not null and lat is not null and lon is not null")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature, part, k, x, y, properties) of the corners of all lines and polygon rings; features, parts and corners count from 0. Files of one
    FeatureCollection, or of one feature a file; other geometries are left out."""
    ring = "array<array<double>>"
    kinds = {"LineString": ring, "MultiLineString": f"array<{ring}>", "Polygon": f"array<{ring}>", "MultiPolygon": f"array<array<{ring}>>"}
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    field = lambda source, name: F.get_json_object(source, f"$.{name}")
    each = F.from_json(field("value", "features"), "array<string>")
    rows = text.select("path", F.posexplode(F.coalesce(each, F.array("value"))).alias("feature", "f"))
    rows = rows.select("path", "feature", field("f", "geometry.type").alias("type"), field("f", "geometry.coordinates").alias("c"), field("f", "properties").alias("properties"))
    parts = F.when(F.col("type") == "LineString", F.array(F.from_json("c", kinds["LineString"])))
    parts = parts.when(F.col("type").isin("MultiLineString", "Polygon"), F.from_json("c", kinds["Polygon"])).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json("c", kinds["MultiPolygon"])))
    rows = rows.select("path", "feature", "properties", F.posexplode(parts).alias("part", "corners")).select("path", "feature", "part", F.posexplode("corners").alias("k", "p"), "properties")
    return rows.select("path", "feature", "part", "k", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "properties")


#: Records of the two binary logs, after 8 numbers of 16 bits. Bytes of a wheel record count from 0.
_CPSS = np.dtype([("trace", "<i4"), ("place", "<f8", 3), ("h", "<u2"), ("m", "<u2"), ("s", "<u2"), ("ms", "<u2"), ("pc_h", "<u2"), ("pc_m", "<u2"), ("pc_s", "<u2"), ("status", "<u2")])
_CPDT = np.dtype({"names": ["trace", "wheel", "cu", "pc_h", "pc_m", "pc_s"], "formats": [">i2", ">i2", ">i2", "<i4", "<i4", "i1"], "offsets": [0, 4, 16, 21, 25, 29], "itemsize": 32})
_HEAD = 16


def _records(spark: SparkSession, folder: str, pattern: str, layout: np.dtype, columns: dict, kinds: str) -> DataFrame:
    """Whole records of every file; a part record at the end and trace numbers under 1 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def decode(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                raw = content.as_buffer()
                rows = np.frombuffer(raw, layout, max(0, len(raw) - _HEAD) // layout.itemsize, min(_HEAD, len(raw)))
                rows = rows[rows["trace"] > 0]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), *[pa.array(f(rows).astype(np.int64)) for f in columns.values()]], names=["path", *columns])

    return files.mapInArrow(decode, "path string, " + kinds)


def _clock(rows: np.ndarray, before: str) -> np.ndarray:
    """Milliseconds of the day."""
    h, m, s = (rows[before + part].astype(np.int64) for part in ("h", "m", "s"))
    return ((h * 60 + m) * 60 + s) * 1000


def read_cpss(spark: SparkSession, folder: str) -> DataFrame:
    """(path, trace, pos_ms, pc_ms, ms, status) of .cpss logs: positioning and computer time of a trace in ms of the day, the former's ms part, state of the receiver."""
    columns = {"trace": lambda r: r["trace"], "pos_ms": lambda r: _clock(r, "") + r["ms"], "pc_ms": lambda r: _clock(r, "pc_"), "ms": lambda r: r["ms"], "status": lambda r: r["status"]}
    return _records(spark, folder, "*.cpss", _CPSS, columns, "trace long, pos_ms long, pc_ms long, ms long, status long")


def read_cpdt(spark: SparkSession, folder: str) -> DataFrame:
    """(path, trace, cu_ms, pc_ms, wheel) of .cpdt logs: time of the control unit (recorded in 1/1024 s) and of the computer in ms, wheel count."""
    columns = {"trace": lambda r: r["trace"], "cu_ms": lambda r: np.floor(r["cu"].astype(float) / 1024 * 1000 + 0.5), "pc_ms": lambda r: _clock(r, "pc_"), "wheel": lambda r: r["wheel"]}
    return _records(spark, folder, "*.cpdt", _CPDT, columns, "trace long, cu_ms long, pc_ms long, wheel long")


def read_clock(spark: SparkSession, folder: str) -> DataFrame:
    """(path, trace, cu_ms, pulse) of .cpdt logs: the control unit's time from the log's second trace on, which stands at 20 ms, the first at 0;
    pulse marks the trace behind a record without a trace number, which the receiver's pulse leaves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cpdt").load(folder).select("path", "content")

    def decode(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                raw = content.as_buffer()
                rows = np.frombuffer(raw, _CPDT, max(0, len(raw) - _HEAD) // _CPDT.itemsize, min(_HEAD, len(raw)))
                pulse = np.zeros(len(rows), bool)
                pulse[1:] = rows["trace"][:-1] == 0
                kept = rows["trace"] > 0
                clock = np.floor(rows["cu"][kept].astype(float) / 1024 * 1000 + 0.5).astype(np.int64)
                clock = clock - (clock[1] if len(clock) > 1 else 0) + 20
                clock[:1] = 0
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(clock), pa.string()), pa.array(rows["trace"][kept].astype(np.int64)), pa.array(clock), pa.array(pulse[kept])], names=["path", "trace", "cu_ms", "pulse"])

    return files.mapInArrow(decode, "path string, trace long, cu_ms long, pulse boolean")
