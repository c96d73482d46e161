"""Queries through files: traces, positions and lists of the tables are written as vendors' and our own files and read back.

Each has SQL over the table that it began with, so a reader that loses, moves or misreads anything shows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import folder
from ..sources import blocks, filesets, gps, logs, mala, ranged, segy, sinks, tiles
from .catalogue import DT, NS, SUMS, query, raw, sums, table

_COUNTED = "WITH r AS (SELECT vec_id % 7 AS file, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS a FROM embeddings) "


def _read_back(channels: int) -> str:
    return _COUNTED + f"SELECT file, (i % {channels} + 1)::BIGINT AS channel, (i // {channels} + 1)::BIGINT AS trace, 0.5::DOUBLE AS dt, {SUMS} FROM r"


def _written(spark, d: str, name: str, encode) -> str:
    """A folder with the files (suffix: bytes) that encode gives for the traces of each of 7 files, in thousandths."""
    rows = raw(spark, d).select((F.col("vec_id") % 7).alias("file"), "vec_id", F.transform("amp", lambda x: F.round(x * 1000).cast("int")).alias("amp"))
    path = folder(spark, name)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id").combine_chunks()
        block = part["amp"].chunk(0).flatten().to_numpy().reshape(part.num_rows, -1)
        made = encode(block)
        return pa.table({"name": [f"f{part['file'][0].as_py()}{suffix}" for suffix in made], "content": pa.array(list(made.values()), pa.binary())})

    sinks.write_files(rows.groupBy("file").applyInArrow(run, "name string, content binary"), path).collect()
    return path


def _told(df: DataFrame, path: str | Column = "path") -> DataFrame:
    n, s, w = sums(F.col("amp").cast("array<double>"))
    return df.select(F.regexp_extract(path, r"f(\d+)[^/]*$", 1).cast("long").alias("file"), F.col("channel").cast("long").alias("channel"), F.col("trace").cast("long").alias("trace"), F.col("dt").cast("double").alias("dt"), n, s, w)


def _head(channels: int = 1) -> bytes:
    return f"SAMPLES:{NS}\nTIMEWINDOW:{NS * DT}\nNUMBER_OF_CH:{channels}\n".encode()


@query(_read_back(3))
def read_rd3(spark, d):
    path = _written(spark, d, "rd3", lambda b: {".rad": _head(3), ".rd3": b.astype("<i2").tobytes() + b"\1"})
    return _told(mala.read(spark, path), F.concat("profile", F.lit(".rd3")))


@query(_read_back(3))
def read_rd3_ranges(spark, d):
    path = _written(spark, d, "rd3", lambda b: {".rad": _head(3), ".rd3": b.astype("<i2").tobytes() + b"\1"})
    return _told(ranged.read(spark, path, "rd3", 10_000))


@query(_read_back(1))
def read_rd7(spark, d):
    path = _written(spark, d, "rd7", lambda b: {"_A1.rad": _head(), "_A1.rd7": b.astype("<i4").tobytes()})
    return _told(blocks.read_rd7(spark, path))


@query(_read_back(1))
def read_iprb_ranges(spark, d):
    path = _written(spark, d, "iprb", lambda b: {"_A01.iprh": _head(), "_A01.iprb": b.astype("<i2").tobytes()})
    return _told(ranged.read(spark, path, "iprb", 7_000))


def _dzt(b: np.ndarray) -> dict[str, bytes]:
    head = bytearray(2048)
    for at, value in ((2, 1024), (4, NS), (6, 16), (52, 2)):
        head[at : at + 2] = value.to_bytes(2, "little")
    head[26:30] = np.float32(NS * DT).tobytes()
    return {".dzt": bytes(head) + (b + 32768).astype("<u2").tobytes()}


@query(_read_back(2))
def read_dzt(spark, d):
    return _told(blocks.read_dzt(spark, _written(spark, d, "dzt", _dzt)))


@query(_read_back(2))
def read_dzt_ranges(spark, d):
    return _told(ranged.live(ranged.read(spark, _written(spark, d, "dzt", _dzt), "dzt", 9_000)))


@query(_read_back(1))
def read_dt1(spark, d):
    """Headers and traces of a line meet by number; the number of traces that a header tells is checked by the join."""

    def encode(b):
        rows = np.zeros(len(b), np.dtype({"names": ["number", "ns", "window", "amp"], "formats": ["<f4", "<f4", "<f4", ("<i2", (NS,))], "offsets": [0, 8, 24, 128], "itemsize": 128 + 2 * NS}))
        rows["number"], rows["ns"], rows["window"], rows["amp"] = np.arange(1, len(b) + 1), NS, NS * DT, b
        lines = [""] * 20
        lines[6], lines[12], lines[14], lines[16], lines[18] = f"NUMBER OF TRACES = {len(b)}", f"TOTAL TIME WINDOW = {NS * DT}", "STARTING POSITION = 0", "FINAL POSITION = 1", "STEP SIZE USED = 0.1"
        return {".DT1": rows.tobytes(), ".HD": "\r\n".join(lines).encode()}

    path = _written(spark, d, "dt1", encode)
    pairs = filesets.pairs(spark, path, "noggin").where("size(missing) = 0")
    heads = filesets.read_hd(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_head"), "traces")
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    known = pairs.select(base("data").alias("_data"), base("header").alias("_head")).join(heads, "_head")
    read = ranged.read(spark, path, "dt1", 6_000).withColumn("_data", base("path"))
    return _told(read.join(known, "_data").where("trace <= traces"))


@query(_read_back(1))
def read_segy16(spark, d):
    def encode(b):
        head = bytearray(3600)
        head[3216:3218], head[3220:3222] = round(DT * 1000).to_bytes(2, "little"), NS.to_bytes(2, "little")
        rows = np.zeros(len(b), np.dtype({"names": ["amp"], "formats": [("<i2", (NS,))], "offsets": [240], "itemsize": 240 + 2 * NS}))
        rows["amp"] = b
        return {".sgy": bytes(head) + rows.tobytes()}

    return _told(blocks.read_segy16(spark, _written(spark, d, "sgy", encode)))


@query(f"""WITH r AS (SELECT label::BIGINT AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS trace, round(vec_id * 0.37::DOUBLE + 400000, 3) AS x, round(vec_id * 0.11::DOUBLE + 5600000, 3) AS y, embedding::DOUBLE[] AS a FROM embeddings)
SELECT file, trace, round(x, 2) AS x, round(y, 2) AS y, 0.5::DOUBLE AS dt, {SUMS} FROM r""")
def segy_in_parts(spark, d):
    """Files of each channel, written in parts with coordinates as offsets and mm, read in ranges for samples and whole for coordinates."""
    path, n = folder(spark, "segy"), F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("channel"), "vec_id", F.round(n * 0.37 + 400000, 3).alias("x"), F.round(n * 0.11 + 5600000, 3).alias("y"), F.col("embedding").cast("array<double>").alias("amp"))
    sinks.write_segy_parts(rows, path, ["channel"], "vec_id", DT, part_bytes=4_000, offset=True)
    name = F.regexp_extract("path", r"(\d+)\.sgy$", 1).cast("long").alias("file")
    places = segy.read(spark, path).select(name, F.col("trace").cast("long").alias("trace"), F.round(F.col("x") + F.col("inline"), 2).alias("x"), F.round(F.col("y") + F.col("crossline"), 2).alias("y"))
    samples = ranged.read(spark, path, "segy", 20_000).select(name, "trace", F.col("dt").cast("double").alias("dt"), *sums(F.col("amp").cast("array<double>")))
    return places.join(samples, ["file", "trace"])


@query("SELECT event_id % 20 AS file, event_id AS trace, round(value, 4) AS x, event_id * 13 % 101 / 10.0::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events")
def position_lists(spark, d):
    n, path = F.col("event_id"), folder(spark, "pos")
    rows = table(spark, d, "events").select((n % 20).alias("file"), n.alias("trace"), F.round("value", 4).alias("x"), (n * 13 % 101 / 10.0).alias("y"), (n % 7).cast("double").alias("z"))
    sinks.write_lists(rows, path, "file", "trace", ["trace", "x", "y", "z"], head="trace\tx\ty\tz").collect()
    return logs.read_list(spark, f"{path}/*.pos", "pos").select(F.regexp_extract("path", r"(\d+)\.pos$", 1).cast("long").alias("file"), F.col("trace").cast("long").alias("trace"), "x", "y", "z")


_PLACE = "event_id % 17 * 3 - 20 + event_id % 1000 / 1000.0::DOUBLE"


@query(f"SELECT event_id % 20 AS file, event_id AS trace, round({_PLACE}, 6) AS lat, round(({_PLACE}) * -2, 6) AS lon, (event_id % 50 + 0.5)::DOUBLE AS z, event_id % 3 + 1 AS quality FROM events")
def position_logs(spark, d):
    """Pairs of a trace line and a GGA line, written and read."""
    n, path = F.col("event_id"), folder(spark, "dzg")
    place = n % 17 * 3 - 20 + n % 1000 / 1000.0
    rows = table(spark, d, "events").select((n % 20).alias("file"), n.alias("trace"), place.alias("lat"), (place * -2).alias("lon"), (n % 50 + 0.5).alias("z"), (n % 3 + 1).alias("quality"))
    sinks.write_dzg(rows, path, "file").collect()
    back = gps.read_dzg(spark, f"{path}/*.DZG")
    return back.select(F.regexp_extract("path", r"(\d+)\.DZG$", 1).cast("long").alias("file"), "trace", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "z", F.col("quality").cast("long").alias("quality"))


@query("SELECT event_id % 20 AS line, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) - 1 AS k, round(value, 4) AS x, event_id * 13 % 101 / 10.0::DOUBLE AS y FROM events")
def geojson_lines(spark, d):
    n, path = F.col("event_id"), folder(spark, "lines")
    rows = table(spark, d, "events").select((n % 20).alias("line"), n.alias("nr"), F.round("value", 4).alias("x"), (n * 13 % 101 / 10.0).alias("y"))
    features = sinks.lines_geojson(rows, "line", "nr", 32632)
    sinks.write_files(features.select(F.concat(F.lit("l"), F.col("line").cast("string"), F.lit(".geojson")).alias("name"), F.encode("feature", "utf-8").alias("content")), path).collect()
    back = logs.read_geojson(spark, f"{path}/*.geojson")
    return back.select(F.regexp_extract("path", r"l(\d+)\.geojson$", 1).cast("long").alias("line"), F.col("k").cast("long").alias("k"), "x", "y")


@query("SELECT event_id AS trace, event_id * 137 % 86400000 AS pos_ms, event_id * 137 % 1000 AS ms, event_id % 3 AS status FROM events WHERE event_id > 0")
def receiver_logs(spark, d):
    """Records of the positioning receiver, written as its binary logs and read; trace 0 is no trace."""
    path = folder(spark, "cpss")

    def run(part: pa.Table) -> pa.Table:
        n = np.sort(part["event_id"].to_numpy())
        rows = np.zeros(len(n), logs._CPSS)
        day = n * 137 % 86_400_000
        rows["trace"], rows["h"], rows["m"], rows["s"], rows["ms"], rows["status"] = n, day // 3_600_000, day // 60_000 % 60, day // 1000 % 60, day % 1000, n % 3
        return pa.table({"name": [f"f{part['file'][0].as_py()}.cpss"], "content": pa.array([b"\0" * 16 + rows.tobytes()], pa.binary())})

    rows = table(spark, d, "events").select((F.col("event_id") % 5).alias("file"), "event_id")
    sinks.write_files(rows.groupBy("file").applyInArrow(run, "name string, content binary"), path).collect()
    return logs.read_cpss(spark, path).select("trace", "pos_ms", "ms", "status")


@query(f"""WITH c AS (SELECT (vec_id % 40)::BIGINT AS ix, (vec_id // 40)::BIGINT AS iy, embedding::DOUBLE[] AS a FROM embeddings) SELECT ix, iy, {SUMS} FROM c WHERE ix BETWEEN 5 AND 30 AND iy >= 2""")
def cube_of_tiles(spark, d):
    """The grid of all traces, built in tiles by batches and read in part."""
    path = folder(spark, "cube")
    cells = raw(spark, d).select((F.col("vec_id") % 40).alias("ix"), F.floor(F.col("vec_id") / 40).alias("iy"), "amp")
    tiles.build(cells, lambda todo: tiles.with_tiles(cells, 8).join(todo, ["tx", "ty"], "left_semi").drop("tx", "ty"), path, 8, 3)
    return tiles.read(spark, path, 8, (5, 2, 30, 1 << 40)).select("ix", "iy", *sums())
