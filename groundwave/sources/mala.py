"""Multi-channel profiles of a text header (.rad) and interleaved little-endian int16 samples (.rd3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import placing
from . import logs
from .heads import joined

SCHEMA = "profile string, channel int, trace int, dt double, ns int, amp array<float>"


def read(spark: SparkSession, folder: str, batch: int = 4096) -> DataFrame:
    """One row for each trace of every profile in folder. Header and samples of a profile meet by name; channels alternate trace by trace; a part trace at the end is dropped."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    head = spark.read.format("binaryFile").option("pathGlobFilter", "*.rad").load(folder).select(stem.alias("profile"), F.decode("content", "utf-8").alias("head"))
    field = lambda key, kind: F.regexp_extract("head", rf"(?m)^\s*{key}:\s*([0-9.]+)", 1).try_cast(kind)
    head = head.select("profile", field("SAMPLES", "int").alias("ns"), field("TIMEWINDOW", "double").alias("window"), F.coalesce(field("NUMBER_OF_CH", "int"), F.lit(1)).alias("channels"))
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.rd3").load(folder).select(stem.alias("profile"), "content")

    def decode(batches):
        for rows in batches:
            for profile, ns, window, channels, content in zip(*(c for c in rows.columns), strict=True):
                n, nch = ns.as_py(), channels.as_py()
                raw = content.as_buffer()
                samples = np.frombuffer(raw, "<i2", len(raw) // 2)
                samples = samples[: len(samples) // n * n].reshape(-1, n)
                for at in range(0, len(samples), batch):
                    part = samples[at : at + batch].astype(np.float32)
                    i = np.arange(at, at + len(part))
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([profile.as_py()] * len(part)), pa.array((i % nch + 1).astype(np.int32)), pa.array((i // nch + 1).astype(np.int32)), pa.array(np.full(len(part), window.as_py() / n)), pa.array(np.full(len(part), n, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))],
                        names=["profile", "channel", "trace", "dt", "ns", "amp"],
                    )

    return joined(data, head, "profile").select("profile", "ns", "window", "channels", "content").mapInArrow(decode, SCHEMA)


def read_offsets(spark: SparkSession, folder: str, mirrored: bool = False, more_along: float = 0.0) -> DataFrame:
    """(profile, channel, across, along) of the headers' channel offsets; mirrored changes the sign along, to which more_along is added then.
    A header without offsets has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rad").load(folder)
    head = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("profile"), F.decode("content", "utf-8").alias("head"))
    numbers = lambda key: F.transform(F.split(F.trim(F.regexp_extract("head", rf"(?m)^\s*{key}:[ \t]*(.*)$", 1)), r"\s+"), lambda x: x.try_cast("double"))
    rows = head.select("profile", F.posexplode(F.arrays_zip(numbers("CH_X_OFFSETS").alias("a"), numbers("CH_Y_OFFSETS").alias("b"))).alias("i", "o"))
    sign = -1.0 if mirrored else 1.0
    return rows.select("profile", (F.col("i") + 1).alias("channel"), F.col("o.a").alias("across"), (F.col("o.b") * sign + more_along).alias("along")).where("across is not null and along is not null")


def read_placed(spark: SparkSession, folder: str, least: int = 15, ahead: int = 15, **offsets) -> DataFrame:
    """Traces with the coordinates of their channel's middle: positions of profile_G01.pos (trace, north, east, height), interpolated on trace numbers,
    and the header's channel offsets. Profiles of less than `least` traces a channel and traces without a position go."""
    fixes = logs.read_list(spark, f"{folder}/*.pos", "pos").select(F.regexp_extract("path", r"([^/]+?)(_G\d+)?\.pos$", 1).alias("profile"), F.col("trace").cast("int").alias("trace"), F.col("y").alias("x"), F.col("x").alias("y"), "z")
    placed = placing.place(read(spark, folder), fixes, least=least)
    table = read_offsets(spark, folder, **offsets)
    # offsets belong to a profile and a channel: one key for the operator
    key = lambda: F.concat_ws("/", "profile", F.col("channel").cast("string"))
    rows = placed.withColumn("number", F.col("channel")).withColumn("channel", key())
    out = placing.channel_offsets(rows, table.select(key().alias("channel"), "across", "along"), ahead=ahead)
    return out.withColumn("channel", F.col("number")).drop("number")
