"""Vendor formats that are a header and a block of traces: little-endian samples, one column format for all.

Every reader gives (path, channel, trace, dt, ns, amp), dt in ns, numbers from 1. Files are read whole
by the task that holds them and leave it in batches of traces; a part trace at a file's end is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heads import joined

SCHEMA = "path string, channel int, trace int, dt double, ns int, amp array<float>"


def _emit(path: str, channel: np.ndarray, number: np.ndarray, dt: float, block: np.ndarray, batch: int = 4096):
    n = block.shape[1]
    for at in range(0, len(block), batch):
        part = np.ascontiguousarray(block[at : at + batch], np.float32)
        offsets = np.arange(len(part) + 1, dtype=np.int32) * n
        columns = [pa.array([path] * len(part)), pa.array(channel[at : at + batch].astype(np.int32)), pa.array(number[at : at + batch].astype(np.int32)), pa.array(np.full(len(part), dt)), pa.array(np.full(len(part), n, np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], names=["path", "channel", "trace", "dt", "ns", "amp"])


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def _decoded(rows: DataFrame, decode: Callable) -> DataFrame:
    """decode gives (channel, number, dt, block) of a row's other columns and its content."""

    def run(batches):
        for batch in batches:
            for path, *rest, content in zip(*batch.columns, strict=True):
                yield from _emit(path.as_py(), *decode(*(r.as_py() for r in rest), content.as_buffer()))

    return rows.mapInArrow(run, SCHEMA)


def _traces(raw, kind: str, ns: int, start: int = 0) -> np.ndarray:
    if ns <= 0:
        raise ValueError("a header gives no number of samples")
    kind = np.dtype(kind)
    n = max(0, len(raw) - start) // kind.itemsize // ns * ns
    return np.frombuffer(raw, kind, n, start if n else 0).reshape(-1, ns)


def read_dzt(spark: SparkSession, folder: str, start: int | None = None, dead_sample: int | None = 150, quiet: int = 0, scale: float = 1.0) -> DataFrame:
    """.dzt: channels alternate trace by trace. 16-bit samples are offset binary, 32-bit ones signed.

    Samples begin at byte `start`, by default 64 bytes a sample after the header's data offset for one
    channel and at twice that offset for more, which is how recorders of this format leave them.

    Traces whose sample dead_sample (1-based) is 0 are dropped before they are numbered (None: keep all);
    the first `quiet` samples become 0 and all are divided by scale, as newer recorders ask for.
    """

    def decode(raw):
        #: Places in the file header of data offset, samples, bits, range (ns) and channels.
        short = lambda at: int(np.frombuffer(raw, "<u2", 1, at)[0])
        offset, ns, bits, span, channels = short(2), short(4), short(6), float(np.frombuffer(raw, "<f4", 1, 26)[0]), max(1, short(52))
        begin = start if start is not None else 2 * offset if channels > 1 else offset + 64 * ns
        block = _traces(raw, "<i4" if bits == 32 else "<u2", ns, begin).astype(np.float64)
        if bits != 32:
            block -= 32768
        i = np.arange(len(block))
        block[:, :quiet] = 0
        channel = i % channels + 1
        if dead_sample is not None and dead_sample <= ns:
            keep = block[:, dead_sample - 1] != 0
            block, channel = block[keep], channel[keep]
        number = np.zeros(len(block), int)
        for c in range(1, channels + 1):
            number[channel == c] = np.arange(1, (channel == c).sum() + 1)
        return channel, number, span / ns, block / scale

    return _decoded(_files(spark, folder, "*.{dzt,DZT}"), decode)


def read_dt1(spark: SparkSession, folder: str) -> DataFrame:
    """.dt1: every trace has a header of 128 bytes (number, position, samples, window) and int16 samples; the channel is 1."""

    def decode(raw):
        if len(raw) < 128:
            return np.zeros(0), np.zeros(0), 0.0, np.zeros((0, 1))
        #: float32 fields at 0 (trace number), 8 (samples), 24 (time window, ns).
        ns, window = int(np.frombuffer(raw, "<f4", 1, 8)[0]), float(np.frombuffer(raw, "<f4", 1, 24)[0])
        layout = np.dtype({"names": ["number", "amp"], "formats": ["<f4", ("<i2", (ns,))], "offsets": [0, 128], "itemsize": 128 + 2 * ns})
        rows = np.frombuffer(raw, layout, len(raw) // layout.itemsize)
        return np.ones(len(rows)), rows["number"], window / ns, rows["amp"]

    return _decoded(_files(spark, folder, "*.{dt1,DT1}"), decode)


def _with_header(spark: SparkSession, folder: str, heads: str, data: str, kind: str) -> DataFrame:
    """A text header and a block of samples of the same name for each channel; the channel is the number at the name's end."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem")
    text = F.decode("content", "utf-8")
    field = lambda key: F.regexp_extract(text, rf"(?m)^\s*{key}:\s*([0-9.]+)", 1).try_cast("double")
    head = _files(spark, folder, heads).select(stem, field("SAMPLES").cast("int").alias("ns"), field("TIMEWINDOW").alias("window"))
    rows = joined(_files(spark, folder, data).select("path", stem, "content"), head, "stem")
    channel = F.coalesce(F.regexp_extract("stem", r"_A?(\d+)$", 1).try_cast("int"), F.lit(1))

    def decode(number, ns, window, raw):
        block = _traces(raw, kind, ns)
        return np.full(len(block), number), np.arange(1, len(block) + 1), window / ns, block

    return _decoded(rows.select("path", channel.alias("number"), "ns", "window", "content"), decode)


def read_rd7(spark: SparkSession, folder: str) -> DataFrame:
    """.rad headers with int32 samples (.rd7), one file for each channel (name_A1)."""
    return _with_header(spark, folder, "*.{rad,RAD}", "*.{rd7,RD7}", "<i4")


def read_iprb(spark: SparkSession, folder: str) -> DataFrame:
    """.iprh headers with int16 samples (.iprb), one file for each channel (name_A01)."""
    return _with_header(spark, folder, "*.iprh", "*.iprb", "<i2")


def read_segy16(spark: SparkSession, folder: str, pattern: str = "*.{sgy,SGY}") -> DataFrame:
    """SEG-Y in the machine's byte order with int16 samples; dt in the header is in picoseconds."""

    def decode(raw):
        #: Places of dt and samples in the file header, sizes of the file's and a trace's headers.
        dt, ns = (int(np.frombuffer(raw, "<u2", 1, at)[0]) for at in (3216, 3220))
        layout = np.dtype({"names": ["amp"], "formats": [("<i2", (ns,))], "offsets": [240], "itemsize": 240 + 2 * ns})
        rows = np.frombuffer(raw, layout, (len(raw) - 3600) // layout.itemsize, 3600 if len(raw) > 3600 else 0)
        return np.ones(len(rows)), np.arange(1, len(rows) + 1), dt / 1000, rows["amp"]

    return _decoded(_files(spark, folder, pattern), decode)
