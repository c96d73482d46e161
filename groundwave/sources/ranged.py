"""Vendor files read in byte ranges of whole traces, as a Spark data source: a file of any size is read by many tasks.

The driver lists names and sizes only; a task reads the few bytes of its file's head and the traces whose first byte
lies in its range. Rows are those of the readers in `blocks` and `mala`: (path, channel, trace, dt, ns, amp), numbers from 1.
Folders are paths or URIs that pyarrow's file systems open on driver and executors alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, channel int, trace long, dt double, ns int, amp array<float>"
#: Suffixes of each kind's data files and, where there is one, of its text header; types of samples.
SUFFIXES = {"rd3": (".rd3", ".rad"), "rd7": (".rd7", ".rad"), "iprb": (".iprb", ".iprh"), "dzt": (".dzt", None), "dt1": (".dt1", None), "segy": (".sgy", None), "segy16": (".sgy", None)}
_SAMPLES = {"rd3": "<i2", "rd7": "<i4", "iprb": "<i2", "dt1": "<i2", "segy": ">f4", "segy16": "<i2"}
_HEAD, _CHUNK = 4096, 8 << 20


@dataclass
class Layout:
    """Where a file's traces are: the first at byte `begin`, each `size` bytes, samples from byte `offset` of it on."""

    begin: int
    size: int
    offset: int
    kind: str
    ns: int
    dt: float
    channels: int = 1
    channel: int = 1
    numbered: bool = False  # a trace has its number in front of it, as a float32
    shift: int = 0


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; like Spark, without decoding a local one's characters."""
    local = re.match(r"(file:(//)?)?(?=/)", path)
    return (fs.LocalFileSystem(), path[local.end() :]) if local or "://" not in path else fs.FileSystem.from_uri(path)


def _fields(system: fs.FileSystem, path: str, suffix: str) -> dict[str, float]:
    """The numbers of a text header of the same name, in either case of its suffix."""
    stem = path[: path.rindex(".")]
    for name in (stem + suffix, stem + suffix.upper()):
        if system.get_file_info(name).type == fs.FileType.File:
            with system.open_input_stream(name) as text:
                found = re.findall(r"(?m)^\s*(\w+):\s*([0-9.]+)", text.read().decode("utf-8", "replace"))
            return {k: float(v) for k, v in found}
    raise ValueError(f"{path} has no header {suffix}")


def layout(system: fs.FileSystem, path: str, kind: str, head: bytes, start: int | None = None) -> Layout:
    short = lambda at, order="little": int.from_bytes(head[at : at + 2], order)
    if SUFFIXES[kind][1]:
        given = _fields(system, path, SUFFIXES[kind][1])
        ns, width = int(given["SAMPLES"]), np.dtype(_SAMPLES[kind]).itemsize
        number = re.search(r"_A?(\d+)\.[^./]+$", path)
        channels = int(given.get("NUMBER_OF_CH", 1)) if kind == "rd3" else 1
        return Layout(0, ns * width, 0, _SAMPLES[kind], ns, given["TIMEWINDOW"] / max(ns, 1), channels, int(number[1]) if number and kind != "rd3" else 1)
    if kind == "dt1":
        ns, window = (int(np.frombuffer(head, "<f4", 1, at)[0]) if at == 8 else float(np.frombuffer(head, "<f4", 1, at)[0]) for at in (8, 24))
        return Layout(0, 128 + 2 * ns, 128, "<i2", ns, window / max(ns, 1), numbered=True)
    if kind == "dzt":
        offset, ns, bits, channels, span = short(2), short(4), short(6), max(1, short(52)), float(np.frombuffer(head, "<f4", 1, 26)[0])
        begin = start if start is not None else 2 * offset if channels > 1 else offset + 64 * ns
        sample = "<i4" if bits == 32 else "<u2"
        return Layout(begin, ns * np.dtype(sample).itemsize, 0, sample, ns, span / max(ns, 1), channels, shift=0 if bits == 32 else 32768)
    order = "big" if kind == "segy" else "little"
    ns = short(3220, order)
    if kind == "segy" and short(3224, order) != 5:
        raise ValueError(f"{path}: samples are not IEEE floats")
    return Layout(3600, 240 + ns * np.dtype(_SAMPLES[kind]).itemsize, 240, _SAMPLES[kind], ns, short(3216, order) / 1000)


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.kind, self.step = options["path"], options["kind"], int(options.get("rangebytes", 64 << 20))
        self.start = int(options["start"]) if "start" in options else None

    def partitions(self):
        system, base = store(self.folder)
        suffix, scheme = SUFFIXES[self.kind][0], self.folder[: self.folder.index("://")] if "://" in self.folder else ""
        found = system.get_file_info(fs.FileSelector(base)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and f.size:
                path = f"{scheme}://{f.path}" if scheme and "://" not in f.path else f.path
                out += [Range(path, f.size, at, min(f.size, at + self.step)) for at in range(0, f.size, self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        system, path = store(part.path)
        with system.open_input_file(path) as file:
            head = file.read_at(min(_HEAD, part.size), 0)
            if self.kind == "dt1" and part.size < 128 or self.kind.startswith("segy") and part.size < 3600:
                return
            at = layout(system, path, self.kind, head, self.start)
            if at.ns <= 0:
                raise ValueError(f"{part.path}: the header gives no number of samples")
            whole = max(0, part.size - at.begin) // at.size
            # the traces whose first byte lies in the range
            first, last = (min(whole, max(0, -(-(b - at.begin) // at.size))) for b in (part.start, part.end))
            rows = max(1, _CHUNK // at.size)
            kind = np.dtype(at.kind)
            for lo in range(first, last, rows):
                n = min(rows, last - lo)
                raw = np.frombuffer(file.read_at(n * at.size, at.begin + lo * at.size), np.uint8).reshape(n, at.size)
                block = np.ascontiguousarray(raw[:, at.offset : at.offset + at.ns * kind.itemsize]).view(kind).astype(np.float32) - np.float32(at.shift)
                i = np.arange(lo, lo + n)
                number = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0].astype(np.int64) if at.numbered else i // at.channels + 1
                channel = i % at.channels + 1 if at.channels > 1 else np.full(n, at.channel)
                offsets = np.arange(n + 1, dtype=np.int32) * at.ns
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * n), pa.array(channel.astype(np.int32)), pa.array(number), pa.array(np.full(n, at.dt)), pa.array(np.full(n, at.ns, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel()))],
                    names=["path", "channel", "trace", "dt", "ns", "amp"],
                )


class Traces(DataSource):
    """Data source `traces`: options path, kind (of SUFFIXES), rangeBytes and, for .dzt, start."""

    @classmethod
    def name(cls):
        return "traces"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TraceReader(self.options)


def read(spark: SparkSession, folder: str, kind: str, range_bytes: int = 64 << 20, start: int | None = None) -> DataFrame:
    """The traces of all files of a kind in a folder. A part trace at a file's end is dropped; a .dzt file's traces keep
    the numbers that they were recorded with (see `live`)."""
    if kind not in SUFFIXES:
        raise ValueError(f"no such kind of file: {kind}")
    spark.dataSource.register(Traces)
    rows = spark.read.format("traces").option("kind", kind).option("rangeBytes", range_bytes)
    return (rows if start is None else rows.option("start", start)).load(folder)


def live(traces: DataFrame, dead_sample: int = 150, quiet: int = 0, scale: float = 1.0) -> DataFrame:
    """Traces without those whose sample dead_sample (1-based) is 0, numbered again by channel; the first `quiet` samples become 0, all are divided by scale."""
    kept = traces.where(F.coalesce(F.get("amp", F.lit(dead_sample - 1)) != 0, F.lit(True)))
    number = F.row_number().over(W.partitionBy("path", "channel").orderBy("trace")).cast("long")
    scaled = F.transform("amp", lambda x, i: F.when(i < quiet, 0.0).otherwise(x / scale).cast("float"))
    return kept.withColumns({"trace": number, "amp": scaled})
