"""SEG-Y revision 1 with big-endian float32 samples: reader and writer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Sizes of the file's and the trace's headers, the code of IEEE floats, the coordinates' scale.
FILE_HEADER, TRACE_HEADER, FLOATS, SCALE = 3600, 240, 5, 100
SCHEMA = "path string, trace int, x double, y double, inline int, crossline int, dt double, amp array<float>"


def _layout(ns: int) -> np.dtype:
    fields = {"trace": (0, ">i4"), "number": (4, ">i4"), "scale": (70, ">i2"), "x": (72, ">i4"), "y": (76, ">i4"), "ns": (114, ">i2"), "dt": (116, ">i2"), "inline": (188, ">i4"), "crossline": (192, ">i4"), "amp": (TRACE_HEADER, (">f4", (ns,)))}
    return np.dtype({"names": list(fields), "formats": [f for _, f in fields.values()], "offsets": [o for o, _ in fields.values()], "itemsize": TRACE_HEADER + 4 * ns})


def file_header(n: int, ns: int, dt: float) -> bytes:
    """The header's fields have 16 bits: longer traces or larger steps are an error; more traces than that leave the count of
    traces at 0, which readers don't need."""
    if ns > 32767 or round(dt * 1000) > 32767:
        raise ValueError(f"{ns} samples of {dt} ns do not fit the header of revision 1")
    head = bytearray(FILE_HEADER)
    head[:3200] = b"C 1 GROUND PENETRATING RADAR, COORDINATES TIMES 100".ljust(3200)
    for at, value in ((3212, n if n <= 32767 else 0), (3216, round(dt * 1000)), (3220, ns), (3224, FLOATS), (3500, 256)):
        head[at : at + 2] = int(value).to_bytes(2, "big")
    return bytes(head)


def trace_blocks(block: np.ndarray, x: np.ndarray, y: np.ndarray, dt: float, inline: np.ndarray | None = None, crossline: np.ndarray | None = None, first: int = 1, scale: int = SCALE) -> bytes:
    """The traces of block (traces x samples) with their headers, numbered from first; dt in ns, written as picoseconds. Missing samples become 0."""
    n, ns = block.shape
    rows = np.zeros(n, _layout(ns))
    rows["trace"] = rows["number"] = np.arange(first, first + n)
    rows["scale"], rows["ns"], rows["dt"] = -scale, ns, round(dt * 1000)
    rows["x"], rows["y"] = np.round(np.asarray(x) * scale), np.round(np.asarray(y) * scale)
    rows["inline"] = 0 if inline is None else inline
    rows["crossline"] = 0 if crossline is None else crossline
    rows["amp"] = np.nan_to_num(block)
    return rows.tobytes()


def encode(block: np.ndarray, x: np.ndarray, y: np.ndarray, dt: float, inline: np.ndarray | None = None, crossline: np.ndarray | None = None) -> bytes:
    """A file of the traces of block (traces x samples)."""
    return file_header(*block.shape, dt) + trace_blocks(block, x, y, dt, inline, crossline)


def files(traces: DataFrame, by: list[str], order: str, dt: float) -> DataFrame:
    """by and content: one file for each group of traces (x, y, amp), which must fit one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        block = table["amp"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        content = encode(block, table["x"].to_numpy(), table["y"].to_numpy(), dt)
        return pa.table({**{k: table[k].slice(0, 1) for k in by}, "content": pa.array([content], pa.binary())})

    rows = traces.select(*by, order, "x", "y", "amp")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by) + ", content binary"
    return rows.groupBy(*by).applyInArrow(run, schema)


def read(spark: SparkSession, folder: str, pattern: str = "*.sgy", batch: int = 4096) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def decode(batches):
        for part in batches:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                raw = content.as_buffer()
                ns = int.from_bytes(raw[3220:3222].to_pybytes(), "big")
                if int.from_bytes(raw[3224:3226].to_pybytes(), "big") != FLOATS:
                    raise ValueError(f"{path}: samples are not IEEE floats")
                layout = _layout(ns)
                found = np.frombuffer(raw, layout, (len(raw) - FILE_HEADER) // layout.itemsize, FILE_HEADER)
                for at in range(0, len(found), batch):
                    t = found[at : at + batch]
                    offsets = np.arange(len(t) + 1, dtype=np.int32) * ns
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(t)), *[pa.array(t[f].astype(np.int32)) for f in ("trace",)], pa.array(t["x"] / np.abs(t["scale"].astype(float))), pa.array(t["y"] / np.abs(t["scale"].astype(float))), pa.array(t["inline"].astype(np.int32)), pa.array(t["crossline"].astype(np.int32)), pa.array(t["dt"] / 1000), pa.ListArray.from_arrays(pa.array(offsets), pa.array(t["amp"].astype(np.float32).ravel()))],
                        names=[x.split()[0] for x in SCHEMA.split(", ")],
                    )

    return rows.mapInArrow(decode, SCHEMA)
