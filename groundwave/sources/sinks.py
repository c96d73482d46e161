"""Sinks: SEG-Y files of profiles or grid blocks, profile lines as GeoJSON, images of slices with world files."""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import segy
from .ranged import store

#: Bytes that are copied at a time.
_COPY = 8 << 20


def write_files(named: DataFrame, folder: str) -> DataFrame:
    """(name, bytes) of the rows (name, content), written to folder by the tasks that hold them.

    A file comes into being under a name of its own and is then renamed, so a repeated task replaces
    it and a lost one leaves no half file. folder is a URI or path that all executors reach.
    """

    return _write(named, folder, [])


def _shared(rows: DataFrame, folder: str) -> None:
    if not re.match(r"\w[\w+.-]*:/", folder) and not re.match(r"local(\[|$)", rows.sparkSession.sparkContext.master):
        raise ValueError(f"{folder} has no scheme: executors would write to their own disks")


def _write(named: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """write_files with columns of named in front."""
    _shared(named, folder)

    def run(batches):
        target, base = store(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for i, (name, content) in enumerate(zip(batch.column("name").to_pylist(), batch.column("content"), strict=True)):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with target.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                target.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in keep], pa.array([name]), pa.array([len(content.as_buffer())], pa.int64())], names=[*keep, "name", "bytes"])

    kinds = [f"{k} {named.schema[k].dataType.simpleString()}" for k in keep]
    return named.select(*keep, "name", "content").mapInArrow(run, ", ".join([*kinds, "name string", "bytes long"]))


def write_segy(traces: DataFrame, folder: str, by: list[str], order: str, dt: float) -> DataFrame:
    """A SEG-Y file for each group (x, y, amp), named by its keys; the rows say what was written."""
    name = F.concat(F.concat_ws("_", *[F.col(k).cast("string") for k in by]), F.lit(".sgy"))
    return write_files(segy.files(traces, by, order, dt).select(name.alias("name"), "content"), folder)


def write_segy_parts(traces: DataFrame, folder: str, by: list[str], order: str, dt: float, part_bytes: int = 64 << 20, offset: bool = False) -> DataFrame:
    """(name, bytes): a SEG-Y file for each group (x, y, amp) of any size, and a text beside it that describes it.

    Traces are numbered along their group and dealt to parts of about part_bytes, each written by a task that holds only that; one
    task a file then copies the parts behind the header, a few MB at a time, and renames the file when it is whole. Parts carry the
    run's own name and go when their file is there, so a repeated task writes the same and a lost one leaves no half file.
    offset: coordinates are relative to those of the first trace rounded to 1000 m, which stand in inline and crossline, and have mm.
    All traces of a group must be equally long; a null trace is zeros, a null coordinate 0.
    """
    _shared(traces, folder)
    run = uuid.uuid4().hex
    line = W.partitionBy(*by).orderBy(order)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    name = F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in by])
    rows = traces.select(*by, order, F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), F.col("amp").cast("array<float>").alias("amp"), name.alias("name"))
    rows = rows.withColumns({"number": F.row_number().over(line).cast("long"), "ns": F.max(F.size("amp")).over(W.partitionBy(*by)).cast("long")})
    rows = rows.withColumns({c: (F.floor(F.first(v).over(whole) / 1000 + 0.5) * 1000 if offset else F.lit(0)).cast("long") for c, v in (("off_x", "x"), ("off_y", "y"))})
    step = F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line))
    rows = rows.withColumns({"step": step, "part": F.floor((F.col("number") - 1) / F.greatest(F.lit(1), F.floor(F.lit(part_bytes) / (segy.TRACE_HEADER + 4 * F.col("ns")))))})

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("number").combine_chunks()
        ns, n = table["ns"][0].as_py(), table.num_rows
        amp = np.array([a if a is not None else [0.0] * ns for a in table["amp"].to_pylist()], np.float32).reshape(n, ns)
        x, y = table["x"].to_numpy() - table["off_x"].to_numpy(), table["y"].to_numpy() - table["off_y"].to_numpy()
        inline, crossline = (table["off_x"].to_numpy(), table["off_y"].to_numpy()) if offset else (None, None)
        content = segy.trace_blocks(amp, x, y, dt, inline, crossline, table["number"][0].as_py(), 1000 if offset else segy.SCALE)
        part = table["part"][0].as_py()
        return pa.table({"file": [table["name"][0].as_py()], "part": pa.array([part], pa.int64()), "name": [f".{table['name'][0].as_py()}.{run}.{part:09d}"], "content": pa.array([content], pa.binary())})

    written = _write(rows.groupBy("name", "part").applyInArrow(block, "file string, part long, name string, content binary"), folder, ["file", "part"])
    parts = written.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "name"))).alias("parts"))
    facts = rows.groupBy("name").agg(
        F.count("*").alias("n"), F.first("ns").alias("ns"), F.min(F.struct("number", "x", "y")).alias("a"), F.max(F.struct("number", "x", "y")).alias("b"), F.avg("step").alias("mean"), F.sum("step").alias("length"),
    )

    def join(batches):
        target, base = store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                half = f"{base}/.{r['file']}.{run}.whole"
                with target.open_output_stream(half) as out:
                    out.write(segy.file_header(r["n"], r["ns"], dt))
                    for p in r["parts"]:
                        with target.open_input_stream(f"{base}/{p['name']}") as part:
                            while data := part.read(_COPY):
                                out.write(data)
                target.move(half, f"{base}/{r['file']}.sgy")
                unit = "reduced x and y in mm, offsets in m in inline and crossline" if offset else "x and y in cm"
                text = f"dt {dt:.4f} ns\nns {r['ns']}\nntraces {r['n']}\nx_start {r['a']['x']:.2f} m\nx_end {r['b']['x']:.2f} m\ny_start {r['a']['y']:.2f} m\ny_end {r['b']['y']:.2f} m\n"
                text += f"mean_trace_spacing {r['mean'] or 0:.4f} m\nlength_of_profile {r['length'] or 0:.2f} m\n{unit}\n"
                with target.open_output_stream(f"{base}/{r['file']}.txt") as out:
                    out.write(text.encode())
                size = segy.FILE_HEADER + r["n"] * (segy.TRACE_HEADER + 4 * r["ns"])
                yield pa.RecordBatch.from_arrays([pa.array([r["file"] + ".sgy"]), pa.array([size], pa.int64()), pa.array([[p["name"] for p in r["parts"]]], pa.list_(pa.string()))], names=["name", "bytes", "parts"])

    joined = facts.withColumnRenamed("name", "file").join(parts, "file").mapInArrow(join, "name string, bytes long, parts array<string>")
    done = joined.collect()  # a row for each file; parts go only when all files are there, so a repeated task finds them
    target, base = store(folder)
    for r in done:
        for p in r["parts"]:
            target.delete_file(f"{base}/{p}")
    return traces.sparkSession.createDataFrame([(r["name"], r["bytes"]) for r in done], "name string, bytes long")


def write_segy_block(cells: DataFrame, folder: str, dt: float, lines: int = 64) -> DataFrame:
    """Grid cells (ix, iy, x, y, amp) as SEG-Y with inline iy + 1 and crossline ix + 1, a file for every `lines` inlines, so that no task holds the whole block. Null traces become zeros of the block's length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("iy", "ascending"), ("ix", "ascending")])
        ix, iy = table["ix"].to_numpy(), table["iy"].to_numpy()
        amp = table["amp"].to_pylist()
        ns = max((len(a) for a in amp if a is not None), default=0)
        block = np.array([a if a is not None else [0.0] * ns for a in amp], np.float64).reshape(len(amp), ns)
        content = segy.encode(block, table["x"].to_numpy(), table["y"].to_numpy(), dt, iy + 1, ix + 1)
        return pa.table({"name": [f"block_{table['part'][0].as_py():05d}.sgy"], "content": pa.array([content], pa.binary())})

    rows = cells.select((F.floor(F.col("iy") / lines)).alias("part"), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), "x", "y", "amp")
    return write_files(rows.groupBy("part").applyInArrow(run, "name string, content binary"), folder)


def lines_geojson(tracks: DataFrame, by: str, order: str, epsg: int, x: str = "x", y: str = "y") -> DataFrame:
    """(by, feature): a GeoJSON LineString feature for each profile, its points in order; a profile must fit one row."""
    points = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(x).alias("x"), F.col(y).alias("y")))), lambda p: F.array(p["x"], p["y"]))
    rows = tracks.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(points.alias("p"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"EPSG:{epsg}").alias("name")).alias("properties"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("p").alias("coordinates"))
    return rows.select(by, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.col(by).alias("ids"), crs.alias("crs"))).alias("feature"))


def world_file(x_min: Column, y_max: Column, dx: float, transform: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)) -> Column:
    """The six lines of a world file of an image with cells dx wide, its first cell at (x_min, y_max), under the similarity (a, b, tx, ty): X = a x - b y + tx, Y = b x + a y + ty."""
    a, b, tx, ty = transform
    numbers = [F.lit(a * dx), F.lit(b * dx), F.lit(b * dx), F.lit(-a * dx), a * x_min - b * y_max + tx, b * x_min + a * y_max + ty]
    return F.concat_ws("\n", *[n.cast("double").cast("string") for n in numbers])


def png(grey: np.ndarray, alpha: np.ndarray) -> bytes:
    """An image of 8-bit grey with alpha, row by row from the top."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = grey.shape
    rows = np.zeros((height, 1 + 2 * width), np.uint8)
    rows[:, 1::2], rows[:, 2::2] = grey, alpha
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_images(slices: DataFrame, folder: str, low: float, high: float, dx: float, start: tuple[float, float] = (0.0, 0.0), transform: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0), tile: int = 1024) -> DataFrame:
    """Slices (slice, ix, iy, v) as images of at most tile x tile cells, black at low and white at high, each with its world file; cells without a value are clear.

    start is the centre of cell (0, 0) before transform (see world_file). A task holds one image.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, tx, ty = (int(k.as_py()) for k in key)
        x, y, v = (table[c].to_numpy() for c in ("ix", "iy", "v"))
        grey, alpha = np.zeros((tile, tile), np.uint8), np.zeros((tile, tile), np.uint8)
        at = (tile - 1 - (y - ty * tile), x - tx * tile)
        grey[at], alpha[at] = np.clip(np.round((v - low) / (high - low) * 255), 0, 255).astype(np.uint8), 255
        return pa.table({"name": [f"slice_{n:05d}_{tx}_{ty}"], "tx": pa.array([tx], pa.int64()), "ty": pa.array([ty], pa.int64()), "image": pa.array([png(grey, alpha)], pa.binary())})

    cell = lambda c: F.floor(F.col(c) / tile).alias("t" + c[1])
    rows = slices.where(F.col("v").isNotNull() & ~F.isnan("v")).select(F.col("slice").cast("long").alias("slice"), cell("ix"), cell("iy"), *[F.col(c).cast("long").alias(c) for c in ("ix", "iy")], F.col("v").cast("double").alias("v"))
    images = rows.groupBy("slice", "tx", "ty").applyInArrow(run, "name string, tx long, ty long, image binary")
    world = world_file(start[0] + F.col("tx") * tile * dx, start[1] + ((F.col("ty") + 1) * tile - 1) * dx, dx, transform)
    files = F.array(F.struct(F.concat("name", F.lit(".png")).alias("name"), F.col("image").alias("content")), F.struct(F.concat("name", F.lit(".pgw")).alias("name"), F.encode(world, "utf-8").alias("content")))
    return write_files(images.select(F.explode(files).alias("f")).select("f.*"), folder)


def write_lists(rows: DataFrame, folder: str, by: str, order: str, columns: list[str], head: str | None = None, suffix: str = ".pos", decimals: int = 4) -> DataFrame:
    """A text file for each group: a line of tab-separated numbers for each row, in order, below `head`. Position logs, coordinates and the like; a group is one file, so it must fit one row."""
    number = lambda c: F.format_string(f"%.{decimals}f", F.col(c).cast("double")) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
    line = F.concat_ws("\t", *[F.when(F.col(c).isNull(), "NaN").otherwise(number(c)) for c in columns])
    lines = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    text = F.concat(F.array_join(F.concat(F.array(F.lit(head)) if head else F.array().cast("array<string>"), F.transform("x", lambda r: r["l"])), "\n"), F.lit("\n"))
    return write_files(lines.select(F.concat(F.col(by).cast("string"), F.lit(suffix)).alias("name"), F.encode(text, "utf-8").alias("content")), folder)


def write_dzg(fixes: DataFrame, folder: str, by: str = "profile") -> DataFrame:
    """A log for each group of fixes (by, trace, lat, lon, z, quality): pairs of a trace line and a GGA line, that `gps.read_dzg` reads."""

    def angle(c: str, width: int, marks: str):
        degrees = F.abs(F.col(c))
        minutes = F.format_string("%09.6f", (degrees - F.floor(degrees)) * 60)
        return F.concat(F.lpad(F.floor(degrees).cast("string"), width, "0"), minutes, F.lit(","), F.when(F.col(c) < 0, marks[1]).otherwise(marks[0]))

    gga = F.concat(F.lit("$GPGGA,000000,"), angle("lat", 2, "NS"), F.lit(","), angle("lon", 3, "EW"), F.format_string(",%d,8,1,%.3f,M,0,M,,", F.col("quality").cast("int"), F.col("z").cast("double")))
    pair = F.concat(F.lit("$GSSIS,"), F.col("trace").cast("string"), F.lit(",0\n"), gga, F.lit("\n"))
    files = fixes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("trace", pair.alias("l")))).alias("x"))
    return write_files(files.select(F.concat(F.col(by).cast("string"), F.lit(".DZG")).alias("name"), F.encode(F.array_join(F.transform("x", lambda r: r["l"]), ""), "utf-8").alias("content")), folder)
