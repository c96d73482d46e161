"""Filters over wavenumbers that no task needs a whole profile or image for.

A transform over one axis is independent for every place on the other, so data is dealt by blocks of the other axis,
transformed, and dealt back: samples in blocks for filters along traces, columns of the spectrum in blocks for images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import in_polygon
from .spectral import Kernel, _block, _lists

#: Numbers that a block of an image's spectrum has at most, unless one column has more.
BLOCK = 1 << 18


def along_traces(traces: DataFrame, by: str | list[str], order: str, kernel: Kernel, amp: str = "amp", width: int = 16) -> DataFrame:
    """kernel over the traces of a group in order, for kernels that treat every sample of a trace alone. A missing trace is NaN
    for the kernel and stays missing; other columns stay as they are. A task holds `width` samples of each trace of a group."""
    by = [by] if isinstance(by, str) else by
    columns = traces.columns
    keys = [f"_by{i}" for i in range(len(by))]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns if c != amp])
    rows = traces.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(order).alias("_order"), F.col(amp).cast("array<double>").alias("_amp"), whole.alias("_row"))
    line = W.partitionBy(*keys)
    rows = rows.withColumns({"_t": F.row_number().over(line.orderBy("_order")) - 1, "_n": F.count("*").over(line)})
    starts = F.sequence(F.lit(0), F.size("_amp") - 1, F.lit(width))
    # the first block carries the other columns
    cut = rows.where(F.size("_amp") > 0).select(*keys, "_t", "_n", "_row", F.posexplode(F.transform(starts, lambda i: F.slice("_amp", i + 1, width))).alias("_b", "_part"))
    cut = cut.withColumn("_row", F.when(F.col("_b") == 0, F.col("_row")))

    def run(table: pa.Table) -> pa.Table:
        part = table["_part"].combine_chunks()
        block = _block(part)
        line = np.full((int(table["_n"][0].as_py()), block.shape[1]), np.nan)
        at = table["_t"].to_numpy()
        line[at] = block
        return table.set_column(table.schema.get_field_index("_part"), "_part", _lists(kernel(line)[at]))

    done = cut.groupBy(*keys, "_b").applyInArrow(run, cut.schema)
    joined = done.groupBy(*keys, "_t").agg(F.array_sort(F.collect_list(F.struct("_b", "_part"))).alias("_parts"), F.first("_row", True).alias("_row"))
    kept = joined.select("_row", F.flatten(F.transform("_parts", lambda p: p["_part"])).alias("_amp"))
    out = kept.unionByName(rows.where(F.col("_amp").isNull() | (F.size("_amp") == 0)).select("_row", "_amp"))
    return out.select(*[F.col("_amp").alias(c) if c == amp else F.col("_row")[c].alias(c) for c in columns])


def pie_mask(kx: np.ndarray, ky: np.ndarray, angle: float, opening: float) -> np.ndarray:
    """Factors at wavenumbers ky (rows) and kx (columns): 0.5 + 0.5 cos(360 / opening (a - least)) where a, the angle of
    kx / ky in degrees, lies within half the opening of angle, from least on; 1 elsewhere and at wavenumber 0. So the middle of
    the wedge goes and its edges stay. The largest ky stands for both signs: the mean of both counts, as the image is real."""
    if (ky == -0.5).any():
        high = ky == -0.5
        out = np.ones((len(ky), len(kx)))
        out[~high] = pie_mask(kx, ky[~high], angle, opening)
        out[high] = (pie_mask(np.abs(kx), np.array([0.5]), angle, opening) + pie_mask(np.where(kx == -0.5, 0.5, -kx), np.array([0.5]), angle, opening)) / 2  # kx is at least 0 but for the largest
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.degrees(np.arctan(kx[None, :] / np.abs(ky[:, None])) * np.where(ky[:, None] < 0, -1, 1))
    least, out = angle - opening / 2, np.ones(a.shape)
    for turn in (180, -180, 0):  # a direction has two angles
        at = a + turn - least
        with np.errstate(invalid="ignore"):
            wedge = (at >= 0) & (at <= opening)
        out[wedge] = 0.5 + 0.5 * np.cos(2 * np.pi / opening * at[wedge])
    return out


def _power(n: int) -> int:
    return max(2, 1 << (int(n) - 1).bit_length())


def _rows_to_blocks(batches):
    """part, slice, iy, block, re, im: the transform along x of each image row, in blocks of columns."""
    names = ["part", "slice", "iy", "nx", "ny", "block", "re", "im"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(lo, 64).to_pylist():
                line = np.zeros(_power(r["nx"]))
                for c in r["line"]:
                    line[c["x"]] += c["v"]
                spectrum = np.fft.rfft(line)
                width = max(1, BLOCK // _power(r["ny"]))
                for b in range(0, len(spectrum), width):
                    part = spectrum[b : b + width]
                    out.append((r["part"], r["slice"], r["iy"], r["nx"], r["ny"], b // width, part.real.tolist(), part.imag.tolist()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _filter_columns(angles: list[float], opening: float):
    def run(table: pa.Table) -> pa.Table:
        nx, ny, block, part = (int(table[c][0].as_py()) for c in ("nx", "ny", "block", "part"))
        wide, high = _power(nx), _power(ny)
        iy = table["iy"].to_numpy()
        re, im = _block(table["re"].combine_chunks()), _block(table["im"].combine_chunks())
        image = np.zeros((high, re.shape[1]), complex)
        image[iy] = re + 1j * im
        width = max(1, BLOCK // high)
        kx = np.arange(block * width, block * width + re.shape[1]) / wide
        kx = np.where(kx == 0.5, -0.5, kx)
        image = np.fft.ifft(np.fft.fft(image, axis=0) * pie_mask(kx, np.fft.fftfreq(high), angles[part], opening), axis=0)[iy]
        table = table.set_column(table.schema.get_field_index("re"), "re", _lists(image.real))
        return table.set_column(table.schema.get_field_index("im"), "im", _lists(image.imag))

    return run


def _blocks_to_rows(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            lines = []
            for r in part.to_pylist():
                blocks = sorted(r["blocks"], key=lambda b: b["block"])
                spectrum = np.concatenate([b["re"] for b in blocks]) + 1j * np.concatenate([b["im"] for b in blocks])
                lines.append(np.fft.irfft(spectrum, _power(r["nx"]))[: r["nx"]].tolist())
            yield pa.RecordBatch.from_arrays([part.column("part"), part.column("slice"), part.column("iy"), pa.array(lines, pa.list_(pa.float64()))], names=["part", "slice", "iy", "row"])


def pie_slices(cells: DataFrame, opening: float, angle: float = 0.0, polygons: list[tuple[list[tuple[float, float]], float]] | None = None, ix: str = "ix", iy: str = "iy", v: str = "v") -> DataFrame:
    """Cells (slice, ix, iy, v) whose v is without the wavenumbers of a wedge around angle (0 is along ix, 90 along iy).

    polygons: (corners, angle) of parts; each part's image, 0 outside of it, is filtered by its own angle; where parts overlap the
    last one counts; cells in none stay as they are. The image of a slice spans all cells and is padded with zeros to powers of two; empty
    cells count as 0 and stay empty, null values likewise. One pass transforms rows, one columns in blocks, one brings rows back: a task
    holds a row or a block of columns.
    """
    parts = polygons or [(None, angle)]
    kept = cells.select(F.col("slice").cast("long").alias("slice"), F.col(ix).cast("long").alias("_ix"), F.col(iy).cast("long").alias("_iy"), F.col(v).cast("double").alias("_v"))
    of = [F.when(in_polygon(F.col("_ix").cast("double"), F.col("_iy").cast("double"), ring) if ring else F.lit(True), F.lit(i)) for i, (ring, _) in enumerate(parts)]
    kept = kept.withColumn("_parts", F.array_compact(F.array(*of)))
    bounds = kept.agg(F.min("_ix").alias("_x0"), (F.max("_ix") - F.min("_ix") + 1).alias("nx"), F.min("_iy").alias("_y0"), (F.max("_iy") - F.min("_iy") + 1).alias("ny"))
    kept = kept.crossJoin(F.broadcast(bounds))  # one row
    each = kept.select(F.explode("_parts").alias("part"), "slice", (F.col("_iy") - F.col("_y0")).alias("iy"), "nx", "ny", F.struct((F.col("_ix") - F.col("_x0")).alias("x"), F.coalesce("_v", F.lit(0.0)).alias("v")).alias("cell"))
    lines = each.groupBy("part", "slice", "iy").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.collect_list("cell").alias("line"))
    blocks = lines.mapInArrow(_rows_to_blocks, "part int, slice long, iy long, nx long, ny long, block int, re array<double>, im array<double>")
    blocks = blocks.groupBy("part", "slice", "block").applyInArrow(_filter_columns([a for _, a in parts], opening), blocks.schema)
    rows = blocks.groupBy("part", "slice", "iy").agg(F.first("nx").alias("nx"), F.collect_list(F.struct("block", "re", "im")).alias("blocks"))
    rows = rows.mapInArrow(_blocks_to_rows, "part int, slice long, iy long, row array<double>")
    kept = kept.withColumns({"part": F.try_element_at("_parts", F.lit(-1)), "iy": F.col("_iy") - F.col("_y0")})
    out = kept.join(rows, ["part", "slice", "iy"], "left")
    new = F.when(F.col("_v").isNotNull(), F.coalesce(F.get("row", (F.col("_ix") - F.col("_x0")).cast("int")), F.col("_v")))
    return out.select("slice", F.col("_ix").alias(ix), F.col("_iy").alias(iy), new.alias(v))
