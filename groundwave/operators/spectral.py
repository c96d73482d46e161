"""Frequency-domain operators. Kernels are numpy functions of a block (traces x samples).

Trace-wise kernels run on Arrow batches without a shuffle; `wavenumber` runs those along traces. A missing sample
is null outside of kernels and NaN inside.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def _lists(block: np.ndarray) -> pa.Array:
    offsets = np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(block, np.float64).ravel(), from_pandas=True))


def _block(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def apply(traces: DataFrame, kernel: Kernel, amp: str = "amp") -> DataFrame:
    """kernel on every trace; traces of a batch must have one length; null traces are left out."""
    traces = traces.where(F.col(amp).isNotNull() & (F.size(amp) > 0))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                i = batch.schema.get_field_index(amp)
                yield pa.RecordBatch.from_arrays([_lists(kernel(_block(c))) if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return traces.mapInArrow(run, traces.schema)


def filled(table: pa.Table, amp: str, kernel: Kernel) -> pa.Table:
    """table with kernel on its traces in their order; a missing trace is NaN for the kernel and stays missing."""
    column = table[amp].combine_chunks() if table[amp].num_chunks != 1 else table[amp].chunk(0)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if not known.any():
        return table
    block = _block(column.filter(pa.array(known)))
    every = np.full((len(known), block.shape[1]), np.nan)
    every[known] = block
    places = pa.array(np.where(known, np.arange(len(known)), 0), mask=~known)
    return table.set_column(table.schema.get_field_index(amp), amp, _lists(kernel(every)).take(places))


def amplitude_spectrum(block: np.ndarray) -> np.ndarray:
    """2 |FFT| / n up to the Nyquist frequency, n being the next power of two."""
    n = 1 << (block.shape[1] - 1).bit_length()
    return 2 * np.abs(np.fft.rfft(block, n)) / block.shape[1]


def envelope(block: np.ndarray) -> np.ndarray:
    n = block.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(block) * h))


@lru_cache(64)
def fir_magnitude(n: int, corners: tuple[float, ...]) -> np.ndarray:
    """Magnitudes at the n/2+1 frequencies of a linear-phase filter of n taps (n even) that passes from corners[1] to corners[2].

    Corners are shares of the highest frequency. The wished response, a line from corner to corner, is sampled on a
    grid, transformed, cut to n taps around the middle, and smoothed by a Hamming window. A jump is spread over 0.05.
    """
    at = np.clip(corners, 0, 1)
    if (np.diff(at) < 0).any():
        raise ValueError(f"the corners of the pass band are not in order: {corners}")
    jump = np.flatnonzero(np.diff(at) == 0)
    at[jump], at[jump + 1] = at[jump] - 0.025, at[jump + 1] + 0.025
    at = np.maximum.accumulate(np.clip(at, 0, 1))
    grid = 512 if n <= 1024 else 1 << (n - 1).bit_length()
    wish = np.interp(np.linspace(0, 1, grid + 1), at, (0, 1, 1, 0))
    taps = np.roll(np.fft.irfft(wish, 2 * grid), n // 2)[:n] * np.hamming(n)
    return np.abs(np.fft.rfft(taps))


def bandpass(dt: float, low: float, high: float) -> Kernel:
    """Zero-phase band-pass; dt in ns, corners in MHz. The lower slope is an eighth of the band wide and begins at 1 Hz at
    least, the upper one is a quarter wide. Traces are padded by their length."""
    width, top = high - low, 500 / dt
    corners = tuple(f / top for f in (max(1e-6, low - width / 4, low - width / 8), low, high, high + width / 4))

    def kernel(block):
        n = block.shape[1]
        return np.fft.irfft(np.fft.rfft(block, 2 * n) * fir_magnitude(2 * n, corners), 2 * n)[:, :n]

    return kernel


def autocorrelation_spectrum(block: np.ndarray) -> np.ndarray:
    """|FFT| / L of each trace's autocorrelation, which is 1 at lag 0; L: samples, n: the next power of two. The transform takes
    the first n of the 2 L - 1 lags, from -(L - 1) on. A trace of zeros gives zeros."""
    samples = block.shape[1]
    n = 1 << (samples - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(block, 2 * n)) ** 2, 2 * n)
    energy = r[:, :1]
    r = np.divide(r, energy, out=np.zeros_like(r), where=energy > 0)
    lags = np.concatenate((r[:, samples - 1 : 0 : -1], r[:, :samples]), axis=1)
    return np.abs(np.fft.rfft(lags[:, :n], n)) / samples


def whitened(traces: DataFrame, by: list[str], dt: float, low: float, high: float, alpha: float, amp: str = "amp") -> DataFrame:
    """Spectra over the number of samples, times A^(alpha-1) and over sqrt(alpha), A being the mean spectrum of the group's
    autocorrelations; then the band-pass. Traces are padded to a power of two and cut again.

    The mean spectrum is a grouped sum that joins back to the traces, so a group may be of any size.
    """
    from .channel import sample_stats

    traces = traces.where(F.col(amp).isNotNull()).withColumn(amp, F.col(amp).cast("array<double>"))
    level = sample_stats(apply(traces.select(*by, amp), autocorrelation_spectrum, amp), by, amp).select(*by, F.col("mean").alias("_level"))
    rows, band = traces.join(level, by), bandpass(dt, low, high)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                block, a = _block(batch.column(amp)), _block(batch.column("_level"))
                samples, n = block.shape[1], 2 * (a.shape[1] - 1)
                out = np.fft.irfft(np.fft.rfft(block, n) / samples * np.where(a == 0, 1, a) ** (alpha - 1), n)[:, :samples] / np.sqrt(alpha)
                yield pa.RecordBatch.from_arrays([_lists(band(out)) if c == amp else batch.column(c) for c in names], names=names)

    names = rows.drop("_level").columns
    return rows.mapInArrow(run, rows.drop("_level").schema)


def k_highpass(dx: float, cut: float) -> Kernel:
    """High-pass along traces: slopes from half the cut to the cut and over the last 0.55 below the highest wavenumber. Missing
    samples count as 0 and stay missing. The trace line is a ring, as it is not padded (but to an even number)."""
    top = 0.5 / dx * 0.9999
    corners = tuple(2 * dx * k for k in (cut / 2, cut, top - 0.55, top))

    def kernel(block):
        gone, n = np.isnan(block), len(block) + len(block) % 2
        response = fir_magnitude(n, corners)[:, None]
        out = np.fft.irfft(np.fft.rfft(np.where(gone, 0, block), n, axis=0) * response, n, axis=0)[: len(block)]
        return np.where(gone, np.nan, out)

    return kernel


def _aligned(a: np.ndarray, ref: np.ndarray) -> np.ndarray:
    n = len(a)
    r = np.correlate(a, ref[:n], "full")  # index n-1 is lag 0
    at = n - 1
    while at + 1 < len(r) and r[at] <= r[at + 1]:
        at += 1
    down = n - 1
    while down > 0 and r[down] <= r[down - 1]:
        down -= 1
    lag = (at if at != n - 1 else down) - (n - 1)
    out = np.zeros(n)
    if lag >= 0:
        out[: n - lag] = a[lag:]
    else:
        out[-lag:] = a[: n + lag]
    return out


def align_to(reference: list[float]) -> Kernel:
    """Each trace shifted by the lag at which it fits the reference best, climbing from lag 0: to the hill on the side
    of traces that come late, or, if there is none, of those that come early; zeros are shifted in."""
    ref = np.asarray(reference)
    return lambda block: np.array([_aligned(a, ref) for a in block]).reshape(block.shape)


def align_to_column(traces: DataFrame, reference: str, amp: str = "amp") -> DataFrame:
    """align_to for traces that carry their reference in a column, which goes."""
    traces = traces.where(F.col(amp).isNotNull() & F.col(reference).isNotNull()).withColumn(reference, F.col(reference).cast("array<double>"))
    names = [c for c in traces.columns if c != reference]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                moved = np.array([_aligned(a, b) for a, b in zip(_block(batch.column(amp)), _block(batch.column(reference)), strict=True)])
                yield pa.RecordBatch.from_arrays([_lists(moved) if c == amp else batch.column(c) for c in names], names=names)

    return traces.mapInArrow(run, traces.drop(reference).schema)


def spline(ns: int, step: float) -> Kernel:
    """Samples at 0, step, 2 step, ... of the cubic spline through ns samples whose third derivative is continuous at the second and the last but one.

    Splines are linear in their samples, so the kernel is one matrix, made once.
    """
    at = np.arange(0, ns - 1 + 1e-9, step)
    if ns < 4:  # the polynomial through all samples
        x = np.arange(ns)
        powers = x[:, None].astype(float) ** x
        matrix = (at[:, None] ** x) @ np.linalg.inv(powers)
    else:
        # second derivatives m of unit samples: m[i-1] + 4 m[i] + m[i+1] = 6 (y[i-1] - 2 y[i] + y[i+1])
        left, right = np.zeros((ns, ns)), np.zeros((ns, ns))
        for i in range(1, ns - 1):
            left[i, i - 1 : i + 2] = 1, 4, 1
            right[i, i - 1 : i + 2] = 6, -12, 6
        left[0, :3] = left[-1, -3:] = 1, -2, 1
        m = np.linalg.solve(left, right)
        i = np.minimum(at.astype(int), ns - 2)
        u = (at - i)[:, None]
        unit = np.eye(ns)
        matrix = (1 - u) * unit[i] + u * unit[i + 1] + ((1 - u) ** 3 - (1 - u)) / 6 * m[i] + (u**3 - u) / 6 * m[i + 1]
    return lambda block: block @ matrix.T
