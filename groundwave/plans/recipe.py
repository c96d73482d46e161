"""Processing recipes: settings text to an ordered list of steps, applied as lazy DataFrame transformations.

A line is `key value...`; a key that begins with do_ names a step, its value is the step's place (0: off), and the
lines below it are its parameters. Keys may carry a unit, as tmax[ns], and are known by the usual names of profile and
radargram settings; values are numbers, texts or several numbers. A step takes a parameter that it lacks from those above all
steps, and from another step only where SHARED says so. Places must be 1..n, each once.

Every step has a scope: what it looks at besides the trace itself. Making the plan starts no job: what a step has to know of the whole
survey is a table of one row that is joined. Neighbouring steps of scope `trace` become one: expressions by Spark, transforms by being chained in
one pass over Arrow batches. Neighbouring steps of scope `channel` that are windows share one exchange.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import channel, grid, kernels, position, spectral, surface, trace, track, wavenumber

#: What a step looks at besides the trace itself.
SCOPES = ("trace", "channel", "profile", "survey")


class Step(NamedTuple):
    """run(traces, parameters, dt, ns) gives traces with profile, channel, trace and amp; kernel(parameters, dt, ns) is a transform of each trace that stands for run, or None."""

    scope: str
    run: Callable
    kernel: Callable = lambda p, dt, ns: None


STEPS: dict[str, Step] = {}
#: (step, parameter): the step that it may come from if it is not given.
SHARED = {("do_khighpass", "dx"): "do_constTraceDist", ("do_migration2d_vz", "dx"): "do_constTraceDist"}


class Parameters(dict):
    """A step's parameters; one that is needed and not there is an error that names both."""

    def __init__(self, step: str, values: dict):
        super().__init__(values)
        self.step = step

    def __missing__(self, key):
        raise ValueError(f"{self.step} needs {key}")


def step(name: str, scope: str):
    def add(f):
        STEPS[name] = Step(scope, f)
        return f

    return add


def on_amp(name: str, expression: Callable):
    STEPS[name] = Step("trace", lambda df, p, dt, ns: df.withColumn("amp", expression(F.col("amp"), p, dt, ns)))


def on_block(name: str, kernel: Callable, otherwise: Callable | None = None):
    STEPS[name] = Step("trace", otherwise, kernel)


on_amp("do_amplitudeOffset", lambda a, p, dt, ns: trace.dc_removal(a, dt, p["tstart"], p["tend"], ns))
on_amp("do_medfilt", lambda a, p, dt, ns: trace.median_filter(a, int(p["numsamp"]) | 1))
on_amp("do_sphericalDivergence", lambda a, p, dt, ns: trace.spherical_divergence(a, dt))
on_amp("do_attenuationCorrection", lambda a, p, dt, ns: trace.attenuation(a, dt, p["sigma"], p["eps"]))
on_amp("do_cutTWT", lambda a, p, dt, ns: trace.cut_time(a, dt, p["tmax"]))
on_amp("do_normalization", lambda a, p, dt, ns: trace.normalize(a, p["qclip"]))
on_amp("do_t0shift", lambda a, p, dt, ns: trace.t0_shift(a, dt, p["t0s"]))
on_amp("do_t0CorrectionThreshold", lambda a, p, dt, ns: trace.t0_threshold(a, p["threshold"]))
on_amp("do_applygain", lambda a, p, dt, ns: trace.gain(a, trace.gain_curve([p[f"g{i}"] for i in range(1, 6)], ns)))


# every n-th sample; n under 1: samples at steps of n from a cubic spline
on_block("do_reduceNumberOfSamples", lambda p, dt, ns: spectral.spline(ns, p["n"]) if p["n"] < 1 else None, lambda df, p, dt, ns: df.withColumn("amp", trace.decimate(F.col("amp"), int(p["n"]))))
on_block("do_bandpass", lambda p, dt, ns: spectral.bandpass(dt, p["fstart"], p["fend"]))
on_block("do_makeAmpSpec", lambda p, dt, ns: spectral.amplitude_spectrum)
on_block("do_Envelope", lambda p, dt, ns: spectral.envelope)


@step("do_badTraceRemoval", "channel")
def bad_traces(df, p, dt, ns):
    return channel.replace_bad(df, ["profile", "channel"], "trace", p["minfactor"], p["maxfactor"]).drop("bad")


@step("do_traceInterpolation", "channel")
def fill(df, p, dt, ns):
    return track.interpolate(df, ["profile", "channel"], "trace", "amp", gap=p["gap"], arrays=True, edges="line")


@step("do_removeMeanMedianTrace", "channel")
def background(df, p, dt, ns):
    """meanmedian 1 (as if it is not given): the mean trace, else the median trace."""
    if p.get("meanmedian", 1) != 1:
        if p.get("numtraces", 0):
            return channel.remove_moving_median(df, ["profile", "channel"], "trace", int(p["numtraces"]) | 1)
        return channel.remove_median_background(df, ["profile", "channel"])
    if p.get("numtraces", 0):
        return channel.remove_moving_background(df, ["profile", "channel"], "trace", int(p["numtraces"]) | 1)
    return channel.remove_background(df, ["profile", "channel"])


@step("do_medfilt_x", "channel")
def median_of_traces(df, p, dt, ns):
    return position.median_of_traces(df, ["profile", "channel"], "trace", int(p["numsamp_x"]) | 1, math.ceil(p.get("tstart_x", 0) / dt))


@step("do_spectralWhitening", "channel")
def whitening(df, p, dt, ns):
    return spectral.whitened(df, ["profile", "channel"], dt, p["fmin"], p["fmax"], p["alpha"])


@step("do_khighpass", "channel")
def k_highpass(df, p, dt, ns):
    return wavenumber.along_traces(df, ["profile", "channel"], "trace", spectral.k_highpass(p["dx"], p["kcutoff"]))


@step("do_constTraceDist", "profile")
def constant_spacing(df, p, dt, ns):
    """Mean traces of steps of dx along the profile (column inline, or the way along x and y). Steps run from 0 to the last edge, which
    belongs to the step before it; a step without a trace is a missing trace. Places are means, and follow a line through
    the steps beside where there are none. All channels of a profile get the steps that every one of them has."""
    keys, dx = ["profile", "channel"], p["dx"]
    places = [c for c in ("x", "y", "z") if c in df.columns]
    if "inline" not in df.columns:
        df = track.inline_distance(df, keys, ["trace"])
    edges = df.groupBy(*keys).agg(F.max("inline").alias("_max")).withColumn("_n", (F.floor(F.col("_max") / dx + 1e-9) + 1).cast("int"))
    rows = df.join(edges.select(*keys, "_n"), keys)
    at = F.floor(F.col("inline") / dx + 1e-9).cast("int") + 1
    rows = rows.withColumn("trace", F.when((at == F.col("_n")) & (F.abs(F.col("inline") - (F.col("_n") - 1) * dx) <= 1e-9 * dx), at - 1).otherwise(at)).where("trace < _n")
    means = grid.mean_trace_of_cells(rows, [*keys, "trace"])
    if places:
        means = means.join(rows.groupBy(*keys, "trace").agg(*[F.avg(c).alias(c) for c in places]), [*keys, "trace"])
    steps = edges.withColumn("_n", F.min("_n").over(W.partitionBy("profile"))).select(*keys, F.explode(F.sequence(F.lit(1), "_n")).alias("trace"))
    out = steps.join(means, [*keys, "trace"], "left")
    for c in places:
        out = track.interpolate(out, keys, "trace", c, edges="line")
    return out.withColumn("inline", (F.col("trace") - 1) * dx)


@step("do_channelshift", "survey")
def channel_shift(df, p, dt, ns):
    """Channels moved to fit channel 1. OneOrAll 1: by the given shiftsamples (one for each channel), or by those found on the reference
    profile; 2: by those found on each profile. Without OneOrAll: on the reference profile, if one is given (not 0), else on all together."""
    given, one, profile = p.get("shiftsamples", []), p.get("OneOrAll"), p.get("refprofile", 0)
    if one == 2:
        means = channel.sample_stats(df, ["profile", "channel"])
        return channel.shifted(df, channel.best_shift(means, "channel", 1, int(p["maxshift"]), by=("profile",)), ["profile", "channel"])
    if given := given if isinstance(given, list) else [given]:
        table = df.sparkSession.createDataFrame([(i + 1, int(n)) for i, n in enumerate(given)], "channel int, shift int")
        return channel.shifted(df, F.broadcast(table), "channel")
    if one == 1 and not profile:
        raise ValueError("OneOrAll 1 needs shiftsamples or a refprofile")
    known = df.where(F.col("profile") == profile) if profile else df
    return channel.shifted(df, channel.best_shift(channel.sample_stats(known, ["channel"]), "channel", 1, int(p["maxshift"])), "channel")


@step("do_crossprofileshift", "survey")
def profile_shift(df, p, dt, ns):
    """Every profile moved to fit the first one, by the mean traces of channel 1; with a shiftfile by the shifts stored in it."""
    return channel.shifted(df, found_shifts(df, int(p["maxshift_cps"])) if "shiftfile" not in p else stored_shifts(df, str(p["shiftfile"])), "profile")


def found_shifts(df: DataFrame, most: int) -> DataFrame:
    """(profile, shift, r) of do_crossprofileshift, to be looked at or stored as lines of profile and shift (`sinks.write_lists`)."""
    return channel.best_shift(channel.sample_stats(df.where("channel = 1"), ["profile"]), "profile", None, most)


def stored_shifts(df: DataFrame, path: str) -> DataFrame:
    """(profile, shift) of a stored list; others than pairs of numbers are left out."""
    rows = df.sparkSession.read.schema("profile double, shift double").option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    return rows.where("profile is not null and shift is not null").select(F.col("profile").cast(df.schema["profile"].dataType).alias("profile"), F.col("shift").cast("int").alias("shift"))


@step("do_t0CorrectionReferencetrace", "survey")
def reference_trace(df, p, dt, ns):
    """Every trace moved to fit one trace, then its time zero cut; the reference is one row that is joined. One that is not in the
    survey (a profile 0, if it is not set) is an error of the run."""
    found = df.where((F.col("profile") == p["profile"]) & (F.col("channel") == p["channel"]) & (F.col("trace") == p["trace"])).agg(F.first("amp").alias("_ref"))
    found = found.select(F.coalesce("_ref", F.raise_error(F.lit("the reference trace is not in the survey")).cast(df.schema["amp"].dataType)).alias("_ref"))
    moved = spectral.align_to_column(df.withColumn("amp", F.col("amp").cast("array<double>")).crossJoin(F.broadcast(found)), "_ref")
    return moved.withColumn("amp", trace.t0_shift(F.col("amp"), dt, p["t0"]))


@step("do_turnProfiles", "channel")
def turn(df, p, dt, ns):
    return track.turn(df, ["profile", "channel"], "trace").drop("turned")


@step("do_exchange_x_y", "trace")
def exchange(df, p, dt, ns):
    return df.withColumns({"x": F.col("y"), "y": F.col("x")})


@step("do_helmertTransformation", "trace")
def similarity(df, p, dt, ns):
    """x and y under the similarity with parameters a, b, tx and ty (see functions.geo.similarity)."""
    x, y = geo.transformed(F.col("x"), F.col("y"), (p["a"], p["b"], p["tx"], p["ty"]))
    return df.withColumns({"x": x, "y": y})


@step("do_TopoMigration3D", "survey")
def migration(df, p, dt, ns):
    """Of grid cells (ix, iy, amp), and z, their heights, if there are any. Depths: as deep as the trace's time goes, and the relief; or nz."""
    relief = "z" in df.columns
    depths = int(p["nz"]) if "nz" in p else math.floor(ns * dt / 2 * p["v"] / p["dz"] + 0.5)
    return kernels.migrate(df, p["dx"], dt, p["v"], p["aperture"], p["dz"], depths, height="z" if relief else None, ns=ns, under_relief=relief and "nz" not in p)


@step("do_migration2d_vz", "channel")
def profile_migration(df, p, dt, ns):
    """Our own sum along hyperbolas of one speed; traces dx apart."""
    if not isinstance(p["v"], float):
        raise ValueError(f"the speed must be a number, not {p['v']}")
    return kernels.migrate_profile(df, ["profile", "channel"], "trace", p["dx"], dt, p["v"], p["aperture"], ns)


@step("do_linearInterpolation", "survey")
def fill_linear(df, p, dt, ns):
    """Of grid cells (ix, iy, amp): gaps within radius (in cells) of a trace."""
    cells = df.select("ix", "iy", "amp")
    return cells.unionByName(surface.linear_traces(surface.gaps(cells, p["radius"]), cells, p["radius"]))


@step("do_IDW_Interpolation", "survey")
def fill_idw(df, p, dt, ns):
    """Of grid cells (ix, iy, amp): gaps within radius (in cells) of a trace."""
    cells = df.select("ix", "iy", "amp")
    return cells.unionByName(surface.idw_traces(surface.gaps(cells, p["radius"]), cells, p["radius"], p["power"]))


@step("do_Coherence", "survey")
def coherence(df, p, dt, ns):
    """Of grid cells (ix, iy, amp), along the trace."""
    return grid.coherence_cube(df, dt, p["nwavelength"])


@step("do_DCremoval", "trace")
def whole_offset(df, p, dt, ns):
    return df.withColumn("amp", trace.dc_removal(F.col("amp"), dt, 0, (ns - 1) * dt, ns))


@step("do_t0correction", "channel")
def first_trace(df, p, dt, ns):
    """Every trace of a profile's channel moved to fit the first one, then its time zero cut."""
    first = df.groupBy("profile", "channel").agg(F.min_by("amp", "trace").alias("_ref"))
    moved = spectral.align_to_column(df.withColumn("amp", F.col("amp").cast("array<double>")).join(first, ["profile", "channel"]), "_ref")
    return moved.withColumn("amp", trace.t0_shift(F.col("amp"), dt, p["t0"]))


#: Other names of steps and parameters in settings files.
STEP_NAMES = {
    "do_t0Threshold": "do_t0CorrectionThreshold", "do_removeMeanTrace": "do_removeMeanMedianTrace", "do_kHighpass": "do_khighpass",
    "do_applyGain": "do_applygain", "do_interpolation": "do_traceInterpolation", "do_migration": "do_migration2d_vz",
}
NAMES = {
    "fmin_sw": "fmin", "fmax_sw": "fmax", "profilenumber": "profile", "channelnumber": "channel", "tracenumber": "trace", "aperture_m": "aperture", "aperture_t": "aperture",
    "aperture_mig": "aperture", "aperture_topo": "aperture", "v_topo": "v", "v-file": "v", "vfile_mig": "v", "tv-file": "tv", "cutT": "tmax", "dist": "dx", "meanMedian": "meanmedian",
    "numberOfTraces": "numtraces", "radLI": "radius",
}


def _value(words: list[str]) -> float | str | list:
    values = [float(w) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", w) else w for w in words]
    return values[0] if len(values) == 1 else values


def parse(text: str) -> tuple[list[str], dict[str, dict]]:
    """(steps in order, parameters by step). Parameters above the first step are under the empty name."""
    places, parameters, at = {}, {"": {}}, ""
    for line in text.splitlines():
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        key = re.sub(r"\[.*\]$", "", words[0])
        if key.startswith("do_"):
            at = STEP_NAMES.get(key, key)
            places[at] = int(float(words[1])) if len(words) > 1 else 0
            parameters.setdefault(at, {})
        elif at == "do_applygain" and key == "g":
            parameters[at] |= {f"g{i + 1}": float(w) for i, w in enumerate(words[1:])}
        else:
            parameters[at][NAMES.get(key, key)] = _value(words[1:])
    on = {k: v for k, v in places.items() if v}
    if unknown := sorted(k for k in on if k not in STEPS):
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    if sorted(on.values()) != list(range(1, len(on) + 1)):
        raise ValueError("the places of the steps must be 1..n, each once")
    return sorted(on, key=on.get), parameters


def plan(text: str) -> list[tuple[str, list[str]]]:
    """The steps in order, neighbours of one scope together."""
    return [(scope, list(names)) for scope, names in groupby(parse(text)[0], lambda name: STEPS[name].scope)]


def run(traces: DataFrame, text: str, dt: float, ns: int) -> DataFrame:
    """The recipe of text on traces of ns samples dt apart; no job is started."""
    steps, parameters = parse(text)
    waiting: list[spectral.Kernel] = []

    def chained(df: DataFrame) -> DataFrame:
        """df with the transforms that wait, in one pass."""
        kernels_, waiting[:] = list(waiting), []

        def every(block):
            for kernel in kernels_:
                block = kernel(block)
            return block

        return spectral.apply(df.withColumn("amp", F.col("amp").cast("array<double>")), every) if kernels_ else df

    for name in steps:
        given = {k: v for (n, k), other in SHARED.items() if n == name for v in [parameters.get(other, {}).get(k)] if v is not None}
        own = Parameters(name, parameters[""] | given | parameters[name])
        if kernel := STEPS[name].kernel(own, dt, ns):
            waiting.append(kernel)
        else:
            traces = STEPS[name].run(chained(traces), own, dt, ns)
        if name == "do_cutTWT":
            ns = min(ns, int(own["tmax"] / dt + 1e-9) + 1)
        if name == "do_reduceNumberOfSamples":
            n = own["n"] if own["n"] < 1 else int(own["n"])
            ns, dt = int((ns - 1) / n + 1e-9) + 1, dt * n
    return chained(traces)
