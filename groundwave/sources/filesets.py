"""Files of one measurement brought together by their names: header, data, positions, geometry, sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each maker the patterns of its files by role; the first group names the measurement.
SETS = {
    "mala": {"header": r"(?i)^(.+)\.rad$", "data": r"(?i)^(.+)\.rd[37]$", "position": r"(?i)^(.+?)(?:_G\d+)?\.pos$"},
    "noggin": {"header": r"(?i)^[^/]*?(\d+)\.hd$", "data": r"(?i)^[^/]*?(\d+)\.dt1$", "position": r"(?i)^[^/]*?(\d+)\.gps$"},
    "proceq": {"low": r"(?i)^(.+)_LF\.sgy$", "high": r"(?i)^(.+)_HF\.sgy$", "sidecar": r"(?i)^(.+)\.csv$"},
    "stream": {"header": r"(?i)^(.+)\.iprh$", "data": r"(?i)^(.+)\.iprb$", "position": r"(?i)^(.+?)(?:_G\d+)?\.(?:cor|gps)$"},
}
#: Roles that a measurement of each maker cannot be read without.
NEEDED = {"mala": ["header", "data"], "noggin": ["header", "data"], "proceq": ["sidecar"], "stream": ["header", "data"]}


def pairs(spark: SparkSession, folder: str, maker: str) -> DataFrame:
    """(name, a path for each role, missing, extra): one row for each measurement of a folder. Names of only digits are numbers,
    so 7 and 07 meet. missing has the needed roles without a file (for proceq also `low` and `high` where both are absent); extra the
    paths of a role beyond the first by name. Only names are listed, no file is opened; hidden files are left out."""
    roles = SETS[maker]
    files = spark.read.format("binaryFile").load(folder).select("path")
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    role = F.coalesce(*[F.when(base.rlike(p), F.lit(r)) for r, p in roles.items()])
    name = F.coalesce(*[F.when(base.rlike(p), F.regexp_extract(base, p, 1)) for p in roles.values()])
    name = F.when(name.rlike(r"^\d{1,18}$"), name.cast("long").cast("string")).otherwise(name)
    rows = files.where(~base.startswith(".")).select("path", role.alias("role"), name.alias("name")).where("role is not null")
    met = rows.groupBy("name").agg(*[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("path")))).alias(r) for r in roles])
    missing = F.array_compact(F.array(*[F.when(F.size(r) == 0, F.lit(r)) for r in NEEDED[maker]]))
    if maker == "proceq":
        missing = F.when((F.size("low") == 0) & (F.size("high") == 0), F.concat(missing, F.array(F.lit("low"), F.lit("high")))).otherwise(missing)
    extra = F.flatten(F.array(*[F.slice(r, 2, F.greatest(F.size(r), F.lit(1))) for r in roles]))
    return met.select("name", missing.alias("missing"), extra.alias("extra"), *[F.get(r, F.lit(0)).alias(r) for r in roles])


def read_hd(spark: SparkSession, folder: str) -> DataFrame:
    """(path, traces, window, start, end, step) of .HD headers: the numbers behind `=` in lines 7, 13, 15, 17 and 19."""
    text = spark.read.text(f"{folder}/*.[hH][dD]", wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    number = lambda line: F.regexp_extract(F.get("lines", F.lit(line - 1)), r"=\s*(-?[0-9.]+)", 1).try_cast("double")
    return text.select("path", number(7).cast("long").alias("traces"), number(13).alias("window"), number(15).alias("start"), number(17).alias("end"), number(19).alias("step"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(name, constant, x0, x1, y0, y1): lines `number direction file from to across across_end`, direction y going along y at constant x;
    others are left out."""
    f = F.split(F.trim("value"), r"[\s,;]+")
    at = lambda i: F.get(f, F.lit(i)).try_cast("double")
    along_y = F.lower(F.get(f, F.lit(1))) == "y"
    rows = spark.read.text(path).where(F.size(f) >= 7).select(
        F.get(f, F.lit(2)).alias("name"), F.when(along_y, "x").otherwise("y").alias("constant"),
        *[F.when(along_y, at(a)).otherwise(at(b)).alias(n) for n, a, b in (("x0", 5, 3), ("x1", 6, 4), ("y0", 3, 5), ("y1", 4, 6))],
    )
    return rows.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null")


def by_geometry(traces: DataFrame, geometry: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """traces (name, position along the line) with x and y: one is constant, the other starts at its first value and goes towards its last one.
    Traces of a name without geometry have nulls; a name that comes twice counts as its first by coordinates."""
    first = geometry.groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("constant", "x0", "x1", "y0", "y1")).alias("_g"))
    rows = traces.join(first, F.col(name) == F.col("_name"), "left")
    g, p = F.col("_g"), F.col(position)
    towards = lambda a, b: g[a] + F.when(g[a] < g[b], p).otherwise(-p)
    x = F.when(g["constant"] == "x", g["x0"]).otherwise(towards("x0", "x1"))
    y = F.when(g["constant"] == "y", g["y0"]).otherwise(towards("y0", "y1"))
    return rows.withColumns({"x": F.when(g.isNotNull(), x), "y": F.when(g.isNotNull(), y)}).drop("_name", "_g")


def read_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, spacing, start_x, start_y) of the .csv beside low and high frequency files: the last word of the lines `File Name` and
    `Repetition Rate [scans/cm]` (spacing in cm), and the last two numbers of the line behind `SCAN DISTANCE [m]`. What is absent is null."""
    text = spark.read.text(f"{folder}/*.csv", wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    words = lambda line: F.split(F.trim(line), r"[\s,;]+")
    named = lambda start: F.element_at(words(F.get(F.filter("lines", lambda x: x.startswith(start)), F.lit(0))), -1)
    place = F.array_position(F.transform("lines", lambda x: x.startswith("SCAN DISTANCE [m]")), True)
    behind = words(F.when(place > 0, F.get("lines", place.cast("int"))))
    at = lambda i: F.try_element_at(behind, F.lit(i)).try_cast("double")
    return text.select("path", named("File Name").alias("file"), named("Repetition Rate [scans/cm]").try_cast("double").alias("spacing"), at(-2).alias("start_x"), at(-1).alias("start_y"))
