"""Mixing sources to target weights by fitting subset sums.

Sources share the total number of words by weight; no target passes `repeats` times its source, and
what is cut is shared among the others by weight until nothing is above: the water level that this
ends at is computed in one pass over the sources, sorted by the level at which each is full.

A source takes all its documents q times, q being the whole part of target / size, and a part of them
once more. That part is chosen by length: documents are counted by exact length, and every length gives
the same share of its count, rounded down. In a seeded order of the lengths, which knows nothing of how
long they are, the fractions that rounding cut are summed, and a length at which they pass a whole number
gives one document more, until the words that are missing fit the knapsack's room. Where only documents
are left that are longer than what is missing, the one of the nearest length is taken and what it has too much is dealt back in
the same way, for a few rounds, of which the nearest end counts. A bounded-knapsack dynamic programme over the documents that are left (or
taken, to give back), lengths again in the seeded order, fits the last words as closely as sums of lengths can. One rule
holds at every size, and the memory of the programme is bounded by its room. Which documents of a length are taken is decided by a seeded hash of id and text, so
reruns agree.

Hot lengths: the documents of one source and length are dealt to buckets of about _RANK rows by hash;
bucket counts decide all but one bucket, and only inside a bucket rows are ranked. Rows without an id are
told apart by their stored number; a bucket that equal rows of one id have made large is split by that number too.

Defined results: a null text has size 0 and is never taken; sources of size 0 have target 0; a null
source is a source of its own, the last; equal rows are told apart by the order they are stored in;
an empty table gives an empty table. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, whole_row

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
_RANK = 256
#: The knapsack's room: words that it fits at most.
_ROOM = 1 << 16
#: Rounds of taking and giving back long documents; each ends nearer to the budget or is not used.
_ROUNDS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), a row for each source, with target."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = (F.col("source_size") * repeats).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("full", cap / F.col("weight"))
    before = W.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    rows = rows.withColumn("level", level)
    # the first source whose own level would not fill it sets the level for all after it
    water = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)["level"]
    return rows.withColumn("water", water).select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _seeded(lengths: np.ndarray) -> np.ndarray:
    """The places of the lengths in an order that depends on their hashes only."""
    mixed = (lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.lexsort((lengths, mixed ^ mixed >> np.uint64(31)))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum comes as near to budget as may be. Of every sum the piece that made it
    first is held, so memory depends on the budget alone; lengths are used in their order, and no more of them once the budget is met."""
    take = np.zeros(len(lengths), np.int64)
    fits = (lengths < 2 * budget) & (counts > 0)  # a longer one alone is further off than nothing
    limit = 2 * budget
    reached, by = np.zeros(limit + 1, bool), np.full(limit + 1, -1, np.int32)
    reached[0] = True
    pieces: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(fits):
        n, piece = int(min(counts[i], limit // lengths[i])), 1
        while n > 0 and not reached[budget]:
            piece = min(piece, n)
            size = piece * int(lengths[i])
            new = size + np.flatnonzero(reached[: limit + 1 - size] & ~reached[size:])
            if len(new):
                reached[new], by[new] = True, len(pieces)
                pieces.append((int(i), piece, size))
            n -= piece
            piece *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        i, piece, size = pieces[by[at]]
        take[i] += piece
        at -= size
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near to budget, all lengths alike."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    even = counts * (budget / total)
    take = np.floor(even).astype(np.int64)
    order = _seeded(lengths)
    rest = budget - int((take * lengths).sum())
    room = min(_ROOM, 8 * -(-total // int(counts.sum())))
    owed = 0.0
    for i in order[: len(order) if rest > room else 0]:
        owed += even[i] - take[i]
        if owed >= 1 and rest > room and take[i] < counts[i] and lengths[i] <= rest - room // 2:
            take[i], rest, owed = take[i] + 1, rest - int(lengths[i]), owed - 1
    best, off, rounds = take, rest, 0
    while abs(rest) > room and rounds < _ROUNDS:
        take, rounds = take.copy(), rounds + 1
        side, sign = (counts - take, 1) if rest > 0 else (take.copy(), -1)  # what may be taken yet, or given back
        missing = abs(rest)
        for i in order:  # where fractions of short lengths could not make up for those of long ones
            if missing > room and lengths[i] <= missing - room // 2:
                n = min(int(side[i]), (missing - room // 2) // int(lengths[i]))
                take[i], side[i], missing = take[i] + sign * n, side[i] - n, missing - n * int(lengths[i])
        rest = sign * missing
        best, off = (take.copy(), rest) if abs(rest) < abs(off) else (best, off)
        open_ = np.flatnonzero(side > 0)
        if missing > room and len(open_):  # every length that is left is longer than what is missing, but for half the room
            nearest = open_[np.abs(lengths[open_] - missing).argmin()]
            take[nearest], rest = take[nearest] + sign, rest - sign * int(lengths[nearest])
            best, off = (take.copy(), rest) if abs(rest) < abs(off) else (best, off)
    take, rest = best, off
    if rest and abs(rest) <= 2 * _ROOM:  # what is more can't be met: no document that is left comes nearer
        more = np.zeros(len(lengths), np.int64)
        more[order] = knapsack(lengths[order], (counts - take if rest > 0 else take)[order], abs(rest))
        take += more if rest > 0 else -more
    return take


def plan(sized: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size, n, extra, epochs, source_size, target): for each length of a source, how many of its n documents are taken once more than epochs."""
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    aims = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, repeats)
    aims = materialize(aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long")), "mix-targets")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        budget = round(float(rows["target"][0]) - int(rows["epochs"][0]) * int(rows["source_size"][0]))
        at = rows["size"].to_numpy() > 0
        rows["extra"] = 0
        if rows["epochs"][0] < repeats:
            rows.loc[at, "extra"] = fit_counts(rows["size"].to_numpy()[at], rows["n"].to_numpy()[at], budget)
        return rows

    # histogram and targets of one source meet null-safely
    joined = histogram.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    schema = "source string, size long, n long, source_size long, target double, epochs long, extra long"
    joined = joined.select("source", "size", "n", "source_size", "target", "epochs")
    return materialize(joined.groupBy("source").applyInPandas(fit, schema), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, keep_text: bool = False) -> DataFrame:
    """id, source, size, source_size, target, times: how often the mix takes each row; keep_text: and every other column of docs, as struct `doc`."""
    payload = [whole_row(docs).alias("doc")] if keep_text else []
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("words"), *payload)
    sized = sized.withColumn("row", F.monotonically_increasing_id())
    sized = materialize(sized.withColumn("hash", F.xxhash64("id", "words", F.when(F.col("id").isNull(), F.col("row")), F.lit(seed))).drop("words"), "mix-sizes", "zstd")
    steps = plan(sized.select("source", "size"), repeats, weights).withColumnRenamed("source", "_source").withColumnRenamed("size", "_size")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    # steps and quotas grow with the corpus: always shuffled joins of rows without their texts
    rows = sized.select("id", "source", "size", "row", "hash").join(steps.hint("merge"), same).drop("_source", "_size")
    rows = rows.withColumn("buckets", F.ceil(F.col("n") / _RANK)).withColumn("bucket", F.pmod("hash", "buckets"))
    key = ["source", "size", "bucket"]
    # only lengths of which a part is taken need ranks
    part = rows.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    large = materialize(part.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 8 * _RANK).select(*[F.col(k).alias("_" + k) for k in key], F.ceil(F.col("rows") / _RANK).alias("splits")), "mix-large")
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket"))
    part = part.withColumn("split", F.lit(0).cast("long"))
    if not large.isEmpty():  # only equal rows of one id make a bucket large
        part = part.join(large.hint("merge"), match, "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64("row"), "splits"), "split")).drop("_source", "_size", "_bucket", "splits")
    key.append("split")
    held = part.groupBy(*key).agg(F.count("*").alias("held"), F.first("extra").alias("extra"))
    until = W.partitionBy("source", "size").orderBy("bucket", "split").rowsBetween(W.unboundedPreceding, -1)
    quota = F.greatest(F.lit(0), F.least(F.col("held"), F.col("extra") - F.coalesce(F.sum("held").over(until), F.lit(0))))
    quotas = materialize(held.withColumn("quota", quota).select(*[F.col(k).alias("_" + k) for k in key], "quota"), "mix-quotas")
    match &= F.col("split") == F.col("_split")
    rank = F.row_number().over(W.partitionBy(*key).orderBy("hash", "id", "row"))
    ranked = part.join(quotas.hint("merge"), match).withColumn("more", (rank <= F.col("quota")).cast("long"))
    whole = rows.where((F.col("extra") <= 0) | (F.col("extra") >= F.col("n"))).withColumn("more", (F.col("extra") > 0).cast("long"))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("more")).otherwise(0).alias("times")
    columns = ["row", "id", "source", "size", "source_size", "target", times]
    out = whole.select(*columns).unionByName(ranked.select(*columns))
    return sized.select("row", "doc").join(out, "row") if keep_text else out


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    mixed = mix(docs, keep_text=True, **options).where("times > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
