"""Removal of repeated strings by a distributed difference-cover search over the suffixes of all texts.

A byte goes if it lies in a string of `length` bytes that also starts elsewhere. The steps are those of the
difference-cover suffix sort, cut off at `length` bytes and kept to places that can matter:

Sample. Of every `reach` neighbouring places the one whose next bytes hash least is sampled. This is a difference
cover chosen by content: two equal strings of `length` bytes are sampled at the same place within their first `reach`
ones, so every pair of equal suffixes meets at a sample, with about 2 places in reach + 1 sampled.

Names. A sampled suffix is named by its next `core` bytes (128 bits of XXH3); names that come once are dropped, as nothing that
begins there or up to reach - 1 places before can repeat.

Recursion on names. In the string of names that is left of a text, every sample takes the triple (name before, own,
name behind) with the gaps between, of samples just over a reach away. Triples are counted: those that come
twice or more cover whole strings of `length` bytes on both sides, and are settled. What is left are the ends of repeats.

Merge of the remaining suffixes. A suffix that starts up to reach - 1 places before a sample is sorted by its bytes up to
the sample, the sample's name and the bytes behind the core. Within a name, unsettled samples and one of each settled
triple are sorted so, for every distance to the sample, and adjacent prefixes of `length` bytes are compared byte by byte.

Equal texts are counted first and searched as one. No group of equal names is gathered if it has over LARGE
members that differ: then its suffixes are counted by hash (128 bits) in shuffles that pre-aggregate. Texts are shuffled once, to
buckets that both later passes read in place.

Defined results: a null text is empty; texts shorter than `length` lose nothing; repeated rows are copies of each other
and lose all their bytes if they have `length`; an empty table gives an empty table. Only the named columns are read, so
others can't clash. A text must fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_buckets, read

LENGTH = 400
#: Members of a name that one task compares; beyond it they are counted by hash.
LARGE = 50_000

_SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cover(length: int) -> tuple[int, int, int]:
    """reach, core and the bytes that choose a sample. reach + core - 1 is the length."""
    reach = max(1, length * 3 // 8)
    core = length - reach + 1
    return reach, core, min(16, core)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on."""
    n = len(data) - size + 1
    if size >= 8:
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        h = (words[:n] ^ np.uint64(0x2545F4914F6CDD1D)) * _MIX ^ (words[size - 8 :][:n] + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
    else:
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = (h ^ data[i : i + n]) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The sampled places of texts that lie one behind the other in data."""
    reach, _, size = cover(length)
    found = []
    for at in range(0, len(data) - length + 1, _SLICE):
        part = data[at : at + _SLICE + length - 1]
        least = _gram_hashes(part, size) & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=np.uint64)  # of equal hashes the first
        done = 1
        while done < reach:
            step = min(done, reach - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        least = least[: len(part) - length + 1]
        place = np.arange(at, at + len(least))
        text = np.searchsorted(starts, place, "right") - 1
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[place + length <= ends[text]]
        found.append(chosen[np.flatnonzero(np.diff(chosen, prepend=-1))] + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and their n + 1 offsets."""
    texts = pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sample(length: int):
    _, core, _ = cover(length)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, offsets = _bytes_of(part.column("text"))
                if len(data) < length:
                    continue
                places = samples(data, offsets[:-1], offsets[1:], length)
                view = memoryview(data)
                names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a : a + core]) for a in places.tolist()]), np.int64).reshape(-1, 2)
                text = np.searchsorted(offsets, places, "right") - 1
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(take), part.column("copied").take(take), pa.array((places - offsets[text]).astype(np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1])],
                    names=["key", "copied", "at", "x", "y"],
                )

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted stream in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pa.array(np.ones(batch.num_rows, bool))
        for c in by:
            same = pc.and_(same, pc.equal(batch.column(c), batch.column(c)[-1]))
        other = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or held and any(held[0].column(c)[0] != batch.column(c)[0] for c in by):
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _triples(length: int):
    """Adds to each sample the hash of its triple of names, null where a side has no name near enough."""
    reach, core, _ = cover(length)

    def run(batches):
        for table in _whole_groups(batches, ["key"]):
            keys = table.column("key").combine_chunks()
            at, x, y = (table.column(c).to_numpy() for c in ("at", "x", "y"))
            n = len(at)
            text = np.cumsum(np.concatenate([[0], ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)])) if n > 1 else np.zeros(n, np.int64)
            place = (text.astype(np.int64) << 34) + at
            before = np.searchsorted(place, place - (reach - 1), "right") - 1
            behind = np.searchsorted(place, place + (reach - 1), "left")
            both = (before >= 0) & (behind < n)
            before, behind = np.maximum(before, 0), np.minimum(behind, n - 1)
            both &= (place - place[before] <= core) & (place[behind] - place <= core)
            triple = np.stack([x[before], y[before], place - place[before], x, y, place[behind] - place, x[behind], y[behind]], axis=1).astype("<i8")
            rows = triple.tobytes()
            classes = [xxhash.xxh3_128_digest(rows[i * 64 : i * 64 + 64]) if ok else None for i, ok in enumerate(both.tolist())]
            yield from table.append_column("triple", pa.array(classes, pa.binary())).to_batches()

    return run


def _contexts(length: int):
    """Of each sample that is needed the bytes before it and behind its core, as far as strings of the length reach."""
    reach, core, _ = cover(length)
    names = ["x", "y", "members", "key", "at", "open", "left", "right"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for key, text, wanted in zip(*(batch.slice(lo, 64).column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                    text = text.encode()
                    for w in wanted:
                        at = w["at"]
                        rows.append((w["x"], w["y"], w["members"], key, at, w["open"], text[max(0, at - reach + 1) : at], text[at + core : at + length]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def matched(group: np.ndarray, left: list[bytes], right: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance to the sample at which each suffix has an equal one in its group; greatest is -1 if there is none.

    For every distance the suffixes are sorted by a hash of group and bytes, and neighbours of equal hash are compared."""
    n, side = len(group), reach - 1
    lefts = np.frombuffer(b"".join(b.rjust(side, b"\0") for b in left), np.uint8).reshape(n, side)
    rights = np.frombuffer(b"".join(b.ljust(side, b"\0") for b in right), np.uint8).reshape(n, side)
    len_left, len_right = np.array([len(b) for b in left], np.int64), np.array([len(b) for b in right], np.int64)
    rng = np.random.default_rng(13)
    factors = rng.integers(1, 1 << 64, 2 * side + 1, np.uint64)
    h = group.astype(np.uint64) * factors[-1]
    for i in range(side):
        h = h + rights[:, i] * factors[i]
    least, most = np.full(n, reach, np.int64), np.full(n, -1, np.int64)
    for o in range(reach):
        if o:  # one byte more before the sample, one less behind the core
            h = h + lefts[:, side - o] * factors[side + o - 1] - rights[:, side - o] * factors[side - o]
        rows = np.flatnonzero((len_left >= o) & (len_right >= side - o))
        rows = rows[np.argsort(h[rows], kind="stable")]
        a, b = rows[:-1], rows[1:]
        same = (h[a] == h[b]) & (group[a] == group[b])
        a, b = a[same], b[same]
        if len(a):
            equal = (lefts[a, side - o :] == lefts[b, side - o :]).all(1) & (rights[a, : side - o] == rights[b, : side - o]).all(1)
            hit = np.concatenate([a[equal], b[equal]])
            least[hit], most[hit] = np.minimum(least[hit], o), o
    return least, most


def _match(length: int):
    reach, _, _ = cover(length)

    def run(batches):
        for table in _whole_groups(batches, ["x", "y"]):
            x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
            group = np.cumsum(np.concatenate([[0], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            at, open_ = table.column("at").to_numpy().astype(np.int64), table.column("open").to_numpy()
            least, most = matched(group, table.column("left").to_pylist(), table.column("right").to_pylist(), reach)
            found = np.flatnonzero((most >= 0) & open_)
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(found)), pa.array(at[found] - most[found]), pa.array(at[found] + length - least[found])], names=["key", "start", "end"])

    return run


def _suffix_hashes(length: int):
    """A row for every suffix that a sample of a large group stands for: x, y, o, h, key, at, open."""
    reach, _, _ = cover(length)
    names, kinds = ["x", "y", "o", "h", "key", "at", "open"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(lo, 64).to_pylist():
                    left, right, n = r["left"], r["right"], len(r["left"])
                    for o in range(max(0, reach - 1 - len(right)), n + 1):
                        rows.append((r["x"], r["y"], o, xxhash.xxh3_128_digest(left[n - o :] + right[: reach - 1 - o]), r["key"], r["at"], r["open"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([new[1:], [True]])
    return start[new], end[last]


def _cut(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = []
            for key, text, found in zip(*(batch.slice(lo, 64).column(c).to_pylist() for c in ("key", "text", "found")), strict=True):
                text, kept, last = text.encode(), hashlib.sha256(), 0
                start, end = spans(np.array([f["start"] for f in found]), np.array([f["end"] for f in found]))
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    kept.update(text[last:a])
                    last = b
                kept.update(text[last:])
                rows.append((key, int((end - start).sum()), len(start), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["key", "removed", "spans", "kept"])


def _text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def find(docs: DataFrame, text_col: str = "text", length: int = LENGTH, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(texts, found): texts has key (of the text), text, copied, for texts of `length` bytes or more; found has key, start, end of
    intervals whose union is what is repeated in a text that is not copied as a whole."""
    long = docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") >= length).select(_text_key(F.col("text")).alias("key"), "text")
    texts = materialize_buckets(long.groupBy("key").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied")), "repeats-texts", "key")
    kinds = "key binary, copied boolean, at int, x long, y long"
    sampled = materialize(texts.mapInArrow(_sample(length), kinds), "repeats-samples")
    # neither side is small for certain: always shuffled joins. The counts are tables of their own, as adaptive execution splits hot keys
    # only where both sides are shuffled for the join alone
    often = materialize(sampled.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"), "repeats-often")
    named = sampled.join(often.hint("merge"), "x", "left_semi").select("key", "copied", "at", "x", "y")
    lined = named.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_triples(length), f"{kinds}, triple binary")
    lined = materialize(lined, "repeats-triples")
    settled = materialize(lined.where("triple IS NOT NULL").groupBy("triple").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")).where("n > 1").select("triple", "one"), "repeats-settled")
    marked = materialize(lined.join(settled.hint("merge"), "triple", "left").select("key", "copied", "at", "x", "y", F.col("one").isNotNull().alias("settled"), (F.col("one") == F.struct("key", "at")).alias("stands")), "repeats-marked")

    reach, _, _ = cover(length)
    whole = marked.where("settled AND NOT copied").select("key", (F.col("at") - (reach - 1)).cast("long").alias("start"), (F.col("at") + length).cast("long").alias("end"))
    members = marked.where("NOT settled OR stands").withColumn("open", ~F.col("settled") & ~F.col("copied"))
    groups = materialize(members.groupBy("x", "y").agg(F.count("*").alias("members"), F.max("open").alias("any")).where("members > 1 AND any").select("x", "y", "members"), "repeats-groups")
    wanted = members.join(groups.hint("merge"), ["x", "y"]).groupBy("key").agg(F.collect_list(F.struct("x", "y", "members", "at", "open")).alias("wanted"))
    contexts = texts.join(wanted.hint("merge"), "key").select("key", "text", "wanted").mapInArrow(_contexts(length), "x long, y long, members long, key binary, at int, open boolean, left binary, right binary")
    contexts = materialize(contexts, "repeats-contexts", "zstd")
    ends = contexts.where(F.col("members") <= large).repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(_match(length), "key binary, start long, end long")

    hashed = contexts.where(F.col("members") > large).mapInArrow(_suffix_hashes(length), "x long, y long, o int, h binary, key binary, at long, open boolean")
    equal = hashed.groupBy("x", "y", "o", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = hashed.join(equal.hint("merge"), ["x", "y", "o", "h"], "left_semi").where("open").groupBy("key", "at").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    hot = hot.select("key", (F.col("at") - F.col("most")).alias("start"), (F.col("at") + length - F.col("least")).alias("end"))
    return texts, whole.unionByName(ends).unionByName(hot)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, found = find(docs, text_col, length, large)
    by_text = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    parts = texts.where("NOT copied").join(by_text.hint("merge"), "key").select("key", "text", "found").mapInArrow(_cut, "key binary, removed long, spans long, kept string")
    copies = texts.where("copied").select("key", F.octet_length("text").cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.sha2(F.lit(""), 256).alias("kept"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")).withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    met = rows.join(materialize(parts.unionByName(copies), "repeats-cut").hint("merge"), "key", "left")
    none = F.lit(0).cast("long")
    return met.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir, "documents"))


#: All strings of 400 bytes as hexadecimal digits, told apart by a 64-bit hash, cut from pieces of 500 places so that none is counted far into.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), c AS (
  SELECT r, n, j, substr(h, 1000 * j + 1, 1800) AS c FROM (SELECT r, h, n, unnest(range(0, (n - 399 + 499) // 500)) AS j FROM d WHERE n >= 400)
), p AS (
  SELECT r, 500 * j + o AS i, hash(substr(c, 2 * o + 1, 800)) AS m FROM (SELECT r, j, c, unnest(range(0, least(500, n - 399 - 500 * j))) AS o FROM c)
), q AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)
), g AS (
  SELECT r, i, count(*) FILTER (before IS NULL OR i > before + 400) OVER (PARTITION BY r ORDER BY i) AS run FROM q
), runs AS (
  SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, run
), gaps AS (
  SELECT r, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY r ORDER BY a)
  UNION ALL SELECT d.r, coalesce(max(runs.b), 0), any_value(d.n) FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY r
), sums AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k USING (r) LEFT JOIN sums s USING (r)
"""
