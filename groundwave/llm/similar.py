"""Near copies by the similarity of word shingles: SimHash fingerprints, BK-trees in shards of their bits and connected classes as
in `simhash`; exact Jaccard similarity decides.

Texts of equal words are one node. Sets of similarity 0.8 differ in 15 % of the bits of a fingerprint, so blocks of bits can't be
made to agree with certainty, as for two bits of 64. Fingerprints are longer instead: a node goes to a shard by each of so many blocks that
a pair of similarity 0.8 misses all of them with a chance of 3e-6, and less if it is more similar. Blocks are as wide as
leaves about 128 nodes in a shard, whatever the number of documents. Each shard's task builds BK-trees over
128 bits that are in no block and links the nodes within 40 bits (a pair of 0.8 is over it with a chance of 1.3e-6, texts that have nothing in common
are within it with one of 1.3e-5). Pairs of four and five shingles, of which single bits say little, meet by the four shingles themselves.

A task hands on a star of each class of its shards, as in `simhash`, and stars that meet are joined to groups, so a node is in one group, in however many shards
it has met others. A shard of over 1024 nodes is a star as a whole. Groups only hold what may be alike: in those of up to 32 nodes all pairs of sets are compared in one task.
The nodes of a larger group are first compared with the one of them that has the most company over all its shards: the middle of
a large group of near copies, which so costs a comparison each and not one for each pair. Groups that are one class then are done.

Of large groups that are still open, which texts share that have a passage in common or are copies with many changes,
the nodes get buckets by an exact rule: with their shingles in order of how many of these nodes have them, two sets of
similarity s or more share one of their first n - ceil(s n) + 1, n being the size of each. Rare shingles come first, so texts
with many changes of their own meet nobody there. These buckets are worked off by the one with the most company, in small ones all pairs are compared,
and where they are still large and open, from their first nodes on, 16 times as many each round, until each is one class or all of its
pairs were compared.

A parity sketch of 512 bits says for each bit whether an odd number of a set's shingles fall on it: the bits in which two
sketches differ are at most the shingles in which the sets do, so pairs over the number that the similarity allows are
ruled out before they are made, and none that is similar enough is.

Defined results: as in `simhash`: words are split at white space, ASCII letters count in lower case, a null
text counts as empty, a text of fewer words than a shingle is one shingle, null ids are ignored when the
smallest id is sought, an empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_lookup, materialize
from .simhash import SEED, BKTree, components, keep_one

SHINGLE, SIMILARITY = 5, 0.8
#: Chance that a pair of just the similarity shares no shard.
MISS = 3e-6
#: Words of a fingerprint that BK-trees compare, and the differing bits they allow at similarity 0.8.
_COMPARED, RADIUS = 2, 40
#: Nodes of a shard, about; a shard of more than _LARGE is not searched but compared as it is.
_SHARD, _LARGE = 128, 1024
_VISITS = 1 << 18
_BLOCK = 1 << 8
#: In groups and open buckets of at most so many nodes all pairs are compared.
_SMALL = 32
#: Words of 64 bits in a parity sketch.
_SKETCH = 8


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([_key(words)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def apart(similarity: float) -> float:
    """The share of bits that differ between fingerprints of two sets of the similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    """Of the compared bits those that may differ: RADIUS at 0.8, as many standard deviations over the mean elsewhere."""
    bits = 64 * _COMPARED
    far = lambda p: (bits * p, math.sqrt(bits * p * (1 - p)))
    (mean, spread), (at, width) = far(apart(SIMILARITY)), far(apart(similarity))
    return math.ceil(at + width * (RADIUS - mean) / spread)


def shape(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Width and number of the blocks of bits for n nodes."""
    width = max(8, math.ceil(math.log2(max(1, n) / _SHARD)))
    return width, math.ceil(math.log(MISS) / math.log1p(-((1 - apart(similarity)) ** width)))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set: a bit is 1 if set in over half of the shingles' hashes, of which every word has its own; where it is set
    in just half, the least shingle's decides."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), _BLOCK - 1):
        x = hashes[at : at + _BLOCK - 1, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        if not at:
            counts += bits[0]  # twice the counts are compared, so this parts ties only
        counts += 2 * bits.sum(0, dtype=np.uint8).astype(np.int64)
    return np.packbits(counts > len(hashes), bitorder="little").view(np.uint64)


def subsets(hashes: np.ndarray) -> list[int]:
    """A number for the set of four shingles, or for those within one of five."""
    if not 4 <= len(hashes) <= 5:
        return []
    parts = [hashes] if len(hashes) == 4 else [np.delete(hashes, i) for i in range(5)]
    return [xxhash.xxh64_intdigest(part.tobytes(), SEED) for part in parts]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(items: np.ndarray) -> np.ndarray:
    """A number for the compared bits of each item."""
    code = np.zeros(len(items), np.uint64)
    for word in items.view(np.uint64).T:
        code = (code ^ word) * _MIX
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return code


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(id, key, n, fp, fours, code): key of the words, number of distinct shingles, fingerprint, numbers of subsets(), code of the compared bits."""

    def run(batches):
        for batch in batches:
            keys, sizes, fps, fours = [], [], [], []
            for x in batch.column(1):
                split = _words(x.as_py())
                grams = shingles(split, shingle)
                keys.append(_key(split))
                sizes.append(len(grams))
                fps.append(fingerprint(grams, words).tobytes() if len(grams) else b"")
                fours.append(np.array(subsets(grams), np.uint64).view(np.int64))
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(fours, pa.list_(pa.int64()))]
            compared = np.frombuffer(b"".join(fp[: 8 * _COMPARED].ljust(8 * _COMPARED, b"\0") for fp in fps), np.int64).reshape(-1, _COMPARED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(codes(compared).view(np.int64))], names=["id", "key", "n", "fp", "fours", "code"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"), F.lit(b"").alias("fp"), F.array(F.lit(0).cast("long")).alias("fours"), F.lit(0).cast("long").alias("code")]
    return rows.mapInArrow(run, rows.select("id", *kinds).schema)


def _spread(width: int, blocks: int):
    """(shard, c0, c1) for every block of a node's fingerprint, with the bits that are compared: they stand for the node."""

    def run(batches):
        weights = np.int64(1) << np.arange(width, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                fps = batch.column(0).slice(lo, 512).to_pylist()
                n, fps = len(fps), np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
                bits = np.unpackbits(fps[:, 8 * _COMPARED :], axis=1, bitorder="little")[:, : width * blocks].reshape(n, blocks, width)
                shards = (bits @ weights) | np.arange(blocks, dtype=np.int64) << width
                compared = np.ascontiguousarray(fps[:, : 8 * _COMPARED]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shards.ravel(), *np.repeat(compared, blocks, axis=0).T)], names=["shard", *_names("c", _COMPARED)])

    return run


def local_classes(shard: np.ndarray, items: np.ndarray, radius: int) -> np.ndarray:
    """For each item, sorted by shard, the first of its class: links are those within radius in its shard, found in the shard's BK-tree."""
    n = len(items)
    new = np.concatenate([[True], shard[1:] != shard[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    items = items.view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
    tree = BKTree(items, first)
    size = np.bincount(first, minlength=n)[first]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _VISITS)) + 1  # a pass makes about so many visits
    pairs = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        q, i = tree.within(items[lo:hi], radius, first[lo:hi])
        apart = q + lo != i
        pairs.append((q[apart] + lo, i[apart]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _buckets(radius: int):
    """(bucket, c0, c1) of the classes of every shard, the rows of which come one behind the other; equal classes have equal buckets."""

    def rows(bucket, items):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket.view(np.int64), *items.T)], names=["bucket", *_names("c", _COMPARED)])

    def search(shard, items):
        root = local_classes(shard, items, radius)
        member = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        if len(member):
            total = np.zeros(len(root), np.uint64)
            np.add.at(total, root[member], codes(items[member]))
            yield rows(total[root[member]], items[member])

    def run(batches):
        shard, items = np.zeros(0, np.int64), np.zeros((0, _COMPARED), np.int64)
        large = None  # the shard at the end, if it has proved large

        def as_it_is(shard, items):
            return rows((shard.view(np.uint64) + np.uint64(1)) * _MIX, items)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            shard, items = np.append(shard, columns[0]), np.concatenate([items, np.stack(columns[1:], axis=1)])
            if not len(shard):
                continue
            if large is not None:
                n = int(np.searchsorted(shard != large, True))
                if n:
                    yield as_it_is(shard[:n], items[:n])
                shard, items = shard[n:], items[n:]
                if not len(shard):
                    continue
                large = None
            new = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            size = np.diff(new, append=len(shard))
            wide = np.repeat(size > _LARGE, size)
            if wide.any():
                yield as_it_is(shard[wide], items[wide])
            if size[-1] > _LARGE:
                large = shard[-1]
            done = ~wide
            done[new[-1] :] = False  # the last shard may go on in the next batch
            yield from search(shard[done], items[done]) if done.any() else ()
            keep = np.zeros(len(shard), bool)
            keep[new[-1] :] = large is None
            shard, items = shard[keep], items[keep]
        if len(shard):
            yield from search(shard, items)

    return run


def _stars(radius: int):
    """(a, b, size): the code of every node of a class of a shard, that of the class's hub, which is one of it, and how many they are."""
    buckets = _buckets(radius)

    def run(batches):
        hubs: dict[int, int] = {}  # large shards come in several batches
        for batch in buckets(batches):
            if not batch.num_rows:
                continue
            bucket, *items = (c.to_numpy() for c in batch.columns)
            code = codes(np.stack(items, axis=1)).view(np.int64)
            order = np.lexsort((code, bucket))
            bucket, code = bucket[order], code[order]
            new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(new, append=len(bucket))
            hub = np.array([hubs.setdefault(x, y) for x, y in zip(bucket[new].tolist(), code[new].tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, np.repeat(hub, size), np.repeat(size, size))], names=["a", "b", "size"])

    return run


def _keyed(batches):
    for batch in batches:
        keys = np.array([_key(_words(x.as_py())) for x in batch.column(0)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0)], names=["key", "text"])


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles on each of the bits, as signed words."""
    odd = np.bincount((grams.view(np.uint64) >> np.uint64(7)) % np.uint64(64 * _SKETCH), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _names(letter: str, n: int = _SKETCH) -> list[str]:
    return [f"{letter}{i}" for i in range(n)]


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [np.sort(shingles(_words(x.as_py()), shingle).view(np.int64)) for x in batch.column(1)]
            sketches = np.array([sketch(x) for x in sets], np.int64).reshape(-1, _SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), *map(pa.array, sketches.T)], names=["key", "grams", *_names("s")])

    return run


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _group_classes(shingle: int, similarity: float):
    """(node, root): classes of every group by all of its pairs, a group's rows (group, key, text) coming one behind the other."""

    def classes(keys, texts):
        sets = [shingles(_words(x), shingle) for x in texts]
        root = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if root[i] != root[j] and min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and _similar(x, y, similarity):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        return [(keys[i], keys[r]) for i, r in enumerate(root) if i != r]

    def run(batches):
        group, keys, texts = None, [], []
        for batch in batches:
            found = []
            for g, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    found += classes(keys, texts)
                    group, keys, texts = g, [], []
                keys.append(key)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["node", "root"])
        found = classes(keys, texts)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["node", "root"])

    return run


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            sets = []
            for column in (batch.column(2), batch.column(3)):
                at = column.offsets.to_numpy()
                flat = column.values.to_numpy(zero_copy_only=False)
                sets.append([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
            hit = [_similar(x, y, similarity) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], names=["a", "b", "alike"])

    return run


class _Search:
    """Links between nodes whose sets (key, grams) are known: edges found, pairs tested, and the roots of the classes so far."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity = sets, similarity
        self.edges = self.tested = None
        self.roots = sets.sparkSession.createDataFrame([], "node long, root long")

    def open_buckets(self, rows: DataFrame) -> DataFrame:
        """rows (bucket, key, n, rank) with root, of the buckets that are more than one class; size: their nodes."""
        rows = rows.drop("root", "size").join(self.roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        live = rows.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1").select("bucket", "size")
        return materialize(rows.join(live.hint("merge"), "bucket"), "similar-open")

    def compare(self, rows: DataFrame, low: int, high: int | None = None) -> None:
        """Nodes of ranks low to high with all later ones of their bucket, unless one class or their sizes rule it out."""
        first = rows.where(F.col("rank") >= low if high is None else F.col("rank").between(low, high))
        first = first.select("bucket", F.col("key").alias("a"), F.col("n").alias("m"), F.col("rank").alias("at"), F.col("root").alias("r"), *[F.col(s).alias(t) for s, t in zip(_names("s"), _names("t"), strict=True)])
        fits = F.least("n", "m") >= self.similarity * F.greatest("n", "m") - 1e-9
        differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(t))) for s, t in zip(_names("s"), _names("t"), strict=True)), F.lit(0))
        fits &= differ <= (1 - self.similarity) / (1 + self.similarity) * (F.col("n") + F.col("m")) + 1e-6
        met = rows.where(F.col("rank") > low).join(first.hint("merge"), "bucket").where("rank > at and root <> r").where(fits)
        pairs = met.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "similar-pairs")
        if pairs.isEmpty():
            return
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "similar-ends")
        sets = join_lookup(self.sets, ends, ["key"], "left_semi")  # so that others are not shuffled
        one, two = (sets.select(F.col("key").alias(k), F.col("grams").alias(g)) for k, g in (("a", "x"), ("b", "y")))
        full = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
        done = materialize(full.select("a", "b", "x", "y").mapInArrow(_alike(self.similarity), "a long, b long, alike boolean"), "similar-tested")
        self.tested = done.select("a", "b") if self.tested is None else self.tested.unionByName(done.select("a", "b"))
        found = done.where("alike").select("a", "b")
        if not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.unionByName(found)
            self.roots = components(self.edges)

    def work(self, buckets: DataFrame, whole: bool) -> DataFrame:
        """Compare in buckets (bucket, key, n, company) of two nodes or more; the large ones that stay open (none, if whole)."""
        order = W.partitionBy("bucket").orderBy(F.desc("company"), F.xxhash64("key", "bucket"), "key")
        known = self.sets.select("key", *_names("s"))
        ranked = buckets.join(known.hint("merge"), "key").withColumn("rank", F.row_number().over(order) - 1).drop("company")
        rows = self.open_buckets(materialize(ranked, "similar-ranked"))
        self.compare(rows, 0, 0)
        rows = self.open_buckets(rows)
        self.compare(rows.where(F.col("size") <= _SMALL), 1)
        large = rows.where(F.col("size") > _SMALL)
        low, width = 1, 16
        while whole:
            large = self.open_buckets(large)
            last = large.agg(F.max("rank")).first()[0]
            if last is None or low >= last:
                break
            self.compare(large, low, low + width - 1)
            low, width = low + width, width * 16
        return large


def _by_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, key, n, company): sets of the similarity share a bucket, as they share one of their rarest shingles."""
    each = materialize(sets.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "similar-grams")
    shared = each.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    rows = each.join(shared.hint("merge"), "gram").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("grams"))
    # those that no other set has come before all of these
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("grams"))
    rows = rows.withColumn("first", first.cast("int")).where("first > 0")
    buckets = rows.select("key", "n", F.explode(F.slice("grams", 1, F.col("first"))).alias("g")).select(F.col("g.gram").alias("bucket"), "key", "n")
    size = F.count("*").over(W.partitionBy("bucket"))
    buckets = materialize(buckets.withColumn("size", size).where("size > 1"), "similar-prefixes")
    company = buckets.groupBy("key").agg(F.sum("size").alias("company"))
    return buckets.drop("size").join(company.hint("merge"), "key")


def groups(nodes: DataFrame, similarity: float, width: int, blocks: int) -> DataFrame:
    """(key, n, group, size, company) of the nodes (key, n, fp, fours, code) that may be like others: each is in one group, of size nodes."""
    spread = nodes.select("fp").mapInArrow(_spread(width, blocks), "shard long, " + ", ".join(f"{c} long" for c in _names("c", _COMPARED)))
    stars = spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(_stars(radius(similarity)), "a long, b long, size long")
    fours = nodes.select(F.explode("fours").alias("four"), "code")
    hubs = fours.groupBy("four").agg(F.min("code").alias("b"), F.count("*").alias("size")).where("size > 1")
    stars = stars.unionByName(fours.join(hubs.hint("merge"), "four").select(F.col("code").alias("a"), "b", "size"))
    # a node has a hub a block at most, and few in all if those of its shards are the same
    met = materialize(stars.groupBy("a").agg(F.collect_set("b").alias("hubs"), F.sum("size").alias("company")), "similar-met")
    least = F.array_min("hubs").alias("b")
    roots = components(met.select("a", least).unionByName(met.select(F.explode("hubs").alias("a"), least)))
    known = met.select(F.col("a").alias("code"), "company").join(roots.withColumnRenamed("node", "code").hint("merge"), "code", "left")
    # nodes of one code are a group, with or without others
    rows = nodes.select("key", "n", "code").join(known.hint("merge"), "code", "left").select("key", "n", F.coalesce("root", "code").alias("group"), F.coalesce("company", F.lit(0)).alias("company"))
    rows = materialize(rows, "similar-rows")
    sizes = rows.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    return materialize(rows.join(sizes.hint("merge"), "group"), "similar-groups")


def links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, width: int, blocks: int) -> DataFrame:
    """(node, root) of every node (key, n, fp, fours, code) that another one is like; texts has the column text."""
    found = groups(nodes.where("n > 0"), similarity, width, blocks)
    # up to a million keys of 8 bytes are broadcast, so that texts stay where they are read; beyond, texts are shuffled
    mine = join_lookup(texts.mapInArrow(_keyed, "key long, text string"), found.select("key"), ["key"], "left_semi", 1_000_000)
    mine = materialize(mine.groupBy("key").agg(F.min("text").alias("text")).join(found.select("key", "group", "size").hint("merge"), "key"), "similar-texts", "zstd")
    small = mine.where(F.col("size") <= _SMALL).select("group", "key", "text").repartition("group").sortWithinPartitions("group")
    roots = materialize(small.mapInArrow(_group_classes(shingle, similarity), "node long, root long"), "similar-roots")
    large = found.where(F.col("size") > _SMALL)
    if large.isEmpty():
        return roots
    sets = mine.where(F.col("size") > _SMALL).select("key", "text").mapInArrow(_sets(shingle), "key long, grams array<long>, " + ", ".join(f"{s} long" for s in _names("s")))
    search = _Search(materialize(sets, "similar-sets"), similarity)
    large = search.work(large.select(F.col("group").alias("bucket"), "key", "n", "company"), False)
    if not large.isEmpty():
        keys = materialize(large.select("key").distinct(), "similar-large")
        search.work(_by_prefix(search.sets.join(keys.hint("merge"), "key", "left_semi"), similarity), True)
    return roots.unionByName(search.roots)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component): component is the smallest id that links of the similarity reach."""
    width, blocks = shape(docs.count(), similarity)
    words = _COMPARED + -(-width * blocks // 64)
    found = materialize(prints(docs, id_col, text_col, shingle, words), "similar-prints")
    same = [F.min(c).alias(c) for c in ("n", "fp", "fours", "code")]
    nodes = materialize(found.groupBy("key").agg(F.min("id").alias("least"), *same), "similar-nodes")
    roots = links(nodes, docs.select(F.col(text_col).alias("text")), shingle, similarity, width, blocks)
    linked = nodes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    table = materialize(linked.join(least, "root").select("key", "component"), "similar-table")
    return join_lookup(found.select("id", "key"), table, ["key"], "inner").select("id", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, as in `simhash.deduplicate`."""
    return keep_one(docs, id_col, lambda rows: classes(rows.select("row", F.col("doc")[text_col].alias("text")), "row", "text", **options))
