"""SimHash near-duplicates: 64-bit fingerprints, BK-trees for the radius search, connected classes.

Fingerprints are made in tasks. Equal ones become one node. For the search, every node goes to
several shards by some of its bits: of `blocks` blocks of bits, a pair within the radius agrees in all
but `radius` of them, so it meets in a shard. Each shard's task builds a BK-tree (children keyed by
the Hamming distance to their parent) and follows only edges within the radius of the query's
distance. A shard over max_shard nodes is split again by blocks of its remaining bits, which loses no
pair; after three splits a shard can't hold more than 4096 nodes, as so few bits are left to differ.
A task hands on a star of each local class, not its pairs, and stars are joined to classes by
alternating large-star and small-star steps, each written to the shared folder.

Defined results: a null text counts as empty; a text without a word has fingerprint 0, linked like
any other; a text of fewer words than a shingle is one shingle; null ids are ignored when the
smallest id is sought; repeated rows get equal results; an empty table gives an empty table. Only the
named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, scratch, whole_row

SHINGLE, RADIUS, SEED = 3, 2, 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; a bit is 1 if set in over half of their XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)), repeat(SEED)))
        counts += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long), fp being the fingerprint's bits."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("id", F.lit(0).cast("long").alias("fp")).schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of numbers, or of rows of words."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(1, dtype=np.int64)


class BKTree:
    """A BK-tree over 64-bit numbers or rows of them, built and searched level by level in numpy; with roots (for each
    item the first of its tree) one for each root."""

    def __init__(self, items: np.ndarray, roots: np.ndarray | None = None):
        self.items, n = items, len(items)
        self.first, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        edges_parent, edges_dist, edges_child = [], [], []
        at, parent = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        if roots is not None:
            at = np.flatnonzero(roots != np.arange(n))
            parent = roots[at]
        while len(at):
            dist = _distance(items[at], items[parent])
            order = np.lexsort((at, dist, parent))
            at, parent, dist = at[order], parent[order], dist[order]
            new = np.ones(len(at), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (dist[1:] != dist[:-1])
            edges_parent.append(parent[new])
            edges_dist.append(dist[new])
            edges_child.append(at[new])
            parent = at[new][np.cumsum(new) - 1]  # a node's later siblings at the same distance go below it
            at, parent = at[~new], parent[~new]
        if edges_parent:
            parent, dist, child = map(np.concatenate, (edges_parent, edges_dist, edges_child))
            order = np.lexsort((dist, parent))
            self.dist, self.child = dist[order], child[order]
            self.first = np.searchsorted(parent[order], np.arange(n))
            self.count = np.bincount(parent, minlength=n)
        else:
            self.dist = self.child = np.zeros(0, np.int64)

    def within(self, queries: np.ndarray, radius: int, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index into queries, index into items) of all pairs within radius; roots are those of the queries' trees."""
        found_q, found_i = [], []
        q, node = np.arange(len(queries)), np.zeros(len(queries) if len(self.items) else 0, np.int64)
        q = q[: len(node)]
        if roots is not None:
            node = roots
        while len(node):
            dist = _distance(queries[q], self.items[node])
            hit = dist <= radius
            found_q.append(q[hit])
            found_i.append(node[hit])
            n = self.count[node]
            edge = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, dist = np.repeat(q, n), np.repeat(dist, n)
            follow = np.abs(self.dist[edge] - dist) <= radius
            q, node = q[follow], self.child[edge[follow]]
        return (np.concatenate(found_q), np.concatenate(found_i)) if found_q else (np.zeros(0, np.int64),) * 2


def local_roots(items: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """For each item the index of the first item of its class; links are those within radius."""
    tree, root = BKTree(items), np.arange(len(items))
    for at in range(0, len(items), block):
        q, i = tree.within(items[at : at + block], radius)
        for a, b in zip((q + at).tolist(), i.tolist(), strict=True):
            if a < b:
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    return root


def _sub_masks(bits: list[int], blocks: int, radius: int, used: int = 0) -> list[int]:
    """Masks that keep `used` and all but `radius` of `blocks` blocks of the bits, as signed longs."""
    parts = [list(map(int, p)) for p in np.array_split(bits, blocks)]
    masks = [used | sum(1 << b for p in keep for b in p) for keep in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(nodes: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """(a, b): stars of the local classes of every shard."""
    blocks = radius + 3
    masks = _sub_masks(list(range(64)), blocks, radius)
    keyed = nodes.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    stars, level = None, 0
    while True:
        keyed = materialize(keyed, "simhash-shards")
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n"))
        live = materialize(sizes.where("n > 1"), "simhash-sizes")
        small = join_lookup(keyed, live.where(F.col("n") <= max_shard).drop("n"), ["mask", "bits"], "left_semi") if level < 3 else join_lookup(keyed, live.drop("n"), ["mask", "bits"], "left_semi")
        out = materialize(small.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(_stars(radius), "a long, b long"), "simhash-stars")
        stars = out if stars is None else stars.unionByName(out)
        large = live.where(F.col("n") > max_shard)
        if level == 3 or large.isEmpty():
            return stars
        subs = []
        for m in masks:
            u = m & (2**64 - 1)
            subs.append((m, _sub_masks([b for b in range(64) if not u >> b & 1], radius + 1, radius, u)))
        table = F.create_map(*[x for m, s in subs for x in (F.lit(m), F.array(*map(F.lit, s)))])
        keyed = join_lookup(keyed, large.drop("n"), ["mask", "bits"], "left_semi").select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        masks, level = [m for _, s in subs for m in s], level + 1


def _stars(radius: int):
    def run(batches):
        mask = bits = np.zeros(0, np.int64)
        fps = np.zeros(0, np.int64)

        def emit(mask, bits, fps):
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            a, b = [], []
            for part in np.split(fps, cut):
                root = local_roots(part.view(np.uint64), radius)
                off = root != np.arange(len(part))
                a.append(part[off])
                b.append(part[root[off]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "bits", "fp")}
            mask, bits, fps = np.append(mask, col["mask"]), np.append(bits, col["bits"]), np.append(fps, col["fp"])
            if len(fps) and (done := np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))).size:
                at = done[-1] + 1  # the last shard may go on in the next batch
                yield emit(mask[:at], bits[:at], fps[:at])
                mask, bits, fps = mask[at:], bits[at:], fps[at:]
        if len(fps):
            yield emit(mask, bits, fps)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node it reaches, by large-star and small-star steps."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e):
        e = both(e)
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e):
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(least, "a")
        return joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()

    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = materialize(edges.where("a <> b").distinct(), "classes")
    before = state(edges)
    while before[0]:
        edges = materialize(small(large(edges)), "classes")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, max_shard: int = 2048) -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(_links(nodes.select("fp"), radius, max_shard))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    table = materialize(linked.join(least, "root").select("fp", "component"), "simhash-table")
    return join_lookup(prints, table, ["fp"], "inner").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one document of each class: the row with the class's smallest id, null ids last; of rows
    with that id the first as stored. Rows are told apart by a number, so one id may have several texts."""
    return keep_one(docs, id_col, lambda rows: classes(rows.select("row", F.col("doc")[text_col].alias("text")), "row", "text", **options))


def keep_one(docs: DataFrame, id_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without all but one row of each class. find takes (row, doc struct) and gives (id, component), id being the row."""
    rows = materialize(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows", "zstd")
    name = F.col("doc")[id_col]
    ids = rows.select("row", name.isNull().alias("nameless"), name.alias("name"))
    with scratch():  # of what find writes only keep lasts
        met = ids.join(find(rows).select(F.col("id").alias("row"), "component").hint("merge"), "row")
        keep = materialize(met.groupBy("component").agg(F.min(F.struct("nameless", "name", "row")).alias("least")).select("least.row"), "keep", outer=True)
    # the rows kept grow with the corpus: always a shuffled join, at any size
    return rows.join(keep.hint("merge"), "row", "left_semi").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
