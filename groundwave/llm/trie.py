"""The prefix trie of conversations by preorder intervals.

A turn becomes a key of 24 bytes (128 bits of SHA-256 of role and text, then the text's bytes), a conversation the
string of its keys. Equal conversations are counted first, so a conversation that many copies share is one row.
Distinct ones are range-partitioned and sorted, which ranks the trie's nodes in preorder: along the sorted stream a
node is met first with its least conversation and last with its greatest. A stack of the open nodes adds up members
as they pass; a node that several partitions meet is put together by its id (SHA-256 along the path). Its number is its place
among all nodes, its subtree ends at the largest number below it; leaves and savings of a subtree are differences of
prefix sums over the numbers, made in blocks of equal length, which no key can skew.

The ids that end at a node are hashed in numeric order: a range-partitioned sort by node and id packs them to chunks
of text, so even a node where a third of all conversations end goes as few rows to the task that hashes it in a stream.

Defined results: a null role or text is empty; turns go by number, nulls first, those of equal numbers by role and
text; repeated rows are turns; rows without a conversation id belong to no conversation; an empty table gives an
empty table. Only the named columns are read, so others can't clash. A conversation's keys (24 bytes a turn) must fit
one row, its texts needn't.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, materialize, read

_KEY, _ID = 24, 16
#: Bits of a place that number the rows of one task; the task's number is above them.
_PLACE = 40
#: Numbers in a block of a prefix sum.
BLOCK = 1 << 16
#: Characters of ids in a chunk.
CHUNK = 1 << 16

_NODES = "id binary, parent binary, depth long, bytes long, at long, end long, n long, conv long"
ROOT = hashlib.sha256(b"").digest()[:_ID]


def turn_keys(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 0), key (hex): the turns of each conversation in order."""
    none = F.lit("")
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(order).alias("turn"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 1
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    size = F.lpad(F.lower(F.hex(F.octet_length("text").cast("long"))), 16, "0")
    return rows.select("conv", pos.alias("pos"), F.concat(F.substring(said, 1, 32), size).alias("key"))


def sequences(keys: DataFrame) -> DataFrame:
    """conv, seq: each conversation's keys as one binary string; a row at pos -1 stands for a conversation that may have no turn."""
    met = keys.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("turns"), F.min("pos").alias("first"))
    return met.where("first = -1").select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("seq"))


def whole(keys: DataFrame) -> DataFrame:
    """keys with the row that stands for each conversation."""
    return keys.unionByName(keys.where("pos = 0").select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("key")))


def _climb(batches):
    """Nodes with the sums of what passed, from distinct conversations in order: seq, n, conv."""
    place = TaskContext.get().partitionId() << _PLACE
    stack: list[list] = []  # id, parent, depth, bytes, at, n, conv
    last, out = b"", []

    def pop(depth: int):
        nonlocal place
        while len(stack) > depth:
            node = stack.pop()
            out.append((*node[:5], place, *node[5:]))
            if stack:
                stack[-1][5] += node[5]
                stack[-1][6] = min(stack[-1][6], node[6])

    def flush():
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.binary(), *[pa.int64()] * 6], strict=True)], names=["id", "parent", "depth", "bytes", "at", "end", "n", "conv"])
        out.clear()
        return batch

    for batch in batches:
        for seq, n, conv in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "conv")), strict=True):
            same, most = 0, min(len(seq), len(last))
            while same < most and seq[same : same + _KEY] == last[same : same + _KEY]:
                same += _KEY
            pop(same // _KEY + 1)
            if not stack:
                place += 1
                stack.append([ROOT, None, 0, 0, place, 0, conv])
            for at in range(same, len(seq), _KEY):
                key, parent = seq[at : at + _KEY], stack[-1]
                place += 1
                stack.append([hashlib.sha256(parent[0] + key).digest()[:_ID], parent[0], parent[2] + 1, int.from_bytes(key[_ID:]), place, 0, conv])
            stack[-1][5] += n
            stack[-1][6] = min(stack[-1][6], conv)
            last = seq
            if len(out) >= 4096:
                yield flush()
    pop(0)
    if out:
        yield flush()


def _chunks(batches):
    """seq, first, ids: the ids of each seq in order, joined to chunks."""
    seq, first, ids, size, out = None, 0, [], 0, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.string()], strict=True)], names=["node", "first", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for s, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (s != seq or size > CHUNK):
                out.append((seq, first, ",".join(ids)))
                ids, size = [], 0
                if len(out) >= 256:
                    yield flush()
            if not ids:
                seq, first = s, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((seq, first, ",".join(ids)))
    if out:
        yield flush()


def _digests(batches):
    node, digest, out = None, None, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.string()], strict=True)], names=["node", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for s, ids in zip(part.column("node").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if s != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = s, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
                if len(out) >= 1024:
                    yield flush()
    if node is not None:
        out.append((node, digest.hexdigest()))
    if out:
        yield flush()


def _last_ids(batches):
    """node, conv: the id of the node where a conversation ends."""
    for batch in batches:
        nodes = []
        for seq in batch.column("seq").to_pylist():
            node = ROOT
            for at in range(0, len(seq), _KEY):
                node = hashlib.sha256(node + seq[at : at + _KEY]).digest()[:_ID]
            nodes.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("conv")], names=["node", "conv"])


def prefix_sums(rows: DataFrame, at: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """rows, numbered 0, 1, ... by at, with the sums of values up to each row, named sum_<value>. Blocks hold equal numbers of rows;
    only their totals, one row in `block`, meet in one task."""
    blocks = rows.withColumn("block", F.floor(F.col(at) / block))
    totals = blocks.groupBy("block").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values]), "trie-offsets")
    within = Window.partitionBy("block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumns({f"sum_{v}": F.sum(v).over(within) for v in values})
    met = join_lookup(summed, offsets, ["block"], "inner")
    return met.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"before_{v}") for v in values}).drop("block", *[f"before_{v}" for v in values])


def trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, depth, parent_conv, n_convs, n_children, n_leaves, saved_bytes, ends_sha256 of every node; seqs has conv (distinct) and seq."""
    spark = seqs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = materialize(seqs, "trie-sequences")
    distinct = materialize(seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv").alias("conv")), "trie-distinct")
    climbed = distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(_climb, _NODES)
    met = climbed.groupBy("id").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("at").alias("at"), F.max("end").alias("end"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
    met = materialize(met, "trie-nodes")

    # a task's own number of a node becomes its number among all: nodes met before are the first ones of a task, so a shift for each task does
    part = lambda c: F.shiftright(F.col(c), _PLACE)
    counts = met.groupBy(part("at").alias("part")).agg(F.count("*").alias("nodes"), F.min("at").alias("least"))
    shifts = counts.select("part", (F.coalesce(F.sum("nodes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("least")).alias("shift"))
    shifts = F.broadcast(materialize(shifts, "trie-shifts"))  # a row for each task at most
    nodes = met.withColumns({"part": part("at"), "end_part": part("end")}).join(shifts, "part").withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")
    nodes = nodes.join(shifts.withColumnRenamed("part", "end_part"), "end_part").withColumn("end", F.col("end") + F.col("shift")).drop("end_part", "shift")
    nodes = nodes.withColumns({"leaf": (F.col("at") == F.col("end")).cast("long"), "saving": (F.col("n") - 1) * F.col("bytes")})
    summed = materialize(prefix_sums(nodes, "at", ["leaf", "saving"], block), "trie-sums")

    ends = summed.select(F.col("at").alias("end"), F.col("sum_leaf").alias("end_leaf"), F.col("sum_saving").alias("end_saving"))
    out = summed.join(ends, "end").withColumns({"n_leaves": F.col("end_leaf") - F.col("sum_leaf") + F.col("leaf"), "saved": F.col("end_saving") - F.col("sum_saving") + F.col("saving")})
    children = summed.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "id")
    parents = summed.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))

    last = seqs.select("seq", "conv").mapInArrow(_last_ids, "node binary, conv long")
    packed = materialize(last.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_chunks, "node binary, first long, ids string"), "trie-ends")
    hashes = packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string").withColumnRenamed("node", "id")
    out = out.join(children, "id", "left").join(hashes, "id", "left").join(parents, "parent", "left")
    return out.select(
        "conv", "depth", "parent_conv", F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_bytes"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of turns as it stands."""
    return trie(sequences(whole(turn_keys(turns, conv, order, role, text))))


def rebuilt(keys: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Keys of conversations that begin with the first h turns of their group's first one, h = crc32(id) mod most,
    and go on with their own. Remainders have the sign of the id, as in SQL."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = keys.where(F.col("pos") >= h)
    heads = keys.where((F.col("pos") < most - 1) & (F.col("conv") % group == 0))
    near = F.filter(F.transform(F.sequence(F.lit(1 - group), F.lit(group - 1)), lambda d: F.try_add(F.col("conv"), d.cast("long"))), lambda c: c - c % group == F.col("conv"))
    given = heads.select(F.explode(near).alias("conv"), "pos", "key").where(F.col("pos") < h)
    marks = keys.where("pos = 0").select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("key"))
    return own.unionByName(given).unionByName(marks)


def query(spark, sf_dir: str) -> DataFrame:
    keys = materialize(turn_keys(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "trie-keys")
    out = trie(sequences(rebuilt(keys)))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), built AS (
  SELECT c.conv_id, b.pos, b.role, b.text FROM convs c JOIN t b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN t o ON o.conv_id = c.conv_id AND o.pos > c.h
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, sha256(length(role) || ':' || role || text) AS k FROM built
), paths AS (
  SELECT conv_id, d, strlen(text) AS bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS node, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent
  FROM placed
), passing AS (
  SELECT conv_id, d, bytes, sha256(node) AS node, sha256(coalesce(parent, '')) AS parent FROM paths
  UNION ALL SELECT conv_id, 0, 0, sha256(''), NULL FROM convs
), lengths AS (
  SELECT conv_id, max(d) AS n FROM passing GROUP BY conv_id
), nodes AS (
  SELECT p.node, p.d, any_value(p.parent) AS parent, any_value(p.bytes) AS bytes, count(*) AS n_convs, min(p.conv_id) AS conv_id,
    sha256(coalesce(string_agg(CASE WHEN l.n = p.d THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM passing p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY p.node, p.d
), kids AS (
  SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node
), below AS (
  SELECT up.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved_tokens
  FROM full_nodes f JOIN passing own ON own.node = f.node AND own.conv_id = f.conv_id JOIN passing up ON up.conv_id = f.conv_id AND up.d <= own.d GROUP BY up.node
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.node = f.node LEFT JOIN nodes p ON p.node = f.parent
"""
