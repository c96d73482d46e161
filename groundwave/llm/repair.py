"""Repair of conversation structure by least-cost edits: a bidirectional tight-arc DAG over each conversation.

A conversation's turns are walked with four states: nothing written yet, a system turn, a user turn, an assistant
turn. Arcs are the edits: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an empty user or assistant
turn (3); a truncated turn that is not deleted adds 3, a blank or repeated one has to be deleted. What is written has
role initials `(s?(ua)+)?`. Least costs from the start and least costs to the end are computed for every node; an arc
is tight if cost before + arc + cost behind is the least cost of all, so the tight arcs are exactly those of the
cheapest edits. The audit follows the set of nodes that are reached by the least letters so far and takes, at every
step, the least letter (D < I < K < R) of a tight arc that leaves it.

Two streams do this, each sorted within hash partitions, so no conversation is gathered: the first sees one symbol
for a turn (a byte, and 64 bytes of costs while its conversation is open) and gives counts, cost and audit; the second
gets the audit in front of its conversation's turns and applies it as texts pass.

Defined results: a null role or text is one space; turns go by number, nulls first, those of equal numbers by role and
text; repeated rows are turns; rows with a null conversation form one conversation; an empty table gives an empty
table. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: What blank texts are made of, and the costs of edits.
SPACE = " \t\n\x0b\f\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

_FAR = 1 << 60
#: States: nothing, system, user, assistant. What user or assistant turn may follow; where a kept turn's initial leads.
_NEXT = (2, 2, 3, 2)
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE = {2: "user", 3: "assistant"}


def _arcs(symbol: str) -> list[tuple[str, int, int, int]]:
    """(letter, state before, state behind, cost) of the edits that use up a turn. Symbols: D for a turn that has to go, else its initial, upper case if truncated."""
    arcs = [("D", s, s, DELETE) for s in range(4)]
    if symbol != "D":
        more = TRUNCATED * symbol.isupper()
        arcs += [("K", s, _KEPT[s][symbol.lower()], more) for s in range(4) if symbol.lower() in _KEPT[s]]
        arcs += [("R", s, _NEXT[s], REROLE + more) for s in range(4)]
    return arcs


ARCS = {symbol: _arcs(symbol) for symbol in "DsuaxSUAX"}


def _insertions(costs: list[int], back: bool) -> None:
    for _ in range(3):  # more insertions in a row only come back to a state
        for s, t in enumerate(_NEXT):
            if back:
                costs[s] = min(costs[s], costs[t] + INSERT)
            else:
                costs[t] = min(costs[t], costs[s] + INSERT)


def cheapest(symbols: str) -> tuple[int, str]:
    """Least cost and the audit of a conversation."""
    n = len(symbols)
    before, behind = array("q", [_FAR]) * (4 * n + 4), array("q", [_FAR]) * (4 * n + 4)
    now = [0, _FAR, _FAR, _FAR]
    for i in range(n + 1):
        _insertions(now, False)
        before[4 * i : 4 * i + 4] = array("q", now)
        if i < n:
            old, now = now, [_FAR] * 4
            for _, s, t, cost in ARCS[symbols[i]]:
                now[t] = min(now[t], old[s] + cost)
    now = [0, _FAR, _FAR, 0]
    for i in range(n, -1, -1):
        _insertions(now, True)
        behind[4 * i : 4 * i + 4] = array("q", now)
        if i:
            old, now = now, [_FAR] * 4
            for _, s, t, cost in ARCS[symbols[i - 1]]:
                now[s] = min(now[s], old[t] + cost)
    least = behind[0]
    audit, frontier = [], {(0, 0)}
    while not any(i == n and s in (0, 3) and before[4 * i + s] == least for i, s in frontier):
        leads: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            arcs = [("I", i, _NEXT[s], INSERT)] + ([(letter, i + 1, t, cost) for letter, a, t, cost in ARCS[symbols[i]] if a == s] if i < n else [])
            for letter, j, t, cost in arcs:
                if before[4 * i + s] + cost + behind[4 * j + t] == least:
                    leads.setdefault(letter, set()).add((j, t))
        letter = min(leads)
        audit.append(letter)
        frontier = leads[letter]
    return least, "".join(audit)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows as dicts, with whether a conversation begins; batches are turned to rows in pieces, so little is held."""
    last, first = None, True
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for row in batch.slice(at, 1024).to_pylist():
                yield first or row["conv"] != last, row
                last, first = row["conv"], False


def _audits(batches):
    """conv, counts, cost and audit of the conversations in a sorted stream of turns without texts."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    rows, conv, schema = [], None, None

    def close():
        cost, audit = cheapest(conv["symbols"].decode())
        gaps = conv["hi"] - conv["lo"] + 1 - conv["turns"] if conv["turns"] else 0
        rows.append((conv["conv"], gaps, *conv["counts"], conv["illegal"], cost, audit))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [schema, *[pa.int64()] * 6, pa.string()], strict=True)], names=names)

    def seen(batches):
        nonlocal schema
        for batch in batches:
            schema = batch.schema.field("conv").type
            yield batch

    for new, row in _groups(seen(batches)):
        if new:
            if conv:
                close()
                if len(rows) >= 1024:
                    yield batch_of(rows)
                    rows = []
            conv = {"conv": row["conv"], "symbols": bytearray(), "counts": [0, 0, 0], "illegal": 0, "turns": 0, "lo": None, "hi": None, "last": None}
        if (turn := row["turn"]) is not None:
            conv["lo"] = turn if conv["lo"] is None else conv["lo"]
            conv["turns"] += turn != conv["hi"]
            conv["hi"] = turn
        initial = row["initial"]
        conv["illegal"] += conv["last"] is not None and conv["last"] + initial not in ("su", "ua", "au")
        conv["last"] = initial
        fault = 0 if row["blank"] else 1 if row["duplicate"] else 2 if row["truncated"] else 3
        if fault < 3:
            conv["counts"][fault] += 1
        symbol = "D" if fault < 2 else initial if initial in ("s", "u", "a") else "x"
        conv["symbols"] += (symbol.upper() if fault == 2 else symbol).encode()
    if conv:
        close()
    if rows:
        yield batch_of(rows)


def _edited(batches: Iterator[pa.RecordBatch], write: Callable, close: Callable) -> Iterator:
    """Apply each conversation's audit, the row in front of its turns, as they pass: write(conv, role, text) for every turn that is left."""
    conv, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, _NEXT[state]
            write(conv, _ROLE[state], "")

    for _, row in _groups(batches):
        if row["pos"] == 0:
            if audit:
                inserted()
            yield from close()
            conv, audit, at, state = row["conv"], row["text"], 0, 0
            write(conv, None, None)
            continue
        inserted()
        letter, at = audit[at], at + 1
        if letter == "K":
            state = _KEPT[state][row["role"][:1]]
            write(conv, row["role"], row["text"])
        elif letter == "R":
            state = _NEXT[state]
            write(conv, _ROLE[state], row["text"])
        yield from close(False)
    if audit:
        inserted()
    yield from close()


def _hashes(batches):
    done, now = [], None

    def write(conv, role, text):
        nonlocal now
        if role is None:
            now = [conv, hashlib.sha256(), True]
            done.append(now)
        else:
            now[1].update(("" if now[2] else "\n").encode() + f"{role}:{text}".encode())
            now[2] = False

    def close(whole=True):
        if whole and done:
            conv, digest, _ = done.pop()
            yield conv, digest.hexdigest()

    rows, kind = [], None

    def seen():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv", "repaired_sha256"])
    for row in _edited(seen(), write, close):
        rows.append(row)
        if len(rows) >= 1024:
            yield flush()
            rows = []
    if rows:
        yield flush()


def _turns_left(batches):
    out, n, kind = [], 0, None

    def write(conv, role, text):
        nonlocal n
        n = 0 if role is None else n + 1
        if n:
            out.append((conv, n - 1, role, text))

    def close(whole=True):
        if len(out) >= 256 or whole and out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, pa.int64(), pa.string(), pa.string()], strict=True)], names=["conv", "n", "role", "text"])
            out.clear()

    def seen():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    yield from _edited(seen(), write, close)


def _numbered(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 1), turn, role, text, initial, blank, truncated, key of role and text; written to the shared folder."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(order).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))
    bare = F.rtrim("text", F.lit(SPACE))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    return materialize(rows.withColumns({"initial": F.substring("role", 1, 1), "blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "key": key}), "repair-turns")


def _audit_table(rows: DataFrame) -> DataFrame:
    again = F.row_number().over(Window.partitionBy("conv", "key").orderBy("pos")) > 1
    slim = rows.select("conv", "pos", "turn", "initial", "blank", "truncated", "key").withColumn("duplicate", again).drop("key")
    kind = rows.schema["conv"].dataType.simpleString()
    return slim.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_audits, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    both = rows.select("conv", "pos", "role", "text").unionByName(audits.select("conv", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return both.repartition("conv").sortWithinPartitions("conv", "pos")


def repair(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation that has turns."""
    rows = _numbered(turns, conv, order, role, text)
    audits = materialize(_audit_table(rows), "repair-audits")
    hashes = _with_audits(rows, audits).mapInArrow(_hashes, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
    met = audits.join(hashes.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return met.withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n (0, 1, ...), role, text: the turns of every conversation after the cheapest edits."""
    rows = _numbered(turns, conv, order, role, text)
    audits = materialize(_audit_table(rows), "repair-audits")
    left = _with_audits(rows, audits).mapInArrow(_turns_left, f"conv {rows.schema['conv'].dataType.simpleString()}, n long, role string, text string")
    return left.select(F.col("conv").alias(conv), "n", F.col("role").alias(role), F.col("text").alias(text))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of `conv_id:turn` deals out."""
    space = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault: Column = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(turns)).withColumnRenamed("conv_id", "of")
    out = turns.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same by dynamic programming from the end: a value is the cost in 12 digits and the audit, so the least string is the least cost's least audit.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM summed UNION ALL SELECT * FROM summed WHERE fault = 3) WHERE fault <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), faults AS (
  SELECT conv_id, i, turn, role, text, initial, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, right(bare, 1) NOT IN ('.', '!', '?') AS unended,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM numbered
), judged AS (
  SELECT conv_id, i, turn, role, text, initial, blank, duplicate, illegal, NOT blank AND NOT duplicate AND unended AS truncated, blank OR duplicate AS must FROM faults
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS i, '000000000000' AS v0, '000000000006II' AS vs, '000000000003I' AS vu, '000000000000' AS va FROM counts
  UNION ALL
  SELECT conv_id, i, least(x0, lpad(CAST(CAST(left(xu2, 12) AS BIGINT) + 3 AS VARCHAR), 12, '0') || 'I' || substr(xu2, 13)), least(xs, lpad(CAST(CAST(left(xu2, 12) AS BIGINT) + 3 AS VARCHAR), 12, '0') || 'I' || substr(xu2, 13)), xu2,
    least(xa, lpad(CAST(CAST(left(xu, 12) AS BIGINT) + 3 AS VARCHAR), 12, '0') || 'I' || substr(xu, 13))
  FROM (
    SELECT *, least(xu, lpad(CAST(CAST(left(xa, 12) AS BIGINT) + 3 AS VARCHAR), 12, '0') || 'I' || substr(xa, 13)) AS xu2
    FROM (
      SELECT conv_id, i,
        least(d0, CASE WHEN NOT must THEN r_u END, CASE WHEN NOT must AND initial = 's' THEN k_s WHEN NOT must AND initial = 'u' THEN k_u END) AS x0,
        least(ds, CASE WHEN NOT must THEN r_u END, CASE WHEN NOT must AND initial = 'u' THEN k_u END) AS xs,
        least(du, CASE WHEN NOT must THEN r_a END, CASE WHEN NOT must AND initial = 'a' THEN k_a END) AS xu,
        least(da, CASE WHEN NOT must THEN r_u END, CASE WHEN NOT must AND initial = 'u' THEN k_u END) AS xa
      FROM (
        SELECT w.conv_id, w.i - 1 AS i, r.initial, r.must,
          lpad(CAST(CAST(left(v0, 12) AS BIGINT) + 4 AS VARCHAR), 12, '0') || 'D' || substr(v0, 13) AS d0,
          lpad(CAST(CAST(left(vs, 12) AS BIGINT) + 4 AS VARCHAR), 12, '0') || 'D' || substr(vs, 13) AS ds,
          lpad(CAST(CAST(left(vu, 12) AS BIGINT) + 4 AS VARCHAR), 12, '0') || 'D' || substr(vu, 13) AS du,
          lpad(CAST(CAST(left(va, 12) AS BIGINT) + 4 AS VARCHAR), 12, '0') || 'D' || substr(va, 13) AS da,
          lpad(CAST(CAST(left(vs, 12) AS BIGINT) + 3 * CAST(r.truncated AS INT) AS VARCHAR), 12, '0') || 'K' || substr(vs, 13) AS k_s,
          lpad(CAST(CAST(left(vu, 12) AS BIGINT) + 3 * CAST(r.truncated AS INT) AS VARCHAR), 12, '0') || 'K' || substr(vu, 13) AS k_u,
          lpad(CAST(CAST(left(va, 12) AS BIGINT) + 3 * CAST(r.truncated AS INT) AS VARCHAR), 12, '0') || 'K' || substr(va, 13) AS k_a,
          lpad(CAST(CAST(left(vu, 12) AS BIGINT) + 3 + 3 * CAST(r.truncated AS INT) AS VARCHAR), 12, '0') || 'R' || substr(vu, 13) AS r_u,
          lpad(CAST(CAST(left(va, 12) AS BIGINT) + 3 + 3 * CAST(r.truncated AS INT) AS VARCHAR), 12, '0') || 'R' || substr(va, 13) AS r_a
        FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
      )
    )
  )
), best AS (
  SELECT conv_id, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM walk WHERE i = 0
), letters AS (
  SELECT conv_id, audit, unnest(range(1, CAST(length(audit) AS BIGINT) + 1)) AS spot FROM best
), placed AS (
  SELECT conv_id, spot, substr(audit, spot, 1) AS letter, spot - length(regexp_replace(left(audit, spot), '[^I]', '', 'g')) AS i FROM letters
), written AS (
  SELECT p.conv_id, p.spot, p.letter, r.role, CASE p.letter WHEN 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS e,
    first_value(p.letter = 'K' AND r.initial = 's') OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS headed
  FROM placed p LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.letter <> 'I' WHERE p.letter <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN letter = 'K' THEN role WHEN (e - CAST(headed AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY spot)) AS h FROM written GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
