"""Repair of conversations against a search over all edits, with faults and awkward rows."""

import hashlib
import heapq
import itertools
import re
import zlib

import pytest

from groundwave.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def search(symbols):
    """Least (cost, audit) by Dijkstra over (turns used, initials written), without states or tight arcs."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(symbols) and GRAMMAR.fullmatch(out):
            return cost, audit
        if (i, out, audit) in done or len(out) > len(symbols) + 4 or not re.fullmatch(r"s?(ua)*u?", out):
            continue
        done.add((i, out, audit))
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + r))
        if i < len(symbols):
            x = symbols[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if x != "D":
                more = 3 * x.isupper()
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + x.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, out + r))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_audits_are_those_of_a_search_over_all_edits(n):
    for symbols in itertools.product("DsuaxSUAX", repeat=n):
        assert repair.cheapest("".join(symbols)) == search("".join(symbols))


def test_longer_audits():
    for word in ("uauauDDuaX", "suSuaAaU", "aaaauuuu", "xDxUuaua", "suusua"):
        assert repair.cheapest(word) == search(word)


def test_a_long_conversation_takes_time_in_proportion():
    cost, audit = repair.cheapest("ua" * 50_000 + "D")
    assert cost == 4 and audit == "K" * 100_000 + "D"


def brute(rows):
    """The contract, row by row."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in turns:
            last = text.rstrip(SPACE)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            s = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault < 2 else s.upper() if fault == 2 else s
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit = repair.cheapest(symbols)
        left, i = [], 0
        for letter in audit:
            expected = "assistant" if left and left[-1][0][:1] == "u" else "user"
            if letter == "I":
                left.append((expected, ""))
                continue
            _, role, text = turns[i]
            i += 1
            if letter != "D":
                left.append((role if letter == "K" else expected, text))
        assert i == len(turns) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in left))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(9000 + c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("user", "a."), ("user", "b"), ("tool", " "), ("assistant", "c!"), (None, "d."), ("", None), ("system", "e?\n"), ("assistant", "a."), ("user", "a.")])]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y"), (9100, None, None, None), (9100, None, "user", "q."), (9101, 3, "user", "z. "), (9101, 3, "user", "z. "), (9101, 9, "assistant", "é" * 100_000 + ".")]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", conv string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.query(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_an_empty_table_and_written_turns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.query(spark, str(tmp_path)).count() == 0
    turns = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 0, "user", "u."), (2, 1, "user", "u."), (3, 0, "system", " ")], SCHEMA)
    left = sorted(tuple(r) for r in repair.repaired_turns(turns).collect())
    assert left == [(1, 0, "system", "s."), (1, 1, "user", ""), (1, 2, "assistant", "a."), (2, 0, "user", "u."), (2, 1, "assistant", "")]
