"""Discovery against a plain-Python graph, very long texts, and precision and recall on hidden identifiers."""

import collections
import random
import time

import regex
from pyspark.sql import functions as F

from groundwave.llm import pii

from .test_native import BASE, luhn

SMALL = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string"
TOKEN = r"(?<!\S)(?=[^\s0-9@]*[0-9@])\S+(?: (?=[(]?[0-9])[0-9().-]+)*"
SHAPES = {
    "email": lambda s, n, plain: bool(regex.fullmatch(r"[^@\s]+@[^@\s]+", s)),
    "ip": lambda s, n, plain: bool(regex.fullmatch(r"[0-9a-f]*([.:][0-9a-f]*){3,7}", s)),
    "card": lambda s, n, plain: plain and 12 <= n <= 19,
    "phone": lambda s, n, plain: plain and 7 <= n <= 15,
}


def good(kind, value):
    digits = regex.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def contexts(before, after):
    plain = lambda s: regex.sub("[0-9]+", "0", s).lower()
    words = [w for w in regex.split(r"\s+", plain(before), flags=regex.ASCII) if w]
    out = {" ".join(words[-2:])} if len(words) > 1 else set()
    out |= {words[-1]} if words else set()
    follows = regex.match(r"[,)\"'>\]}]*[ \t\n\r\f\v]+([\p{L}\p{N}]+)", plain(after))
    return out | ({" " + follows[1]} if follows else set())


def found(text):
    """(start, end, kind or None, contexts, instance) of base spans and of tokens that touch none."""
    base, tokens = [], []
    for kind, pattern in [*BASE.items(), (None, TOKEN)]:
        at, rows = 0, list(regex.finditer(pattern, text, flags=regex.ASCII))
        for i, m in enumerate(rows):
            before, after = text[at : m.start()], text[m.end() : rows[i + 1].start() if i + 1 < len(rows) else len(text)]
            at = m.end()
            if kind and good(kind, m[0]):
                base.append((m.start(), m.end(), kind, contexts(before, after), m[0].lower()))
            elif not kind:
                value = m[0].lstrip("\"'(<[{")
                start = m.end() - len(value)
                body = value.rstrip(".,;:!?)\"'>]}")
                if body and (c := contexts(before, value[len(body) :] + after)):
                    tokens.append((start, start + len(body), None, c, body.lower()))
    return base + [t for t in tokens if not any(b[0] < t[1] and b[1] > t[0] for b in base)]


def brute(texts, min_mass=3.0, min_confidence=0.8, min_score=0.75):
    """All spans of every text, by the rules of the module's description."""
    rows = [found(t or "") for t in texts]
    edges = collections.defaultdict(set)
    for r in rows:
        for _, _, kind, patterns, instance in r:
            for p in patterns:
                edges[p, instance] |= {kind} - {None}

    def shaped(kind, s):
        return SHAPES[kind](s, len(regex.sub("[^0-9]", "", s)), not regex.search("[a-z@]", s))

    sizes = collections.Counter((p, k) for (p, s), kinds in edges.items() for k in BASE if k in kinds or shaped(k, s))
    base = {(s, k): 1.0 for (p, s), kinds in edges.items() for k in kinds}
    unseen = {}
    while True:
        mass = collections.Counter()
        score = collections.defaultdict(float)
        for pair, value in [*base.items(), *unseen.items()]:
            score[pair] += value
        for p, s in edges:
            for k in BASE:
                if (s, k) in score:
                    mass[p, k] += score[s, k]
        confident = {key: m / sizes[key] for key, m in mass.items() if m >= min_mass and m / sizes[key] >= min_confidence}
        miss = collections.defaultdict(lambda: 1.0)
        for (p, s), kinds in edges.items():
            for k in BASE:
                if not kinds and (p, k) in confident and shaped(k, s):
                    miss[s, k] *= 1 - 0.99 * min(1.0, confident[p, k])
        new = {pair: 1 - m for pair, m in miss.items() if 1 - m >= min_score}
        if new.keys() == unseen.keys() and all(abs(new[p] - unseen[p]) < 1e-6 for p in new):
            break
        unseen = new
    order = list(BASE)
    out = []
    for r in rows:
        spans = {(a, order.index(k), b) for a, b, k, *_ in r if k}
        for a, b, kind, patterns, s in r:
            kinds = [k for k in order if kind is None and (s, k) in unseen and any((p, k) in confident for p in patterns)]
            if kinds:
                spans.add((a, order.index(kinds[0]), b))
        out.append(",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    return out


def corpus(spark):
    rng = random.Random(7)
    texts = [r["text"] for r in spark.read.parquet(SMALL).collect()]
    phone = lambda: f"{rng.randrange(200, 999)}-555-{rng.randrange(10000):04d}"
    for i in range(40):
        texts.append(f"so {rng.choice(['ring', 'please call', 'phone ' + 'x' * 90])} {rng.choice(['+1 ', '+1 ', ''])}{phone()}{rng.choice([',', '', ' .'])} {rng.choice(['today', 'Tonight', 'at 7pm'])}")
        texts.append(f"host {rng.randrange(300)}.{rng.randrange(300)}.1.{rng.randrange(9)} up, host 10.0.{i} down, write to a{i}@{rng.choice(['localhost', 'mail.example.org'])} now")
    # one instance that base patterns know as two kinds, and tokens that touch base spans
    return texts + ["pay +4495114827612972 now", "pay 4495114827612972 now", "x1+1 234 567 8901y 5@+12345678901", None, ""]


def test_spans_equal_brute_force(spark):
    texts = corpus(spark)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for options in ({}, {"min_mass": 2.0, "min_confidence": 0.5, "min_score": 0.4}):
        want = brute(texts, **options)
        got = {r["id"]: r["s"] for r in pii.detect(df, **options).select("id", pii.digest(F.col("spans")).alias("s")).collect()}
        assert got == dict(enumerate(want))
        assert sum(w.count(":") for w in want) > sum(w.count(":") for w in brute(texts, min_mass=1e9))


def test_masks_replace_the_spans(spark):
    texts = corpus(spark) + ["a +1 4495114827612972 b", "é" * 50 + " +12345678901" * 40 + " end 𝔘"]
    want = []
    for text, spans in zip(texts, brute(texts), strict=True):
        out, at = "", 0
        for kind, a, b in [s.split(":") for s in spans.split(",") if s]:
            if int(a) >= at:
                out, at = f"{out}{text[at : int(a)]}[{kind.upper()}]", int(b)
            at = max(at, int(b))
        want.append(text if text is None else out + text[at:])
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == dict(enumerate(want))


def test_a_long_context_word_is_whole(spark):
    word = "q" * 100 + "z"
    rows = [(i, f"{word} +1 {200 + i} 555-01{10 + i}") for i in range(6)] + [(10, f"{word} 743-555-3824"), (11, f"x{word} 743-555-3825")]
    got = {r["id"] for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).where(F.size("spans") > F.size("base")).select("id").collect()}
    assert got == {10}


def test_time_grows_with_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"call +1 {200 + i % 700} 555-{i % 10000:04d}" for i in range(n)))], SCHEMA)
        began = time.time()
        row = pii.detect(df).select(F.size("base")).first()
        text = pii.mask(df).first()["text"]
        assert row[0] == n and text == " ".join(["call [PHONE]"] * n)
        return time.time() - began

    seconds(500)
    small, large = seconds(8000), seconds(16000)
    assert large < 2 * small + 3


def test_hidden_identifiers_are_found(spark):
    """Every tenth phone lacks the prefix that makes it a base match; numbers of other kinds stand in other contexts."""
    rng = random.Random(11)
    calls, others = ["call", "my phone is", "ring me on", "fax"], ["order", "invoice no", "in", "size"]
    rows, hidden = [], set()
    for i in range(900):
        number = f"{rng.randrange(200, 999)}-555-{rng.randrange(10000):04d}"
        if i % 3 == 0:
            rows.append((i, f"row {i % 7}: {rng.choice(others)} {number} was sent"))
        elif i % 10:
            rows.append((i, f"row {i % 7}: {rng.choice(calls)} +1 {number} please"))
        else:
            rows.append((i, f"row {i % 7}: {rng.choice(calls)} {number} please"))
            hidden.add(i)
    got = {r["id"] for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).where(F.size("spans") > F.size("base")).select("id").collect()}
    assert len(got & hidden) >= 0.95 * len(hidden) and len(got & hidden) >= 0.95 * len(got)
