"""The whole pipeline against plain Python, stage by stage, on a small corpus."""

import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

from groundwave.llm import langid, mixing, packing, pipeline

from .test_pii_graph import brute as brute_spans
from .test_similar import brute as brute_classes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first and after every stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out = docs.columns, [[tuple(r) for r in docs.collect()]]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns or name == "packing"
        rows = docs.collect()
        out.append([tuple(r) for r in rows])
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def letters(text):
    return any(map(str.isalpha, text or ""))


def test_language_by_sums_of_logarithms(spark, stages):
    langs, logp, prior = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    kept = []
    for row in stages[0]:
        if letters(row[1]):
            hashes = np.concatenate([h for _, h in langid._grams(np.array([ord(c) for c in row[1].lower()], np.uint32), len(logp))])
            level = (logp[hashes].sum(0, dtype=np.float64) + prior) * min(1.0, 60 / len(hashes))
            level = np.exp(level - level.max())
            if level.max() / level.sum() >= pipeline.MIN_LANGUAGE_SCORE:
                kept.append(row)
    assert sorted(kept) == sorted(stages[1]) and len(kept) > 0.9 * len(stages[0])


def test_near_duplicates_by_all_pairs(stages):
    classes = brute_classes([(r[0], r[1]) for r in stages[1]])
    assert sorted(stages[2]) == sorted(r for r in stages[1] if classes[r[0]] == r[0])


def test_private_data_by_patterns(stages):
    want = []
    for row, spans in zip(stages[2], brute_spans([r[1] for r in stages[2]]), strict=True):
        out, at = "", 0
        for kind, a, b in [s.split(":") for s in spans.split(",") if s]:
            if int(a) >= at:
                out, at = f"{out}{row[1][at : int(a)]}[{kind.upper()}]", int(b)
            at = max(at, int(b))
        want.append((row[0], out + row[1][at:], *row[2:]))
    assert sorted(want) == sorted(stages[3])


def test_mixture_meets_its_targets(spark, stages):
    size = lambda text: len((text or "").encode().split())
    sizes, taken, known = collections.Counter(), collections.Counter(), collections.Counter(stages[3])
    for r in stages[3]:
        sizes[r[3]] += size(r[1])
    for r, n in collections.Counter(stages[4]).items():
        assert r in known and n <= 3 * known[r]
        taken[r[3]] += n * size(r[1])
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= max(60, 0.02 * r["target"])


def test_packing_holds_every_token(stages):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    want, pieces = collections.Counter(), collections.Counter()
    for r in stages[4]:
        want[r[0]] += len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1
    full = collections.Counter()
    for doc, _, length, _, _, sequence, _ in stages[5]:
        pieces[doc] += length
        full[sequence] += length
    assert pieces == want and all(n == 4096 or n & (n - 1) == 0 for n in full.values())


def test_run_is_its_stages(spark, stages):
    out = pipeline.run(spark, SMALL)
    total = sum(r[2] for r in stages[5])
    assert out.selectExpr("sum(length)").first()[0] == total
