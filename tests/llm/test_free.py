"""The operators that run Python in tasks, against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from groundwave.llm import common, langid, media, mixing, packing, quality, similar, simhash, warc
from groundwave.llm.common import shared_folder

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_warc_round_trip(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 200000), (5, "v", "é" * 200000), (6, "u\r\nx: y", "b\r\n\r\nc"), (None, "n", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-test"
    got = warc.read_archives(warc.write_archives(pages, folder, archive_bytes=500), folder).collect()
    assert len(got) == len(rows)
    by = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert by == collections.Counter({(2, "response", None, 1): 1, (1, "revisit", 2, 1): 1, (None, "revisit", 2, 1): 1, (4, "response", None, 0): 1, (3, "revisit", 4, 0): 1, (5, "response", None, 400000): 1, (5, "revisit", 5, 400000): 1, (6, "response", None, 6): 1})
    assert all(r["payload_digest"] == warc.digest(next((h or "").encode() for i, _, h in rows if i == r["page_id"])) for r in got)
    large = warc.read_archives(warc.write_archives(pages.limit(0), folder + "0"), folder + "0")
    assert large.count() == 0


def test_warc_reader_refuses_damage():
    good = warc.record(1, "u", b"payload", None, False) + warc.record(2, "u", b"payload", 1, True)
    assert [p for *_, p in warc.read_records(io.BytesIO(good))] == [b"payload", b""]
    raw = zlib.decompress(warc.record(1, "u", b"payload", None, False), 31)
    for bad in (raw.replace(b"payload", b"pay1oad"), re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", lambda m: b"Content-Length: %d\r\n\r\nHTTP" % (int(m[1]) - 1), raw), raw[:-3]):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(packer.compress(bad) + packer.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))


def test_language_held_out_accuracy(spark):
    out = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3, "en", None, 0) for i in range(9)] + [(20 + i, "der hund und die katze", "de", None, 0) for i in range(9)]
    rows += [(50, None, "en", None, 0), (51, " 12 !", None, None, 0), (None, "und die", None, None, 0), (52, "the dog and " * 90000, None, None, 0), (53, "z", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(7))
    model = langid.fit(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert got[50] == got[51] == ("und", 0.0) and got[None][0] == "de" and got[52][0] == "en" and got[53][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.where("lang is null"))).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_slices_score_the_whole_text():
    rng = np.random.default_rng(1)
    logp, text = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), "aβç d" * 120001
    best, _ = langid.score_batch(["x", text, "yz"], logp, np.zeros(3))
    codes = np.array([ord(c) for c in text], np.uint32)
    want = sum(logp[h].sum(0, dtype=np.float64) for _, h in langid._grams(codes, langid.BUCKETS))
    assert best[1] == want.argmax()


def brute_print(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = [w for w in (text or "").translate(table).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, docs):
    words = docs[0][1].split()
    rows = docs + [(1000 + i, " ".join([*words[:i], "zz", *words[i + 1 :]])) for i in range(0, 60)] + [(2000, None), (2001, " \n"), (2002, "İ one"), (2003, docs[1][1]), (2003, docs[1][1]), (None, docs[2][1])]
    out = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)), max_shard=4).collect()
    prints = {i: brute_print(t) for i, t in rows}
    assert {(r["id"], r["fp"] & (2**64 - 1)) for r in out} == set(prints.items()) and len(out) == len(rows)
    ids = [i for i in prints]
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i in ids:
        if i is not None:
            least[find(i)] = min(least.get(find(i), i), i)
    assert {r["id"]: r["component"] for r in out} == {i: least.get(find(i)) for i in ids}


def test_simhash_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_bk_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    items = np.unique(np.array([b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 12, (60, 2))], np.uint64))
    q, i = simhash.BKTree(items).within(items, 2)
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == {(a, b) for a in range(len(items)) for b in range(len(items)) if (int(items[a]) ^ int(items[b])).bit_count() <= 2}


def test_simhash_deduplicate_keeps_one(spark, docs):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs] + [(5000, docs[0][1], None, None, None), (docs[3][0], docs[3][1], "en", "s", 0)], SCHEMA)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    classes = {r["component"] for r in simhash.classes(df).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert simhash.classes(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_tells_rows_apart(spark):
    schema = "doc_id long, text string"
    many = spark.createDataFrame([(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "unique text of id five which no other row has")], schema)
    none = spark.createDataFrame([(5, "T is a text of some words"), (None, "T is a text of some words"), (None, "U is another text than that one"), (None, "U is  another text than that one")], schema)
    for module in (simhash, similar):
        assert sorted(module.deduplicate(many).collect()) == [(3, "alpha beta gamma delta"), (5, "unique text of id five which no other row has")]
        kept = {tuple(r) for r in module.deduplicate(none).collect()}
        assert len(kept) == 2 and (5, "T is a text of some words") in kept and any(i is None and t.startswith("U") for i, t in kept)


def test_mixing_targets_are_the_fixed_point(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 400), ("d", 0), ("e", 30), (None, 5000)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    target, full = {}, set()
    while True:
        rest = sum(n for _, n in sizes) - sum(3 * n for s, n in sizes if s in full)
        free = sum(weight[s] for s, _ in sizes if s not in full)
        target = {s: 3 * n if s in full else rest * weight[s] / free for s, n in sizes}
        over = {s for s, n in sizes if target[s] > 3 * n}
        if not over:
            break
        full |= over
    assert got == pytest.approx(target)


@pytest.mark.parametrize("seed", range(6))
def test_subset_sums_are_as_near_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(3, 60), 6, replace=False)
    counts = rng.integers(0, 5, 6)
    sums = {sum(int(a) * int(b) for a, b in zip(x, lengths, strict=True)) for x in itertools.product(*[range(c + 1) for c in counts])}
    for budget in (1, 17, 100, int((lengths * counts).sum())):
        take = mixing.knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= 60


def test_subset_sums_of_large_budgets():
    lengths, counts = np.arange(1, 3000) * 7 + 3, np.full(2999, 1000)
    take = mixing.fit_counts(lengths, counts, 9_876_543_210)
    assert (take <= counts).all() and int((take * lengths).sum()) == 9_876_543_210


@pytest.mark.parametrize("n, share", [(40, 0.4), (100, 0.3), (1000, 0.1), (1000, 0.7), (20000, 0.31)])
def test_the_fit_does_not_prefer_a_length(n, share):
    """One rule at every size: the mean length that is taken is that of all documents."""
    means = []
    for seed in range(12):
        lengths, counts = np.unique(np.random.default_rng(seed).lognormal(5.5, 1, n).astype(int) + 1, return_counts=True)
        budget = int(share * (lengths * counts).sum())
        take = mixing.fit_counts(lengths, counts, budget)
        assert abs(int((take * lengths).sum()) - budget) <= 3
        means.append((take * lengths).sum() / take.sum() / ((counts * lengths).sum() / counts.sum()))
    assert abs(np.mean(means) - 1) < (0.05 if n > 40 else 0.15), means


def test_the_fit_of_a_huge_document_needs_little_memory():
    import tracemalloc

    lengths = np.append(np.arange(1, 2001), 40_000_000)
    counts = np.ones(2001, np.int64)
    tracemalloc.start()
    for budget in (1_000_000, 20_000_000, 39_999_000, 41_000_000):
        take = mixing.fit_counts(lengths, counts, budget)
        assert abs(int((take * lengths).sum()) - budget) <= min(budget, abs(budget - 2_001_000), abs(budget - 40_000_000), 60 if budget in (1_000_000, 41_000_000) else 10**9)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_mixing_query(spark):
    rows = mixing.query(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert rows and {tuple(r) for r in rows} == {tuple(r) for r in mixing.query(spark, SMALL).collect()}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    taken = collections.Counter()
    for r in rows:
        taken[source[r["doc_id"]], r["target"], r["source_size"]] += r["taken"]
        assert r["taken"] in {k * r["size"] for k in range(4)}
    assert all(abs(n - t) <= max(60, 0.02 * t) for (_, t, _), n in taken.items())


def test_mixing_edges(spark):
    rows = [(i, "w " * 5, None, "s", 0) for i in range(3000)] + [(1, None, None, None, 0), (2, "", None, "t", 0), (None, "a b", None, None, 0), (1, "same", None, "s", 0), (1, "same", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r["times"] == 0 for r in got if r["size"] == 0)
    out = mixing.repeat(df)
    assert out.columns == df.columns and out.count() == sum(r["times"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    rows = docs + [(900, None), (901, ""), (902, "<|endoftext|> It's <|ENDOFTEXT|> İß ﬁ ½ x̄ é a.b,c... \x85\xa0 12a"), (903, "it" * 9000 + " a" * 9000), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(2)
    pieces = packing.pack(df, path, shard_bytes=120_000).collect()
    want = collections.Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        ids = tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
        assert len(ids) == r["length"] > 0
        parts[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, ids), n in want.items():
        mine = sorted(parts[i])
        copies = len(mine) and sum(s == 0 for s, *_ in mine)
        assert copies == n and all(t == len(ids) for *_, t in mine)
        assert sum(len(x) for _, x, _ in mine) == n * len(ids) and all(ids[s : s + len(x)] == x for s, x, _ in mine)
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_packing_takes_neighbours_first():
    codes, offsets = np.array([0, 1, 2, 9, 3, 4, 5, 9, 0, 1, 2, 9, 6, 7, 9, 9, 8]), np.array([0, 4, 8, 12, 15, 16, 17])
    order = [p[0] for p in packing.pack_shard(np.full(6, 10), packing.Bm25(codes, offsets), 4096)]
    assert list(dict.fromkeys(order))[:2] == [0, 2]


def test_other_vocabularies_encode_whole_texts(docs):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in docs[:40]] + ["two  spaces\n\nand lines", "", None]
    ids, at, codes, words = packing.tokenize(pa.array(texts, pa.string()), encoder)
    assert not encoder.by_word and packing.WordEncoder(packing.default_tokenizer()).by_word
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.whole(t or "") + [2]
        assert words[i + 1] - words[i] >= len((t or "").encode().split())


def test_ranking_equals_the_formula(docs):
    texts = [t for _, t in docs[:60]]
    *_, codes, offsets = packing.tokenize(pa.array(texts), packing.WordEncoder(packing.default_tokenizer()))
    index, bags = packing.Bm25(codes, offsets), [collections.Counter(codes[a:b].tolist()) for a, b in itertools.pairwise(offsets)]
    n, mean = len(bags), len(codes) / len(bags)
    df = collections.Counter(w for bag in bags for w in bag)
    for query in (0, 7, 31):
        want = [sum(max(0.0, np.log((n - df[w] + 0.5) / (df[w] + 0.5))) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for w in bags[query] if df[w] > 1) for bag in bags]
        assert index.scores(query) == pytest.approx(want)


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.default_tokenizer()).count() == 0


def test_slices_are_read_rightly(docs):
    texts = pa.array([None if i % 7 == 0 else t for i, (_, t) in enumerate(docs)])
    encoder = packing.WordEncoder(packing.default_tokenizer())
    part = texts.slice(37, 50)
    for a, b in zip(packing.tokenize(part, encoder), packing.tokenize(pa.array(part.to_pylist()), encoder), strict=True):
        assert (a == b).all()
    assert all((quality.measure(part)[m] == quality.measure(pa.array(part.to_pylist()))[m]).all() for m in quality.MEASURES)


def brute_measure(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(grams)
    marked = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_measures_equal_brute_force(docs):
    texts = [t for _, t in docs] + [None, "", "\n\n \x0b", "a b c d e f g h " * 3, "x\nx\n x\nx", "one two", "a|b<c>", "w " * 5000, "\x85a \xa0b"]
    got = quality.measure(pa.array(texts))
    assert [tuple(int(got[m][i]) for m in quality.MEASURES) for i in range(len(texts))] == [brute_measure(t) for t in texts]


def test_quality_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good, None, "good", 0) for i in range(200)] + [(300 + i, bad if i % 10 else good, None, "bad", 0) for i in range(200)] + [(600, bad, None, "once", 0), (601, good, None, "one", 0), (602, None, None, None, 0), (603, good, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1))
    got = {r["id"]: r["kept"] for r in quality.judge(df).collect()}
    assert len(got) == len(rows) and all(got[i] for i in range(200)) and not any(got[300 + i] for i in range(200))
    assert not got[600] and got[601] and not got[602] and quality.judge(df.limit(0)).count() == 0


def test_media_round_trip(spark, docs):
    rows = docs + [(900, None), (901, ""), (902, "x" * 64), (903, "\x00é"), (903, "\x00é"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    found = media.features(media.store(df, "text"))
    out = media.resolve(media.parse(media.pages_of(df, "doc_id", "text"), "id", "html"), found).where("kind = 'img'").collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        data = (text[r["id"]] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        form = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (int(r["caption"]), r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["digest"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest())
    assert media.features(media.store(df.limit(0), "text")).count() == 0


def test_media_parsing_keeps_order_and_captions():
    page = "<html><head><title>no</title></head><body><p>one<img src='sha256:ab' alt='A'>two</p><script>x('<p>')</script><figure><video src=v.mp4></video><figcaption>cap <b>bold</b></figcaption></figure>tail &amp; end<img></body>"
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse_page(page)]
    assert got == [(0, "text", "one", None, None), (1, "img", None, "ab", "A"), (2, "text", "two", None, None), (3, "video", None, "v.mp4", "cap bold"), (4, "text", "tail & end", None, None), (5, "img", None, None, None)]
    assert media.parse_page(None) == media.parse_page("") == []


def test_captions_stay_with_their_figures():
    rows = {
        "<figure><figcaption>A</figcaption><img src=a></figure>": [("img", None, "a", "A")],
        "<figure><img src=a></figure><figure><figcaption>B</figcaption><img src=b></figure>": [("img", None, "a", None), ("img", None, "b", "B")],
        "<figure><img src=a>between<figcaption>C</figcaption></figure>after": [("img", None, "a", "C"), ("text", "between", None, None), ("text", "after", None, None)],
        "<p>x<figure><img src=a><figcaption>cap<p>more<p>rest": [("text", "x", None, None), ("img", None, "a", "cap"), ("text", "more", None, None), ("text", "rest", None, None)],
        "<figure><img src=a><figcaption>one<p>two</figure>z": [("img", None, "a", "one two"), ("text", "z", None, None)],
        "<figure><img src=a><img src=b alt=x><figcaption>both</figcaption></figure>": [("img", None, "a", "both"), ("img", None, "b", "both")],
        "<head><title>t</title><meta charset=utf-8><p>hello": [("text", "hello", None, None)],
        "<title>t</title>plain <b>bold</b> text": [("text", "plain bold text", None, None)],
        "<head>text here": [("text", "text here", None, None)],
        "<figure><figcaption>lone</figcaption></figure>z<figcaption>loose</figcaption>": [("text", "lone", None, None), ("text", "z", None, None), ("text", "loose", None, None)],
    }
    for page, want in rows.items():
        assert [(x["kind"], x["text"], x["digest"], x["caption"]) for x in media.parse_page(page)] == want, page


def brute_text(html):
    """All words of a page, by patterns."""
    import html as entities

    html = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", html or "")
    inline = re.sub(r"</?(?:b|i|a|em|strong|span|u|code|small|sup|sub)\b[^>]*>", "", html)
    return entities.unescape(re.sub(r"<[^>]*>", " ", inline)).split()


def test_all_pages_are_parsed_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["id"]: r["items"] for r in media.parse(pages, "page_id", "html").collect()}
    assert got.keys() == html.keys()
    for i, items in got.items():
        assert [x["position"] for x in items] == list(range(len(items)))
        assert " ".join(x["text"] for x in items if x["kind"] == "text").split() == brute_text(html[i]), i


def test_items_without_digest_need_no_join(spark):
    page = "<p>one</p><img src=sha256:none><img alt=x><p>two</p>"
    sequences = media.parse(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html")
    found = media.features(media.store(spark.createDataFrame([("a",)], "text string"), "text"))
    rows = sorted(media.resolve(sequences, found).select("position", "kind", "text", "caption", "feature").collect())
    assert rows == [(0, "text", "one", None, None), (1, "img", None, None, None), (2, "img", None, "x", None), (3, "text", "two", None, None)]


def test_language_counts_equal_brute_force(spark, docs):
    rows = [(i, t, "en" if i % 2 else "de", None, 0) for i, t in docs[:50]] + [(9000, "aé", None, None, 0), (9001, None, "en", None, 0), (None, "xyz", "de", None, 0)]
    langs, logp, prior = langid.fit(spark.createDataFrame(rows, SCHEMA))
    counts, n = {"de": np.zeros(langid.BUCKETS), "en": np.zeros(langid.BUCKETS)}, collections.Counter()
    for i, text, lang, *_ in rows:
        if i is not None and lang and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            n[lang] += 1
            for order in langid.ORDERS:
                for at in range(len(text.lower()) - order + 1):
                    (_, h), = [x for x in langid._grams(np.array([ord(c) for c in text.lower()[at : at + order]], np.uint32), langid.BUCKETS) if x[0] == order]
                    counts[lang][h[0]] += 1
    assert langs == ["de", "en"] and prior == pytest.approx(np.log([n["de"] / n.total(), n["en"] / n.total()]))
    for j, lang in enumerate(langs):
        assert logp[:, j] == pytest.approx(np.log((counts[lang] + 0.5) / (counts[lang].sum() + 0.5 * langid.BUCKETS)), rel=1e-5)


def test_tables_of_a_scope_are_deleted(spark):
    from pyarrow import fs

    with common.scratch():
        table = common.materialize(spark.range(3), "scoped")
        assert table.count() == 3
    system, folder = fs.FileSystem.from_uri(shared_folder(spark))
    assert not [x for x in system.get_file_info(fs.FileSelector(folder)) if "scoped-" in x.path]


def test_pipeline_stages_hand_on_documents(spark):
    from groundwave.llm import pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert docs.count() > 0
    last = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.agg(F.sum("length")).first()[0] == sum(r["doc_tokens"] for r in last.where("start = 0").collect())
