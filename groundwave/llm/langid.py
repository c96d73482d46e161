"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of lower-case text by language and bucket, in tasks;
the log-probability matrix (buckets x languages, at most max_cells numbers) is broadcast. Scoring is
sparse: an n-gram costs one row of the matrix, summed for each document of a batch in numpy.

The fit takes all labelled rows, or, beyond max_train_rows of them, the rows whose id hash lies under
the share that makes about max_train_rows: the one bound here, a parameter of fit().

Defined results: a null text or one without a letter is `und` with score 0; without a labelled row
all are `und`; a null id is not held out and not learnt from; ties go to the language first by code
point; repeated rows get equal results; an empty table gives an empty table; whole texts are scored,
their n-grams in slices. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
_SLICE = 1 << 18
#: N-grams count as independent up to this number when scores are made of likelihoods.
_EVIDENCE = 60.0
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _grams(codes: np.ndarray, buckets: int):
    """Hashed n-grams of a run of code points, order by order, with the place each begins at."""
    codes = codes.astype(np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            return
        h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield n, h & np.uint32(buckets - 1)


def _texts(batch: pa.RecordBatch, i: int) -> list[str | None]:
    return batch.column(i).to_pylist()


def _slices(text: str):
    """Lower-case code points in slices that overlap so that every n-gram lies in one of them. The whole text is lower-cased
    before it is cut, as lower case may be longer."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(codes)), _SLICE):
        yield codes[at : at + _SLICE + ORDERS[-1] - 1], at + _SLICE < len(codes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_rows: int = 2_000_000, max_cells: int = 1 << 24, buckets: int = BUCKETS):
    """(languages, float32 matrix buckets x languages, log priors) of the rows that are not held out."""
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = max_train_rows / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(_texts(batch, 0), _texts(batch, 1), strict=True):
                mine = sums.setdefault(lang, np.zeros(buckets, np.int64))
                n[lang] = n.get(lang, 0) + 1
                for codes, more in _slices(text):
                    for order, h in _grams(codes, buckets):
                        if more:
                            h = h[: _SLICE]
                        mine += np.bincount(h, minlength=buckets)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(mine[at], n[lang]))], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in counts.where("bucket = -1").select("lang").limit(max_cells // buckets + 1).collect())
    if len(langs) * buckets > max_cells:
        raise ValueError(f"more than {max_cells // buckets} languages: raise max_cells or lower buckets")
    if not langs:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0)
    matrix, docs_of = np.zeros((buckets, len(langs))), np.ones(len(langs))
    for batch in counts.toArrow().to_batches():
        code = pc.index_in(batch.column("lang"), pa.array(langs)).to_numpy(zero_copy_only=False)
        bucket, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
        of_docs = bucket < 0
        docs_of[code[of_docs]] = n[of_docs]
        matrix[bucket[~of_docs], code[~of_docs]] = n[~of_docs]
    logp = np.log((matrix + 0.5) / (matrix.sum(0) + 0.5 * buckets))
    return langs, logp.astype(np.float32), np.log(docs_of / docs_of.sum())


def score_batch(texts: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, score) of every text; gathers matrix rows and sums them document by document."""
    out, n_grams = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts))

    # rows of the matrix that are gathered at a time: few if there are many languages
    size = min(_SLICE, max(1 << 12, (1 << 24) // max(1, logp.shape[1])))

    def total(h: np.ndarray) -> np.ndarray:
        return sum(logp[h[at : at + size]].sum(0, dtype=np.float64) for at in range(0, len(h), size))

    def add(group: list[int], parts: list[np.ndarray]):
        codes, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for order, h in _grams(codes, len(logp)):
            for i, a, b in zip(group, starts, ends - order + 1, strict=True):
                if b > a:
                    out[i] += total(h[a:b])
                    n_grams[i] += b - a

    group, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for codes, more in _slices(text):
            if more:  # a slice in the middle of a text: its last n-grams of lower order belong to the next one
                for order, h in _grams(codes, len(logp)):
                    out[i] += total(h[:_SLICE])
                    n_grams[i] += min(len(h), _SLICE)
                continue
            group.append(i)
            parts.append(codes)
            held += len(codes)
        if held >= _SLICE:
            add(group, parts)
            group, parts, held = [], [], 0
    if group:
        add(group, parts)
    best = (out + prior).argmax(1)
    level = (out + prior) * np.minimum(1.0, _EVIDENCE / np.maximum(n_grams, 1))[:, None]
    level = np.exp(level - level.max(1, keepdims=True))
    return best, (level / level.sum(1, keepdims=True))[np.arange(len(texts)), best]


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id (and the columns in keep), lang_pred, score."""
    langs, logp, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp, prior))
    rows = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches):
        names, matrix, base = shared.value
        for batch in batches:
            texts = _texts(batch, batch.num_columns - 1)
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            use = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if names else []
            if use:
                best, level = score_batch([texts[i] for i in use], matrix, base)
                for i, b in zip(use, best, strict=True):
                    pred[i] = names[b]
                score[use] = level
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
