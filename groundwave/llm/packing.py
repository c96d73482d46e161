"""Packing by lexical retrieval: windows of related documents.

Documents go through in shards of about shard_bytes of text. A shard's task tokenizes them, builds a
BM25 inverted index of their words, and fills windows: a window's first document is the query, the
index returns unused documents by falling score, and they fill the window greedily; the last one is cut
and its rest begins the next window. Documents that share no word with the query come in their order.
What is left at the shard's end goes to sequences whose lengths are powers of two, so nothing is padded.

Tokens are those of the whole text: the tokenizer drops white space, so the ids of a text are those of
its white-space words, which are encoded once for a shard. Texts with a special token's opening are
encoded whole, and all texts are if the tokenizer's file has other rules.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each;
an empty table gives an empty table. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unsliced

WINDOW, END_ID = 4096, 2
SHARD_BYTES = 8 << 20
#: What a row adds to its shard besides its text, so that shards of short and empty ones are bounded too.
ROW_BYTES = 512
_K1, _B = 1.2, 0.75
_CACHE = 200_000


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The rules of a vocabulary that drops white space, so that no token reaches over a word's end.
_WORD_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]


#: The split rule of _WORD_RULES on lower-case ASCII words.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Ids of white-space words, with a bounded memory of words met before. A vocabulary of other rules than _WORD_RULES
    encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.known, self.older = self.tokenizer.model, _byte_letters(), {}, {}
        self.pieces: dict[str, list[int]] = {}
        rules = json.loads(self.tokenizer.to_str())
        steps = [rules["normalizer"], rules["pre_tokenizer"]]
        tokens = [t["content"] for t in rules["added_tokens"]]
        #: Whether ids of a text are those of its words: only by these rules, and if added tokens have an opening that is looked for.
        self.by_word = steps == _WORD_RULES and not rules["post_processor"] and all(t.startswith("<|") for t in tokens)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> list[int]:
        """Ids of an ASCII piece that the rules don't split."""
        if (ids := self.pieces.get(piece)) is None:
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]
            if len(self.pieces) < _CACHE:
                self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> list[int]:
        if word.isascii():
            low = word.lower()
            if word.isalpha():
                return [t.id for t in self.model.tokenize(low)]
            return list(chain.from_iterable(map(self.piece, _ASCII_PIECES.findall(low))))
        if word.isalpha():
            low = word.lower()
            if max(low) < "ɐ" and low.isalpha() and unicodedata.is_normalized("NFC", word):
                return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low.encode())))]
        return self.whole(word)

    def words(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > _CACHE:  # words that come again are kept longer than others
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for w in words:
            if (ids := known.get(w)) is None:
                ids = known[w] = older.get(w) or self.word(w)
            out.append(ids)
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def tokenize(texts: pa.Array, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids' offsets by document, word codes, word codes' offsets); every document ends with END_ID."""
    texts, n = unsliced(texts), len(texts)
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])", r"\1 \2")
    split = pc.ascii_split_whitespace(plain)
    flat = split.flatten()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), lengths)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    # a text that has to be encoded whole stands as one word of its own
    wholes = np.flatnonzero(pc.match_substring(texts, "<|" if encoder.by_word else "").to_numpy(zero_copy_only=False))
    parts, part_owner, used = codes, owner, np.arange(words)
    if len(wholes):
        by_word = ~np.isin(owner, wholes)
        parts, part_owner = codes[by_word], owner[by_word]
        used = np.flatnonzero(np.bincount(parts, minlength=words))
        at = np.searchsorted(part_owner, wholes)
        parts, part_owner = np.insert(parts, at, words + np.arange(len(wholes))), np.insert(part_owner, at, wholes)
    found = encoder.words(coded.dictionary.take(pa.array(used)).to_pylist())
    found += [encoder.whole(texts[int(i)].as_py()) for i in wholes] + [[END_ID]]
    part_offsets = np.searchsorted(part_owner, np.arange(n + 1))
    each = np.fromiter(map(len, found), np.int64, len(found))
    table = np.fromiter(chain.from_iterable(found), np.uint32, int(each.sum()))
    # codes of words, then of whole texts, then the end; words of whole texts alone have no ids
    code = np.append(used, np.arange(words, words + len(wholes) + 1))
    sizes, first = np.zeros(words + len(wholes) + 1, np.int64), np.zeros(words + len(wholes) + 1, np.int64)
    sizes[code], first[code] = each, np.cumsum(each) - each
    # an end code after every document's words
    ended = np.insert(parts, part_offsets[1:], len(sizes) - 1)
    starts, lens = first[ended], sizes[ended]
    ids = table[_ranges(starts, lens)]
    ends = np.concatenate(([0], np.cumsum(lens)))
    return ids, ends[part_offsets + np.arange(n + 1)], codes, np.searchsorted(owner, np.arange(n + 1))


class Bm25:
    """An inverted index of one shard. Words in more than half of the documents have no positive weight and are left out, as the formula says."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = self.n = len(offsets) - 1
        length = np.diff(offsets)
        words = int(codes.max()) + 1 if len(codes) else 0
        doc = np.repeat(np.arange(n), length)
        pair, tf = np.unique(codes * n + doc, return_counts=True)
        word, doc = pair // n, pair % n
        df = np.bincount(word, minlength=words)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        use = (df[word] > 1) & (idf[word] > 0)
        word, self.doc, tf = word[use], doc[use], tf[use]
        norm = _K1 * (1 - _B + _B * length[self.doc] / max(1.0, length.mean()))
        self.weight = idf[word] * tf * (_K1 + 1) / (tf + norm)
        self.first = np.searchsorted(word, np.arange(words + 1))
        order = np.argsort(self.doc, kind="stable")
        self.words_of, self.words_at = word[order], np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        words = self.words_of[self.words_at[doc] : self.words_at[doc + 1]]
        if not len(words):
            return np.zeros(self.n)
        at = _ranges(self.first[words], self.first[words + 1] - self.first[words])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(lengths: np.ndarray, index: Bm25, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    n, used, after = len(lengths), np.zeros(len(lengths), bool), 0
    sequence, pieces, held, rest = 0, [], 0, None

    def neighbours(doc: int) -> Iterator[int]:
        score = index.scores(doc)
        score[used] = 0
        found = np.flatnonzero(score > 0)
        while len(found):  # the best few, then more if they were too short
            few = found[np.argpartition(-score[found], min(31, len(found) - 1))[:32]] if len(found) > 32 else found
            yield from few[np.lexsort((few, -score[few]))].tolist()
            score[few] = 0
            found = found[score[found] > 0]

    ahead: Iterator[int] = iter(())
    while True:
        if rest is not None:
            (doc, start), rest = rest, None
        else:
            doc = next((d for d in ahead if not used[d]), None)
            if doc is None:
                while after < n and used[after]:
                    after += 1
                if after == n:
                    break
                doc = after
            start, used[doc] = 0, True
        if not pieces:
            used[doc] = True
            ahead = neighbours(doc)
        take = min(window - held, int(lengths[doc]) - start)
        pieces.append((doc, start, take, held))
        held += take
        if start + take < lengths[doc]:
            rest = (doc, start + take)
        if held == window:
            for d, s, k, o in pieces:
                yield d, s, k, sequence, o
            sequence, pieces, held, ahead = sequence + 1, [], 0, iter(())
    # the last, open window: sequences of 2^k tokens, the longest first
    room, offset = 0, 0
    for d, s, k, _ in pieces:
        while k:
            if not room:
                sequence, room, offset = sequence + (offset > 0), 1 << (held.bit_length() - 1), 0
                held -= room
            part = min(k, room)
            yield d, s, part, sequence, offset
            s, k, room, offset = s + part, k - part, room - part, offset + part


PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """Rows (id, text) in tables of about shard_bytes: the bytes of their texts and ROW_BYTES for each row."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
        ends, at = size + np.cumsum(lengths), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, shard_bytes)) + 1
            held.append(batch.slice(at, to - at))
            if to > batch.num_rows:
                size = int(ends[-1])
                break
            yield pa.Table.from_batches(held)
            ends, held, at, size = ends - ends[to - 1], [], to, 0
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32 bit). tokenizer: the vocabulary file's path on every machine."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        encoder, sequence = WordEncoder(tokenizer), TaskContext.get().partitionId() << 33
        for shard in shards(batches, shard_bytes):
            shard = shard.combine_chunks()
            ids, offsets, codes, words = tokenize(shard.column(1).combine_chunks() if shard.column(1).num_chunks != 1 else shard.column(1).chunk(0), encoder)
            lengths = np.diff(offsets)
            out = np.array(list(pack_shard(lengths, Bm25(codes, words), window)), np.int64).reshape(-1, 5)
            names = shard.column(0).combine_chunks() if shard.column(0).num_chunks != 1 else shard.column(0).chunk(0)
            for at in range(0, len(out), 4096):
                doc, start, length, seq, offset = out[at : at + 4096].T
                first = offsets[doc] + start
                data = ids[_ranges(first, length)].astype("<u4").tobytes()
                ends = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(start), pa.array(length), binary, pa.array(lengths[doc]), pa.array(seq + sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            if len(out):
                sequence += int(out[:, 3].max()) + 1

    return rows.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def summary(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return summary(pack(read(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer()))
