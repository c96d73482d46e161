"""Media columns: interleaved sequences of texts and media references.

Pages are parsed (html.parser) to an ordered array of structs: texts, and references to media with
their caption and digest. Payloads lie in a media table keyed by the digest of their stored form; a
digest join resolves references, and position and caption stay with each. Here the media form is a
grey image of 64 columns with 8-bit samples (binary PGM), one sample for each payload byte.

Defined results: a null text is an empty one; an empty payload has one row of zeros; a null page has
an empty sequence; a reference that no payload answers keeps its position with null features; equal
payloads may be stored more than once and resolve to one row; an empty table gives an empty table. A
caption stands before or behind the media of its figure, with texts between, or before a figure inside of it; an
audio or video without an address takes its first source's; no text of a page is lost where tags for its end,
head or body are missing, or where a script, style, title or template is never closed.
Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROW = 64
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_MEDIA = {"img", "audio", "video"}
_SKIP = {"script", "style", "title", "template"}
#: What may stand in a head; anything else ends it.
_HEAD = {"meta", "link", "base", "noscript"} | _SKIP
_BREAKS = {
    "address", "article", "aside", "blockquote", "br", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "legend", "li", "main", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}


def _spaced(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Figure:
    """An open figure: its media, its caption so far as paragraphs (None: no figcaption), and whether that is still open."""

    def __init__(self, at: int):
        self.at, self.media, self.caption, self.open = at, [], None, False


class _Reader(HTMLParser):
    """Collects items. A figure's caption goes to all media of the figure, before or behind it; one without media is a text.
    A figcaption that nothing closes ends with its first paragraph, or with its figure; one outside of figures is text.
    `unclosed` has the places of elements to skip that turned out not to be closed: they are read like any other."""

    def __init__(self, unclosed: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.head, self.figures, self.player = [], [], False, [], None
        self.skip, self.unclosed = [], unclosed  # open elements to skip, with their places

    def set_cdata_mode(self, *args, **options):
        if not self.unclosed:  # else a script's tags are seen, as the page goes on behind one that isn't closed
            super().set_cdata_mode(*args, **options)

    def add(self, kind: str, text=None, digest=None, caption=None) -> dict:
        self.items.append({"kind": kind, "text": text, "digest": digest, "caption": caption})
        return self.items[-1]

    def figcaption(self) -> _Figure | None:
        """The figure whose caption is being read."""
        return self.figures[-1] if self.figures and self.figures[-1].open else None

    def flush(self):
        text, self.text = _spaced(self.text), []
        if text and (figure := self.figcaption()):
            figure.caption.append(text)
        elif text:
            self.add("text", text)

    def end_figure(self, closed: bool):
        """The innermost figure ends: by its tag, or because another one or the page's end follows."""
        self.flush()
        figure = self.figures.pop()
        said = figure.caption or []
        rest = said[1:] if figure.open and not closed else []
        caption = " ".join(said[: len(said) - len(rest)])
        if not caption and self.figures:  # media without a caption take that of the figure around them
            self.figures[-1].media += figure.media
        elif caption and figure.media:
            for item in figure.media:
                item["caption"] = caption
        elif caption:
            self.items.insert(figure.at, {"kind": "text", "text": caption, "digest": None, "caption": None})
        for text in rest:
            self.add("text", text)

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif self.head and tag not in _HEAD:
            self.head = False
        if tag in _SKIP:
            if self.getpos() not in self.unclosed:
                self.skip.append((tag, self.getpos()))
        elif tag == "body":
            self.skip = []
        elif self.skip:
            return
        elif tag == "source":
            if self.player and not self.player["digest"]:
                self.player["digest"] = (dict(attrs).get("src") or "").removeprefix("sha256:") or None
        elif tag in _MEDIA:
            self.flush()
            given = dict(attrs)
            src = given.get("src") or ""
            item = self.add(tag, None, src.removeprefix("sha256:") or None, given.get("alt") or given.get("title") or None)
            self.player = item if tag != "img" else self.player
            if self.figures:
                self.figures[-1].media.append(item)
        elif tag == "figure":
            self.flush()
            if (outer := self.figcaption()) and outer.media:
                self.end_figure(False)
            elif outer:
                outer.open = False  # its caption came first and waits for media
            self.figures.append(_Figure(len(self.items)))
        elif tag == "figcaption" and self.figures:
            self.flush()
            figure = self.figures[-1]
            figure.open = True
            if figure.caption is None:
                figure.caption, figure.at = [], len(self.items)
        elif tag in _BREAKS or tag == "figcaption":
            self.flush()

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif self.skip:
            while any(t == tag for t, _ in self.skip) and self.skip.pop()[0] != tag:
                pass
        elif tag in ("audio", "video"):
            self.player = None
        elif tag == "figcaption":
            self.flush()
            if self.figcaption():
                self.figures[-1].open = False
        elif tag == "figure" and self.figures:
            self.end_figure(True)
        elif tag in _BREAKS:
            self.flush()

    def handle_data(self, data):
        if self.skip or self.head and not data.strip():
            return
        self.head = False
        self.text.append(data)

    def close(self):
        super().close()
        self.flush()
        while self.figures:
            self.end_figure(False)


def parse_page(html: str | None) -> list[dict]:
    """The page's texts and references, in order. If elements to skip are open at its end, it is read again without skipping those (a
    script hides others from the first reading only, so three readings are the most)."""
    unclosed: frozenset = frozenset()
    while True:
        reader = _Reader(unclosed)
        reader.feed(html or "")
        reader.close()
        if not reader.skip:
            break
        unclosed |= {place for _, place in reader.skip}
    return [{"position": i} | x for i, x in enumerate(reader.items)]


_ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def parse(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items array<ITEM>)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_page(x.as_py()) for x in batch.column(1)], _ITEMS)], names=["id", "items"])

    return rows.mapInArrow(run, rows.select("id", F.expr(f"cast(array() as array<{ITEM}>)").alias("items")).schema)


def encode(data: bytes) -> bytes:
    """data, padded with zeros to rows of 64, as a binary PGM image."""
    rows = max(1, -(-len(data) // ROW))
    return b"P5\n%d %d\n255\n" % (ROW, rows) + data.ljust(rows * ROW, b"\0")


def decode(media: bytes) -> bytes:
    """The samples of a binary PGM image."""
    kind, shape, top, body = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(body) != width * height:
        raise ValueError("not a grey image of 8-bit samples")
    return body


def feature(payload: bytes) -> str:
    """Rows, mean, deviation, and a histogram of 8 bins of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    return f"h{len(samples) // ROW};mean{samples.mean():.6f};std{samples.std():.6f};" + ",".join(map(str, bins))


FEATURES = "digest string, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def store(rows: DataFrame, text_col: str) -> DataFrame:
    """The media table (digest, media) of all texts, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                media = [encode((x.as_py() or "").encode()) for x in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], names=["digest", "media"])

    return materialize(rows.select(F.col(text_col)).mapInArrow(run, "digest string, media binary"), "media", "zstd")


def features(media: DataFrame) -> DataFrame:
    """FEATURES of the stored media, computed from the bytes as read back; one row for each digest."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(0):
                raw = x.as_py()
                payload = decode(raw)
                rows.append((hashlib.sha256(raw).hexdigest(), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = media.select("media").mapInArrow(run, FEATURES)
    return materialize(found.groupBy("digest").agg(*[F.first(n).alias(n) for n in names[1:]]), "media-features")


def resolve(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """(id, position, kind, text, caption, digest, features) of every item, in no order; references meet payloads by digest."""
    items = sequences.select("id", F.explode("items").alias("item")).select("id", "item.*")
    # only references are joined, so that texts are not shuffled; features grow with the corpus: no broadcast at any size
    referred = items.where("digest is not null").join(found.hint("merge"), "digest", "left")
    return referred.unionByName(items.where("digest is null"), allowMissingColumns=True)


def pages_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A page for each row that refers to the row's media by digest, with its size as caption."""

    def run(batches):
        for batch in batches:
            html, size = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                title = escape("none" if name is None else str(name))
                html.append(f'<html><body><h1>{title}</h1><figure><img src="sha256:{hashlib.sha256(encode(data)).hexdigest()}" alt=""><figcaption>{len(data)}</figcaption></figure></body></html>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html)], names=["id", "html"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("id", F.lit("").alias("html")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = features(store(docs, "text"))
    sequences = materialize(parse(pages_of(docs, "doc_id", "text"), "id", "html"), "media-sequences")
    out = resolve(sequences, found).where("kind = 'img'")
    return out.select(
        F.col("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32",
        "media_bytes", F.col("digest").alias("media_sha256"), "feature",
    )


#: Payloads and media as hexadecimal digits; bytes are counted from pieces of 512, so that none is looked for far into.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), p AS (
  SELECT r, doc_id, n, greatest(1, (n + 63) // 64) AS rows, t || repeat('00', greatest(1, (n + 63) // 64) * 64 - n) AS h FROM d
), m AS (
  SELECT *, hex(encode('P5' || chr(10) || '64 ' || rows || chr(10) || '255' || chr(10))) || h AS media FROM p
), c AS (
  SELECT r, substr(h, 1024 * j + 1, 1024) AS c FROM (SELECT r, h, unnest(range(0, (rows + 7) // 8)) AS j FROM p)
), b AS (
  SELECT r, (strpos('0123456789ABCDEF', substr(c, 2 * o + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(c, 2 * o + 2, 1)) - 1 AS v FROM (SELECT r, c, unnest(range(0, length(c) // 2)) AS o FROM c)
), s AS (
  SELECT r, avg(v) AS mean, avg(v * v) AS square, concat_ws(',', count(*) FILTER (v // 32 = 0), count(*) FILTER (v // 32 = 1), count(*) FILTER (v // 32 = 2), count(*) FILTER (v // 32 = 3), count(*) FILTER (v // 32 = 4),
    count(*) FILTER (v // 32 = 5), count(*) FILTER (v // 32 = 6), count(*) FILTER (v // 32 = 7)) AS bins FROM b GROUP BY r
), l AS (
  SELECT r, list_transform(range(0, 64), lambda i: CAST((strpos('0123456789ABCDEF', substr(e, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(e, 2 * i + 2, 1)) - 1 AS BIGINT)) AS bytes FROM (SELECT r, right(h, 128) AS e FROM p)
), k AS (
  SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) AS crc FROM l
)
SELECT m.doc_id, m.n AS n_bytes, m.rows * 64 AS payload_bytes, sha256(unhex(m.h)) AS payload_sha256, k.crc AS tail_crc32, length(m.media) // 2 AS media_bytes, sha256(unhex(m.media)) AS media_sha256,
  'h' || m.rows || ';mean' || printf('%.6f', s.mean) || ';std' || printf('%.6f', sqrt(greatest(0, s.square - s.mean * s.mean))) || ';' || s.bins AS feature
FROM m JOIN s USING (r) JOIN k USING (r)
"""
