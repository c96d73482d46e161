"""Personal data: fixed base patterns plus bootstrapped contextual extraction, in Spark expressions only.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. They are the
seeds: the two words and the word before a seed and the word after it are lexical patterns; every
identifier-like token (one with a digit or an @) is an instance. The bipartite graph pattern - instance
is scored in rounds, until nothing changes: a pattern's confidence for a kind is the mass of its instances
known to be of that kind over its instances of the kind or its coarse shape, an unseen instance's score is
the noisy-or over its confident patterns. Tokens that stand at a confident pattern, score high and have the
kind's coarse shape become additional spans.

The texts are read once: what a pattern matches leaves them as an array of matches with the lengths of the
gaps between. Places are sums over those gaps in a window, and whether a token touches a base span is a
running maximum, so time grows with a text's length and not with its square. Rows are numbered, so that
copies of one text, or rows without an id, are no hot key.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; repeated
rows get equal results; other columns of the input are kept aside and can't clash (only id and text
are read); an empty table gives an empty table. A pattern's words are whole, however long; those before a
match reach back to the last match of the same expression at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, whole_row

#: The kinds, in their order within equal starts.
KINDS = ("email", "ip", "card", "phone")

# The base patterns, written with possessive quantifiers so that java.util.regex neither recurses nor
# backtracks on long runs; look-behinds skip starts inside a run, which can't match when its start doesn't.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that must hold before a pattern is tried on a text.
_GATES = {"email": "@", "phone": "+"}
_GATE_REGEX = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A token with a digit or @, and the groups of digits that follow it.
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]*[0-9@])\S++(?: (?=[(]?[0-9])[0-9().-]++)*+"
#: The last two words of a reversed gap, and the next word behind a match in the same sentence.
_LAST_WORDS = r"\A\s*+\S*+(?:\s++\S++)?+"
_NEXT_WORD = r"\A[,)\"'>\]}]*+\s++([\p{L}\p{N}]++)"

HIT = "struct<pattern:int,no:int,gap:int,value:string,before:string,after:string>"
SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"
_CANDIDATE_NO = len(KINDS)


def _matches(no: int, text: Column, pattern: str) -> Column:
    """array<HIT>: all matches in order, each with the length of the gap before it and the words around it."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(values.alias("value"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"))

    def hit(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(no).alias("pattern"), i.alias("no"), F.length(x["gap"]).alias("gap"), x["value"].alias("value"),
            F.reverse(F.regexp_extract(F.reverse(x["gap"]), _LAST_WORDS, 0)).alias("before"), F.regexp_extract(x["next"], _NEXT_WORD, 0).alias("after"),
        )

    return F.transform(F.filter(zipped, lambda x: x["value"].isNotNull()), hit).cast(f"array<{HIT}>")


def hits(text: Column) -> Column:
    """array<HIT> of the base patterns and of identifier-like tokens."""
    none = F.array().cast(f"array<{HIT}>")
    parts = []
    for no, kind in enumerate(KINDS):
        gate = F.contains(text, F.lit(_GATES[kind])) if kind in _GATES else text.rlike(_GATE_REGEX[kind])
        parts.append(F.when(gate, _matches(no, text, PATTERNS[kind])).otherwise(none))
    parts.append(F.when(text.rlike("[0-9@]"), _matches(_CANDIDATE_NO, text, CANDIDATE)).otherwise(none))
    return F.concat(*parts)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(pattern: Column, value: Column) -> Column:
    digits = _digits(value)
    return (
        F.when(pattern == KINDS.index("email"), True)
        .when(pattern == KINDS.index("ip"), value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(pattern == KINDS.index("card"), F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(pattern == KINDS.index("phone"), F.length(digits).between(10, 15))
    )


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns: the last two words and the last word before the instance, and behind a space the
    word after it in the same sentence; lower case, figures as 0."""
    plain = lambda text: F.lower(F.regexp_replace(text, "[0-9]+", "0"))
    words = F.filter(F.split(plain(before), r"\s+"), lambda w: w != "")
    last = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " "))
    follows = F.regexp_extract(plain(after), _NEXT_WORD, 1)
    return F.array_compact(F.array(last(2), last(1), F.when(follows != "", F.concat(F.lit(" "), follows))))


def _shape(kind: Column, instance: Column) -> Column:
    """The kind's coarse shape, which an unseen instance must have."""
    n = F.length(_digits(instance))
    plain = ~instance.rlike("[a-z@]")
    return (
        F.when(kind == "email", instance.rlike(r"^[^@\s]+@[^@\s]+$"))
        .when(kind == "ip", instance.rlike(r"^[0-9a-f]*(?:[.:][0-9a-f]*){3,7}$"))
        .when(kind == "card", plain & n.between(12, 19))
        .when(kind == "phone", plain & n.between(7, 15))
        .otherwise(F.lit(False))
    )


def _name(no: Column) -> Column:
    return F.coalesce(*[F.when(no == i, kind) for i, kind in enumerate(KINDS)])


def mentions(found: DataFrame) -> DataFrame:
    """(row, start, end, kind_no, patterns, instance) of found (row, hits), as a written table: base spans, and with a
    null kind_no the identifier-like tokens that touch none and have a context."""
    each = found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    end = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy("row", "pattern").orderBy("no").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    token = F.col("pattern") == _CANDIDATE_NO
    each = each.where(token | _valid(F.col("pattern"), F.col("value")))
    # of a token, brackets and quotes before it and marks after it are no part
    lead = F.when(token, F.length(F.regexp_extract("value", r"\A[\"'(<\[{]++", 0))).otherwise(0)
    each = each.withColumn("lead", lead).withColumn("rest", F.substring(F.col("value"), F.col("lead") + 1, F.length("value")))
    tail = F.when(token, F.reverse(F.regexp_extract(F.reverse("rest"), r"\A[.,;:!?)\"'>\]}]++", 0))).otherwise("")
    each = each.withColumn("tail", tail).withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("end") - F.length("tail"))
    each = each.withColumn("instance", F.lower(F.substring(F.col("rest"), F.lit(1), F.length("rest") - F.length("tail"))))
    each = each.select("row", "start", "end", "pattern", _contexts(F.col("before"), F.concat("tail", "after")).alias("patterns"), "instance", token.alias("token"))
    up = W.partitionBy("row").orderBy("start", "pattern").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("row").orderBy(F.desc("start"), F.desc("pattern")).rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("last", F.max(F.when(~F.col("token"), F.col("end"))).over(up)).withColumn("next", F.min(F.when(~F.col("token"), F.col("start"))).over(down))
    free = (F.col("end") > F.col("start")) & (F.size("patterns") > 0) & ~F.coalesce(F.col("last") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    kind_no = F.when(~F.col("token"), F.col("pattern"))
    return materialize(each.where(~F.col("token") | free).select("row", "start", "end", kind_no.alias("kind_no"), "patterns", "instance"), "pii-mentions")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: (row, id, hits), as a written table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", hits(text).alias("hits")), "pii-hits")


def bootstrap(found: DataFrame, min_mass: float = 3.0, min_confidence: float = 0.8, min_score: float = 0.75) -> DataFrame | None:
    """Score the pattern-instance graph of mentions; (row, start, kind_no, end) of the additional spans, or None if there are none.

    Every edge counts once however often it is seen, so copies of a text lend a pattern no support.
    An instance that has not the coarse shape of a kind says nothing about a pattern for it. An instance that
    base patterns know as two kinds counts for both.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", _name(F.col("kind_no")).alias("kind"))
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "pii-edges")
    shaped = F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains("kinds", k) | _shape(k, F.col("instance")))
    sizes = materialize(edges.select("pattern", F.explode(shaped).alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("n")), "pii-sizes")
    base = materialize(edges.select("instance", F.explode("kinds").alias("kind")).distinct().withColumn("score", F.lit(1.0)), "pii-known")
    known, before = base, None
    while True:
        # a pattern can only become confident with min_mass instances at least
        mass = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).where(F.col("mass") >= min_mass)
        confident = mass.join(sizes, ["pattern", "kind"]).select("pattern", "kind", (F.col("mass") / F.col("n")).alias("confidence"))
        confident = materialize(confident.where(F.col("confidence") >= min_confidence), "pii-patterns")
        scored = edges.where(F.size("kinds") == 0).select("pattern", "instance").join(confident, "pattern").where(_shape(F.col("kind"), F.col("instance")))
        scored = scored.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.0 - 0.99 * F.least("confidence", F.lit(1.0)))))).alias("score")).where(F.col("score") >= min_score)
        unseen = materialize(scored, "pii-instances")
        # scores, and with them both sets, only grow: equal counts are equal sets, and the scores are at their end too
        state = (confident.count(), *unseen.agg(F.count("*"), F.round(F.sum("score"), 6)).first())
        if not state[1]:
            return None
        if state == before:
            break
        known, before = base.unionByName(unseen), state
    tokens = found.where("kind_no is null").select("row", "start", "end", F.explode("patterns").alias("pattern"), "instance")
    spans = tokens.join(confident.select("pattern", "kind"), "pattern").join(unseen.select("instance", "kind"), ["instance", "kind"])
    order = F.element_at(F.create_map(*[F.lit(x) for no, k in enumerate(KINDS) for x in (k, no)]), F.col("kind"))
    return spans.groupBy("row", "start", "end").agg(F.min(order).alias("kind_no")).select("row", "start", "kind_no", "end")


def _spans(found: DataFrame, **options) -> DataFrame:
    """(row, start, kind_no, end, extra) of all spans of mentions; extra: 1 for discovered ones."""
    base = found.where("kind_no is not null").select("row", "start", "kind_no", "end", F.lit(0).alias("extra"))
    more = bootstrap(found, **options)
    return base if more is None else base.unionByName(more.withColumn("extra", F.lit(1)))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, base spans and all spans (base and discovered) of every row."""
    rows = extract(docs, id_col, text_col)
    found = _spans(mentions(rows), **options).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "extra"))).alias("found"))
    # the spans grow with the corpus: always a shuffled join, at any size
    joined = rows.select("row", "id").join(found.hint("merge"), "row", "left")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), _name(s["kind_no"]).alias("kind")))
    every = F.coalesce("found", F.array().cast("array<struct<start:int,kind_no:int,end:int,extra:int>>"))
    joined = joined.select("id", every.alias("found"))
    return joined.select("id", plain(F.filter("found", lambda s: s["extra"] == 0)).alias("base"), plain(F.col("found")).alias("spans"))


def _cuts(spans: DataFrame) -> DataFrame:
    """(row, cuts array<struct<start,end,kind_no>>): spans that overlap are one cut, named by the first of them."""
    order = W.partitionBy("row").orderBy("start", "kind_no", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("first", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    marked = marked.withColumn("cut", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    cuts = marked.groupBy("row", "cut").agg(F.min(F.struct("start", "kind_no")).alias("at"), F.max("end").alias("end"))
    return cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("end"), F.col("at.kind_no").alias("kind_no")))).alias("cuts"))


def _without(text: Column, cuts: Column) -> Column:
    """text with every cut replaced by its kind. Cuts go in groups of about the root of their number: a place in a string is
    found by counting from its start, so a group's part of the text is taken first and its cuts are looked for in that."""
    n = F.size(cuts)
    step = F.ceil(F.sqrt(n)).cast("int")

    def group(at: Column) -> Column:
        mine = F.slice(cuts, at + 1, step)
        base = F.when(at > 0, F.get(cuts, at - 1)["end"]).otherwise(0)
        return F.struct(base.alias("base"), F.substring(text, base + 1, F.element_at(mine, -1)["end"] - base).alias("part"), mine.alias("cuts"))

    def filled(g: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(g["cuts"], i - 1)["end"]).otherwise(g["base"])
            return F.concat(F.substring(g["part"], before - g["base"] + 1, c["start"] - before), F.lit("["), F.upper(_name(c["kind_no"])), F.lit("]"))

        return F.array_join(F.transform(g["cuts"], one), "")

    groups = F.transform(F.sequence(F.lit(0), n - 1, step), group)
    return F.concat(F.array_join(F.transform(groups, filled), ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))


def mask(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns with every span in text_col replaced by its kind, as [EMAIL]. Null texts stay null."""
    # docs' own columns stay in a struct, so none of their names can clash
    rows = materialize(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "pii-rows", "zstd")
    text = F.col("doc")[text_col]
    found = materialize(rows.select("row", hits(F.coalesce(text, F.lit(""))).alias("hits")), "pii-hits")
    cuts = materialize(_cuts(_spans(mentions(found), **options)), "pii-cuts")
    joined = rows.join(cuts.hint("merge"), "row", "left")
    masked = F.when(F.col("cuts").isNotNull(), _without(text, F.col("cuts"))).otherwise(text)
    return joined.select(*[(masked if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = detect(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"),
    )
