"""Chat formatting in Spark expressions only.

Turns are collected as structs, sorted, runs of the same role are merged into one block, and blocks
are joined to one string:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Inside roles and texts a backslash is doubled and one is put after the first character of every
control string, so no control string of this or the other usual templates is left; a role's newlines
get a backslash before them. Taking the backslashes out again restores role and text. The loss mask holds the assistant texts as code point spans
of the formatted string, one for every turn.

Defined results: a null text or role is empty; turns with equal numbers are ordered by role and text;
repeated rows are turns of their own; rows with a null conversation form one conversation; an empty
table gives an empty table; only the named columns are read, so others can't clash. A conversation is one output row, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum

#: The marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: First character and rest of the control strings that texts may not hold as they are.
CONTROL = r"(\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"

#: A role and the newline that ends it.
_HEAD = r"(?s)\A([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the first newline without a backslash before it, so its own newlines get one."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def format_conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv, formatted string, loss_spans array<struct<start,length>>."""
    none = F.lit("")
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(order).alias("turn"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text")).alias("t"))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    rows = rows.withColumn("first", first).withColumn("ends", F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("turns") + 1)))
    blocks = F.zip_with(
        "first", "ends",
        lambda a, b: F.struct(F.element_at("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a, b - a), lambda t: escape(t["text"])).alias("texts")),
    )
    rows = rows.select("conv", F.transform(blocks, lambda b: F.struct(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")).alias("head"), (b["role"] == learn).alias("learn"), b["texts"].alias("texts"))).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], SEP), F.lit(END))), "")

    # lengths of all pieces in order, then their places as running sums
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(b["head"])).otherwise(len(SEP)).alias("before"), F.length(t).alias("length"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("behind"), b["learn"].alias("learn")))))
    rows = rows.withColumn("formatted", formatted).withColumn("pieces", pieces)
    rows = rows.withColumn("sizes", F.transform("pieces", lambda p: p["before"] + p["length"] + p["behind"]))
    spans = F.zip_with("pieces", running_sum(F.col("sizes")), lambda p, e: F.struct((e - p["behind"] - p["length"]).alias("start"), p["length"].alias("length"), p["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"]))
    return rows.select(F.col("conv").alias(conv), "formatted", loss.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, read back: array<struct<role,text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")
    role = lambda b: unescape(F.regexp_extract(b, _HEAD, 1))
    body = lambda b: F.regexp_replace(F.regexp_replace(b, _HEAD, ""), r"<\|im_end\|>\n\z", "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|im_sep\|>", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts of spans, in order. Spans go in groups of about the root of their number: a place in a string is found by
    counting from its start, so a group's part of the string is taken first and its spans are looked for in that."""
    n = F.size(spans)
    step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

    def group(at: Column) -> Column:
        mine = F.slice(spans, at + 1, step)
        base, last = F.get(mine, F.lit(0))["start"], F.element_at(mine, -1)
        return F.struct(base.alias("base"), F.substring(formatted, base + 1, last["start"] + last["length"] - base).alias("part"), mine.alias("spans"))

    texts = lambda g: F.transform(g["spans"], lambda s: F.substring(g["part"], s["start"] - g["base"] + 1, s["length"]))
    groups = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), group)).otherwise(F.array())
    return F.flatten(F.transform(groups, texts))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    out = out.withColumn("turns", parse(F.col("formatted")))
    learnt = F.array_join(F.transform(masked_texts(F.col("formatted"), F.col("loss_spans")), unescape), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("learnt", learnt)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN before = role THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
