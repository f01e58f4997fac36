r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable.
Turns after the last reply (or a conversation without one) make one more example without a target, so nothing is lost.

A turn is written as ``### Role: text </turn>\\n``.  Inside roles and texts a backslash is written ``\b``, ``<`` is
``\l`` and ``#`` is ``\h``; after that neither ``</turn>`` nor ``###`` can occur in a text, and each backslash starts a
pair, so the way back is exact.  A role's ``:`` is ``\c``, so the first ``: `` ends the role.

Defined cases: a null role or text is empty; turns are ordered by turn (nulls first), then role, then text, and repeated
rows stay; a null conv_id is one conversation; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(SEP), escape(text), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): code points of the trainable span, both null without a target.

    The examples of one conversation are made where its turns were gathered: one exchange, by conv_id.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")))).alias("turns")
    )
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), render(t["role"], t["text"]).alias("text"))).alias("turns"))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == last))
    examples = turns.select("conv_id", "turns", F.posexplode(ends).alias("example", "n_turns"))
    target = F.element_at("turns", F.col("n_turns"))
    examples = examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), lambda t: t["text"]), "").alias("text"),
        F.when(target["role"] == "assistant", F.length(target["text"])).alias("_own"),
    )
    total = F.length("text")
    return examples.select(
        "conv_id",
        "example",
        "n_turns",
        "text",
        (total - F.col("_own") + len(OPEN + "assistant" + SEP)).cast("long").alias("loss_start"),
        F.when(F.col("_own").isNotNull(), total - len(CLOSE)).cast("long").alias("loss_end"),
    )


def loss_text(examples: DataFrame) -> Column:
    """The trainable text of each example, read back from its span."""
    return unescape(F.substring(examples["text"], (examples["loss_start"] + 1).cast("int"), (examples["loss_end"] - examples["loss_start"]).cast("int")))


def parse(text: Column) -> Column:
    """array<struct<role,text>> of a formatted text."""

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        at = F.instr(body, SEP)
        return F.struct(
            unescape(F.replace(F.substr(body, F.lit(1), at - 1), F.lit("\\c"), F.lit(":"))).alias("role"),
            unescape(F.substr(body, at + len(SEP))).alias("text"),
        )

    parts = F.split(text, CLOSE)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


#: The conversation that the digest query adds: its text spells out the template's own marks.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = spark.range(1)
    probe = probe.select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE])))
    examples = expand(rows.unionByName(probe))
    read = examples.select("conv_id", "example", "n_turns", F.length("text").alias("chars"), loss_text(examples).alias("loss"), "text")
    by = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("text", "n_turns").alias("text"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = F.array_join(F.transform(parse(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    15 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM o
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
