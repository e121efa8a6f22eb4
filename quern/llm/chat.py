"""Chat formatting with a grammar round trip (operator 7): DataFrame functions alone.

A conversation is rendered, parsed again by the same grammar and compared with its source.
Turns that are not recovered, above all those whose role or text holds a control string, are rendered
again with their control characters escaped; what is then still different stops the job.

Grammar: ``conversation := turn*``; ``turn := "<s>" mark role "[INST]" text "[/INST]</s>"``
with mark ``=`` for plain and ``~`` for escaped turns.  No field holds a control string (``<s>``,
``</s>``, ``[INST]``, ``[/INST]``).  In escaped fields a backslash, ``<`` and ``[`` become a backslash and
``b``, ``l`` or ``k``, so they hold no ``<`` and no ``[`` at all.  The parser takes the whole string or nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
OPEN, ROLE_END, CLOSE = "<s>", "[INST]", "[/INST]</s>"
#: Strings that no field of a rendered turn may hold.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
PLAIN, ESCAPED = "=", "~"
#: Backslash first on the way in and last on the way out (fixed values).
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))
_TURN = r"(?s)<s>([=~])(.*?)\[INST\](.*?)\[/INST\]</s>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    """One turn; ``escaped`` says whether its fields are."""
    field = lambda c: F.when(escaped, escape(c)).otherwise(c)
    return F.concat(F.lit(OPEN), F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit(PLAIN)), field(role), F.lit(ROLE_END), field(text), F.lit(CLOSE))


def _has_control(field: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(field, F.lit(c)) for c in CONTROLS))


def fields(rendered: Column) -> Column:
    """array<struct<m, r, t>> of the turns as written; null unless the whole string is turns of the grammar.

    The turns that the pattern finds must make up the string, so nothing before, between or after
    them is skipped, and no field may hold a control string.
    """
    part = lambda k: F.regexp_extract_all(rendered, F.lit(_TURN), F.lit(k))
    turns = F.arrays_zip(part(1).alias("m"), part(2).alias("r"), part(3).alias("t"))
    clean = F.forall(turns, lambda x: ~_has_control(x["r"]) & ~_has_control(x["t"]))
    return F.when((F.array_join(part(0), "") == rendered) & clean, turns)


def _plain(x: Column, field: str) -> Column:
    return F.when(x["m"] == ESCAPED, unescape(x[field])).otherwise(x[field])


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation or turn; null if it is not of the grammar."""
    return F.transform(fields(rendered), lambda x: F.struct(_plain(x, "r").alias("role"), _plain(x, "t").alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of turns (conv_id, turn, role, text).

    Rows of a conversation lie by turn, then role and text.  Null texts and roles are empty;
    repeated rows are turns of their own; null conv_ids are one conversation.  A conversation is one output
    value, so its turns do meet in one row; no two conversations do.  loss_spans are the
    (start, length) in code points, from 1, of each assistant text as rendered.  A
    conversation that does not parse back to its source raises an error.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = render_turn(F.col("role"), F.col("text"), F.lit(False))
    source = F.array(F.struct("role", "text"))
    t = t.withColumn("escaped", ~F.coalesce(parse(plain) == source, F.lit(False)))
    t = t.withColumn("piece", render_turn(F.col("role"), F.col("text"), F.col("escaped")))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece", "escaped"))).alias("turns"))
    formatted = F.array_join(F.col("turns.piece"), "")
    grouped = grouped.withColumn("formatted", formatted)
    recovered = parse(F.col("formatted"))
    wanted = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(recovered == wanted, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.col("conv_id").cast("string"))))
    tail = len(CLOSE)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["piece"])).alias("at"),
            F.when(
                x["role"] == LOSS_ROLE,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(x["piece"]) - tail - F.char_length(F.when(x["escaped"], escape(x["text"])).otherwise(x["text"])) + 1).cast("long").alias("start"),
                            F.char_length(F.when(x["escaped"], escape(x["text"])).otherwise(x["text"])).cast("long").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return grouped.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests from (conv_id, formatted, loss_spans) alone."""
    out = formatted.withColumn("turns", fields(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(_plain(x, "r"), F.lit("\n"), _plain(x, "t"), F.lit("\n"))), "")
    marks = F.filter("turns", lambda x: _plain(x, "r") == LOSS_ROLE)
    masked = F.zip_with("loss_spans", marks, lambda s, m: F.struct(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")).alias("t"), m["m"].alias("m")))
    loss = F.array_join(F.transform(masked, lambda x: _plain(x, "t")), "")
    out = out.withColumn("lines", lines)
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("lines", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def conflict_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(text).alias("text"))


ORACLE = """
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE WHEN regexp_matches(role || chr(10) || txt, '</?s>|\\[/?INST\\]')
                 THEN length(role) + length(txt) + length(regexp_replace(role || txt, '[^<\\[\\\\]', '', 'g')) ELSE length(role) + length(txt) END + 21 AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
  CAST(coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
