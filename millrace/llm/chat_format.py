r"""Chat formatting with a grammar round trip. DataFrame functions only.

A turn is rendered as ``### Role:``, the text and ``</turn>``, each on lines of their own. The parser is one rule:
turns end at an unescaped ``</turn>``, the first line names the role, and one backslash is taken off every run of
backslashes before a control string. Each turn is rendered as it is and parsed again. A turn is in conflict if it holds
a control string, which any other reader of the template would take for one, or if it does not come back as its source;
its control strings are then escaped (one backslash more before each), and it is parsed and compared again. As a turn's
end can't be read into the next, conversations of turns that come back come back whole; ``round_trip`` tells.

Output: a row per conversation with the rendered text and the spans (start, length in code points) of the loss mask,
which covers the assistants' texts. ``recovered`` reads turns and masked text back from rendered text and spans.

Defined results: turns go by ``turn``, then role, then text, nulls first; null texts and roles are empty; any role but
system, user and assistant is written in hex; rows without conversation id form one conversation; an empty table gives
an empty result; other columns are not read. A conversation is one row, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
HEADER = r"### (?:System|User|Assistant|Role [0-9A-F]*):"
END = "</turn>"
CONTROL = rf"(?:{HEADER}|{END})"
LOSS_ROLE = "assistant"
ROUNDS = 2


def role_name(role: Column) -> Column:
    out = F.concat(F.lit("Role "), F.hex(role.cast("binary")))
    for known, name in ROLES.items():
        out = F.when(role == known, F.lit(name)).otherwise(out)
    return out


def role_of(name: Column) -> Column:
    out = F.unhex(F.substring(name, 6, 2**31 - 1)).cast("string")
    for known, shown in ROLES.items():
        out = F.when(name == shown, F.lit(known)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), role_name(role), F.lit(":\n"))


def parsed(rendered: Column) -> Column:
    """Array of (role, text) that a rendered text holds, by the grammar alone."""
    turns = F.split(rendered, rf"(?<!\\){END}\n", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)  # what follows the last end is empty
    return F.transform(
        turns,
        lambda t: F.struct(
            role_of(F.regexp_extract(t, r"^### ([^:\n]*):\n", 1)).alias("role"),
            unescaped(F.regexp_extract(t, r"(?s)^### [^:\n]*:\n(.*)\n$", 1)).alias("text"),
        ),
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted text, loss_spans, and whether all turns came back."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_shown", F.col("text"))
    for _ in range(ROUNDS):
        piece = F.concat(head(F.col("role")), "_shown", F.lit(f"\n{END}\n"))
        rows = rows.withColumn("_piece", piece).withColumn("_back", parsed(F.col("_piece")))
        same = (F.size("_back") == 1) & (F.col("_back")[0]["role"] == F.col("role")) & (F.col("_back")[0]["text"] == F.col("text"))
        rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)))
        fine = F.col("_same") & ~F.regexp_like("text", F.lit(CONTROL))
        rows = rows.withColumn("_shown", F.when(fine, F.col("_shown")).otherwise(escaped(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = (
        rows.withColumn("_n", F.row_number().over(order))
        .withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_start", F.col("_at") + F.length(head(F.col("role"))))
    )
    turns = F.sort_array(F.collect_list(F.struct("_n", "_piece", "role", "_start", F.length("_shown").alias("_length"))))
    whole = placed.groupBy("conv_id").agg(turns.alias("_turns"), F.bool_and("_same").alias("round_trip"))
    masked = F.filter("_turns", lambda t: t["role"] == LOSS_ROLE)
    return whole.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform(masked, lambda t: F.struct(t["_start"].cast("long").alias("start"), t["_length"].cast("long").alias("length"))).alias("loss_spans"),
        "round_trip",
    )


def recovered(output: DataFrame) -> DataFrame:
    """``output`` with ``turns`` and ``loss_text``, read back from the formatted text and its spans."""
    spans = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return output.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss_text", F.array_join(spans, ""))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    r"""``conversations`` plus conversation -7, whose texts hold the template's own strings."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op7_chat_format(spark, sf_dir):
    back = recovered(formatted(with_probe(spark, table(spark, sf_dir, "conversations"))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(n, r)),
e AS (SELECT *, length(regexp_replace(text, '(\\*{CONTROL})', '\\\1', 'g')) + {len("### :" + chr(10) + chr(10) + END + chr(10))}
  + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 5 + length(hex(role)) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
