"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant; all others are
users who bear their names. The loss mask covers what the assistant says and its end mark, nothing else. Turns of context
roles (system) stand in every rendering as they are and never get a perspective of their own.

A rendering comes as its segments, one a message, with the place of each in the whole: however long a conversation is, no
row holds more than one message, and the segments in the order of `begin` are the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
#: Turns of a conversation whose lengths are summed up in one task.
TURNS_TOGETHER = 1024


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, turns_together: int = TURNS_TOGETHER) -> DataFrame:
    """One row for each message and perspective of conversations (conv_id, turn, role, text).

    The format's marks within texts and names are broken up (`<|` to `< |`, `|>` to `| >`), so that none can forge a turn.
    conv_id, perspective, turn, speaker, role (assistant, user, or the context role), name (of a user), segment,
    begin and end (its characters in the rendering), mask_begin and mask_end (the trained part; equal if none).
    Messages are ordered by turn, then speaker, then text. Null text counts as empty, a null role as "unknown", null
    conv_ids make one conversation, a null turn comes first. Repeated rows (equal in all four columns) are one message.
    A conversation without participants, of system turns alone, has no rendering. Other columns are ignored.
    """
    messages = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    people = messages.where(~context).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = messages.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    role = F.when(context, F.col("speaker")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    plain = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    head = F.concat(F.lit("<|"), plain(F.col("role")), F.when(F.col("role") == "user", F.concat(F.lit(" name="), plain(F.col("speaker")))).otherwise(F.lit("")), F.lit("|>\n"))
    parts = (
        seen.withColumn("role", role)
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", plain(F.col("text")), F.lit("<|end|>\n")))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / turns_together), F.lit(-(1 << 62))))
    )
    # lengths are summed up in two steps, over blocks of turns and within them, so that no task gets a whole conversation
    blocks = parts.groupBy("conv_id", "perspective", "block").agg(F.sum(F.length("segment")).alias("sum"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("conv_id").alias("conv"), F.col("perspective").alias("person"), F.col("block").alias("part"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("inner", F.coalesce(F.sum(F.length("segment")).over(within), F.lit(0)))
        .join(bases, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("perspective") == F.col("person")) & (F.col("block") == F.col("part")))
        .withColumn("begin", F.col("base") + F.col("inner"))
        .withColumn("end", F.col("begin") + F.length("segment"))
    )
    own = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", F.when(F.col("role") == "user", F.col("speaker")).alias("name"), "segment",
        "begin", "end", F.when(own, F.col("begin") + F.length("head")).otherwise(F.col("end")).alias("mask_begin"), F.col("end").alias("mask_end"),
    )


#: The same rows in DuckDB SQL.
SQL = """
WITH messages AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM messages WHERE speaker <> 'system'
), seen AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM messages JOIN people ON conv_id IS NOT DISTINCT FROM conv
), headed AS (
  SELECT *, '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || CASE WHEN role = 'user' THEN ' name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') ELSE '' END || '|>' || chr(10) AS head FROM seen
), parts AS (
  SELECT *, head || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM parts
)
SELECT conv_id, perspective, turn, speaker, role, CASE WHEN role = 'user' THEN speaker END AS name, segment,
  "end" - length(segment) AS begin, "end",
  CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) ELSE "end" END AS mask_begin, "end" AS mask_end
FROM placed
"""
