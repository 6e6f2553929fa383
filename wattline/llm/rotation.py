"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant and all others as users under their
names; system messages stay system messages and are nobody's turn.  The mask has the spans (in characters of the rendered text) that the
assistant is trained on: the speaker's own messages with their closing mark.

A conversation is rendered in chunks of `CHUNK` turns by turn number, so that no row and no group grows with the length of a conversation; laid end
to end by chunk they are the whole dialogue.  A chunk in which the speaker says nothing is rendered too, with an empty mask.

Messages are ordered by (turn, role, text), nulls first; repeated rows stay.  Null text: an empty message.  Null role: a user named
`unknown`, no participant.  Null turn: chunk -1.  Rows with a null conv_id are left out, since they belong to no conversation.  Marks inside texts and
names are broken up by a blank, so that no message can open or close another.  A conversation of system messages only has no participant
and so no row.  Extra columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, SYSTEM, UNKNOWN = 64, "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def perspectives(conversations: DataFrame, chunk: int = CHUNK, system: str = SYSTEM) -> DataFrame:
    """(conv_id, speaker, chunk, n_messages, text, mask array of (start, end)): one row for each chunk of a conversation and each participant."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    messages = rows.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-1)).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = rows.where(F.col("role").isNotNull() & (F.col("role") != system)).select("conv_id", F.col("role").alias("speaker")).distinct()

    def piece(m: Column) -> Column:
        own, role = m["role"].eqNullSafe(F.col("speaker")), m["role"]
        head = F.when(own, F.lit("assistant")).when(role == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), _plain(F.coalesce(role, F.lit(UNKNOWN)))))
        head = F.concat(F.lit(OPEN), head, F.lit("\n"))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, _plain(F.coalesce(m["text"], F.lit(""))), F.lit(CLOSE + "\n")).alias("text"))

    made = messages.join(speakers, "conv_id").withColumn("pieces", F.transform("messages", piece)).drop("messages")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["text"])
        span = F.array(F.struct((a["at"] + p["head"]).alias("start"), (end - 1).alias("end")))       # the line break after the closing mark is not trained on
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(a["mask"], span)).otherwise(a["mask"]).alias("mask"))

    return made.select("conv_id", "speaker", "chunk", F.size("pieces").alias("n_messages"), F.array_join(F.col("pieces.text"), "").alias("text"), F.aggregate("pieces", start, step)["mask"].alias("mask"))


def digest(conversations: DataFrame) -> DataFrame:
    """perspectives with the mask as text `start-end,start-end`."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return perspectives(conversations).withColumn("mask", spans)


#: The same question for DuckDB.
SQL = r"""
WITH m AS (
    SELECT conv_id, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS chunk, role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id, floor(turn / 64) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND role <> 'system'),
s AS (
    SELECT conv_id, speaker, chunk, i, role IS NOT DISTINCT FROM speaker AS own, text,
           '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') END || chr(10) AS head
    FROM m JOIN p USING (conv_id)),
t AS (SELECT *, head || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS piece FROM s),
u AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY i) AS stop FROM t)
SELECT conv_id, speaker, chunk, CAST(count(*) AS INT) AS n_messages, string_agg(piece, '' ORDER BY i) AS text,
       coalesce(string_agg(CAST(stop - length(piece) + length(head) AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM u GROUP BY conv_id, speaker, chunk
"""
