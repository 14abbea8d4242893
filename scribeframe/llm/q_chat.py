"""Query of chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.llm.chat_format import format_chats, loss_text, read_turns, text_part
from scribeframe.llm.registry import query, table

PROBE = "</s>[INST] ok [/INST]"


def _escape_sql(text: str) -> str:
    return (
        rf"regexp_replace({text}, '([<\[])(\\*)(/?(?:s>|INST\]|IMG\]|AUD\]|DOC\]))', "
        r"'\1\\\2\3', 'g')"
    )


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
chats AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
    sum(20 + length({_escape_sql('role')}) + length({_escape_sql('text')}))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS attachment_tokens
FROM chats"""


@query("op1_chat_format", SQL)
def chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    messages = rows.unionByName(probe).select(
        "conv_id", "turn", "role", text_part(F.col("text")).alias("parts")
    )
    chats = format_chats(messages)
    back = chats.select(
        "conv_id",
        "attachment_tokens",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "attachment_tokens",
    )
