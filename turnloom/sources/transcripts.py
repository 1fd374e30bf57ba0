"""Nested conversation transcripts as messages, without any answer or annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "sample_id string, speaker_a string, speaker_b string, sessions array<struct<session_index: int, date_time: string, "
    "messages: array<struct<speaker: string, text: string, images: array<string>, blip_caption: string, query: string>>>>"
)


def messages(talks: DataFrame) -> DataFrame:
    """sample_id, session_index, position, role, content, timestamp_ms of every message.

    Speaker a is the user, speaker b the assistant, and anyone else raises. Times such as
    ``1:56 pm on 8 May, 2023`` are UTC. Images, captions and image queries become lines of the text.
    """
    s = talks.select("sample_id", "speaker_a", "speaker_b", F.explode("sessions").alias("s"))
    m = s.select("sample_id", "speaker_a", "speaker_b", "s.session_index", "s.date_time", F.posexplode("s.messages").alias("position", "m"))
    unknown = F.raise_error(F.concat(F.lit("unknown speaker "), F.coalesce("m.speaker", F.lit("null")))).cast("string")
    role = F.when(F.col("m.speaker") == F.col("speaker_a"), "user").when(F.col("m.speaker") == F.col("speaker_b"), "assistant").otherwise(unknown)
    some = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"[{name}] "), c))
    content = F.concat_ws(
        "\n",
        F.concat("m.speaker", F.lit(": "), F.coalesce("m.text", F.lit(""))),
        some("images", F.array_join("m.images", ", ")),
        some("caption", F.col("m.blip_caption")),
        some("query", F.col("m.query")),
    )
    stamp = F.try_to_timestamp("date_time", F.lit("h:mm a 'on' d MMMM, yyyy"))
    return m.select("sample_id", "session_index", F.col("position").cast("long").alias("position"), role.alias("role"), content.alias("content"), (F.unix_timestamp(stamp) * 1000).alias("timestamp_ms"))


def session_corpus(talks: DataFrame) -> DataFrame:
    """sample_id, session_index, content: whole sessions, an allow-list of fields only."""
    rows = F.array_sort(F.collect_list(F.struct("position", "content")))
    return messages(talks).groupBy("sample_id", "session_index").agg(F.array_join(F.transform(rows, lambda x: x["content"]), "\n").alias("content"))
