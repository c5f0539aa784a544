"""The message relation from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: a source per conversation, a turn a minute."""
    rows = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "self").when(F.col("role") == "assistant", "friend").when(F.col("role") == "system", "system").otherwise("other")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("source"), F.col("turn").alias("seq"),
        (F.lit(1704067200000) + F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000).alias("timestamp_ms"),
        role.alias("role"), F.when(F.col("role") == "system", "system").otherwise("text").alias("kind"), F.col("text"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages: a source per user; purchases and errors are the user's own."""
    rows = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type").isin("click", "view", "signup"), "friend").otherwise("self")
    return rows.select(
        F.col("event_id").cast("string").alias("message_id"), F.col("user_id").alias("source"), F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), role.alias("role"), F.lit("text").alias("kind"), F.col("event_type").alias("text"),
    )


#: Endings that give the supplied conversations what chat exports hold: faces, media,
#: mentions, private data, short questions. A message takes one by its number; after every
#: third one stands a message that consists of its ending alone.
ENDINGS = (
    "", "[微笑]", "[图片: a1.png]", "[/汪汪] [[爱心]] ok", "@Sam 在干嘛", "@Alex see 4111 1111 1111 1111 or 4111 1111 1111 1112", "mail a.b+c@mail.example.org, 192.168.0.1",
    "call 13912345678", "id 11010519491231002X", "u_AbCdEfGhIjKlMnOpQrSt12-w said", "good morning", "are you awake?", "我刚到家，好累", "晚安！晚安",
    "haha that is silly……", "抱抱 想你 谢谢", "yesterday you said so", "[表情]", "？！", "对了，换个话题", "play together on steam", "have you eaten", "[Toasted] [位置]", "see https://example.com/a?b=1, or docs.example.org.",
)


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversation_messages`` with ``ENDINGS``, kinds, placeholders and senders, as chat exports have them."""
    rows = conversation_messages(spark, sf_dir)
    n = F.pmod(F.col("source") * 7 + F.col("seq") * 5, F.lit(len(ENDINGS))).cast("int")
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), n + 1)
    whole = F.struct(F.trim(F.concat_ws(" ", "text", ending)).alias("text"), F.lit(0).alias("alone"))
    said = F.explode(F.when(n % 3 == 0, F.array(whole, F.struct(ending.alias("text"), F.lit(1).alias("alone")))).otherwise(F.array(whole)))
    kind = F.when(F.col("kind") == "system", "system").when(n == 1, "recalled").when(n == 2, "placeholder").when(n == 0, "unknown").otherwise("text")
    alone = F.col("said.alone")
    return rows.withColumn("said", said).select(
        F.when(alone == 1, F.concat("message_id", F.lit("-end"))).otherwise(F.col("message_id")).alias("message_id"), "source", (F.col("seq") * 2 + alone).alias("seq"),
        (F.col("timestamp_ms") + alone * 30_000).alias("timestamp_ms"), "role", kind.alias("kind"), F.col("said.text").alias("text"),
        F.when(n == 2, F.array(F.lit("[图片]"))).when(n == 0, F.array(F.lit("[语音]"))).otherwise(F.array().cast("array<string>")).alias("placeholders"),
        F.when(n == 20, "discord_default").when(n == 0, "").otherwise("type_1").alias("raw_type"), F.concat(F.lit("u-"), "role").alias("sender_uid"),
    )
