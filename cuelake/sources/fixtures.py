"""Deterministic timed-text views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> F.Column:
    return F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))")


def event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues from events: a user is a medium, an event is a cue."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.floor(F.floor(micros() / 1000) / 3600).cast("long")
    text = (
        F.when(F.col("event_type") == "view", "ああ")
        .when(F.col("event_type") == "click", "A")
        .when(F.col("event_type") == "error", F.repeat(F.lit("ん"), 17))
        .when(F.col("event_type") == "purchase", "They bought it")
        .otherwise("We signed the new people in today.")
    )
    numbered = events.select("*", F.row_number().over(order).alias("cue_id")).withColumn("start_ms", start)
    return numbered.select(
        F.col("user_id").alias("media_id"), "cue_id", (F.col("cue_id") - 1).alias("pos"), "start_ms",
        (F.col("start_ms") + F.round(F.col("value") * 100).cast("long")).alias("end_ms"), text.alias("text"),
    )


def line_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues from documents: a line is a cue of two seconds, one each five seconds."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    start = F.col("pos").cast("long") * 5000
    return lines.select("media_id", (F.col("pos") + 1).alias("cue_id"), "pos", start.alias("start_ms"), (start + 2000).alias("end_ms"), "text")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines with a derived translation: (media_id, cue_id, source, target)."""
    turns = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("*", F.lead("text").over(after).alias("next_text"), F.lead("role").over(after).alias("next_role"))
    pairs = pairs.where("role = 'user' and next_role = 'assistant'")
    target = (
        F.when(F.col("conv_id") % 11 == 0, F.lit(None))
        .when(F.col("conv_id") % 7 == 0, F.concat(F.lit("こんにちは"), F.substring("next_text", 1, 20)))
        .when(F.col("conv_id") % 5 == 0, F.repeat(F.lit("哈"), 24))
        .otherwise(F.substring(F.col("next_text"), F.lit(1), (40 + 20 * F.col("turn")).cast("int")))
    )
    return pairs.select(F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("cue_id"), F.col("text").alias("source"), target.alias("target"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as cues of one medium, in the order of conversation and turn."""
    return table(spark, sf_dir, "conversations").select(F.lit(0).cast("long").alias("media_id"), "conv_id", "turn", "text")


TERM_PATTERN = "[A-Z][a-z]{2,}"
