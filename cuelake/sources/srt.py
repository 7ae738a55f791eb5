"""SRT files as tables of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions.text import SPACE
from cuelake.sources import srt_files
from cuelake.sources.places import spelled

# The time line of an SRT block.
TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
LINE = rf"^{SPACE}*{TIME}{SPACE}*-->{SPACE}*{TIME}"


def parse_time(line, group: int):
    """Milliseconds of the time that starts at a group of LINE; no range is checked."""
    part = lambda i: F.regexp_extract(line, LINE, group + i).cast("long")
    return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3)


def parse(files: DataFrame, key: str = "media_id", content: str = "content") -> DataFrame:
    """Cues of whole SRT texts: blocks between blank lines, with an optional number line; ids count the kept blocks."""
    plain = F.regexp_replace(F.regexp_replace(F.col(content), "^﻿", ""), "\r\n?", "\n")
    blocks = files.select(key, F.posexplode(F.split(F.trim(F.regexp_replace(plain, rf"^{SPACE}+|{SPACE}+$", "")), r"\n{2,}")).alias("block", "body"))
    lines = blocks.select(key, "block", F.split("body", "\n").alias("l")).where(F.size("l") >= 2)
    first = F.regexp_extract(F.col("l")[0], rf"^{SPACE}*([+-]?\d+){SPACE}*$", 1)
    numbered = F.coalesce(first.try_cast("int").isNotNull(), F.lit(False))
    at = F.when(numbered, 1).otherwise(0)
    timed = lines.select(key, "block", F.get("l", at).alias("line"), F.slice("l", at + 2, F.greatest(F.size("l") - at - 1, F.lit(0))).alias("rest"))
    timed = timed.where(F.col("line").rlike(LINE))
    text = F.regexp_replace(F.array_join(F.transform("rest", lambda x: F.regexp_replace(x, rf"{SPACE}+$", "")), "\n"), rf"^{SPACE}+|{SPACE}+$", "")
    kept = timed.select(key, "block", parse_time(F.col("line"), 1).alias("start_ms"), parse_time(F.col("line"), 5).alias("end_ms"), text.alias("text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("block"))
    return kept.where(F.length("text") > 0).select(key, number.alias("cue_id"), "start_ms", "end_ms", "text")


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cues of SRT files; media_id is the path."""
    srt_files.register(spark)
    return spark.read.format("srt").options(**spelled(paths)).load()
