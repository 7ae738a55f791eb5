"""Cleaning of cues: row rules, collapsed repeats, repaired overlaps, new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import bins
from cuelake.functions import text as X

from .quality import ORDER, by_time, severe, with_islands


def row_rules(cues: DataFrame) -> DataFrame:
    """cues with clean text and end, without those that no rule can save, and with `compacted`."""
    d = F.col("end_ms") - F.col("start_ms")
    text = cues.withColumn("text", X.clean_spaces(F.col("text"))).withColumn("clean", X.meaningful(F.col("text")))
    good = (F.length("text") > 0) & (d > 100) & (d <= 30000) & ~((F.length("clean") <= 3) & (d > 8000))
    short = text.where(good).withColumn("short", X.compact_repetition(F.col("text"), F.col("clean")))
    changed = F.col("short") != F.col("text")
    end = F.when(changed, F.least("end_ms", F.col("start_ms") + 4000)).otherwise(F.col("end_ms"))
    # A long cue with little text can't come out of this: the cap is below the limit. So no filter follows, which would be
    # pushed down and work out the shortened text again and again.
    rest = [c for c in cues.columns if c not in ("text", "end_ms")]
    return short.select(*rest, end.alias("end_ms"), F.col("short").alias("text"), changed.alias("compacted"))


def collapse_repeats(cues: DataFrame) -> DataFrame:
    """Severe islands keep three cues (of five or more) or two, evenly spread and of limited length."""
    within = Window.partitionBy("media_id", "island")
    ordered = within.orderBy("start_ms", "end_ms", "pos")
    rows = with_islands(cues).select(
        "*", F.count("*").over(within).alias("n"), (F.row_number().over(ordered) - 1).alias("i"), F.min("start_ms").over(within).alias("from_ms"),
        F.last("end_ms").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("to_ms"),
    )
    vocal = X.vocalization(F.col("norm"))
    keep = F.when(F.col("n") >= C.SEVERE_CUES, 3).otherwise(2)
    slots = F.transform(F.sequence(F.lit(0), keep - 1), lambda s: F.bround(s * (F.col("n") - 1.0) / (keep - 1)).cast("int"))
    bad = severe(F.col("n"), F.col("to_ms") - F.col("from_ms"), vocal)
    marked = rows.withColumn("bad", bad).where(~F.col("bad") | F.array_contains(slots, F.col("i")))
    longest = F.when(vocal, 3000).otherwise(8000)
    end = F.when(F.col("bad"), F.least("end_ms", F.col("start_ms") + longest)).otherwise(F.col("end_ms"))
    return marked.withColumn("end_ms", end).select(*cues.columns)


def repair_overlaps(cues: DataFrame) -> DataFrame:
    """Each cue ends where the next one starts at the latest; cues under 200 ms go."""
    end = F.least("end_ms", F.coalesce(F.lead("start_ms").over(by_time()), F.col("end_ms")))
    fixed = cues.withColumn("end_ms", end)
    return fixed.where(F.col("end_ms") - F.col("start_ms") >= C.SHORTEST_MS)


def renumber(cues: DataFrame) -> DataFrame:
    """Ids from 1 by start, end and position."""
    placed = bins.numbered(cues, "media_id", ORDER, "_number")
    return placed.withColumns({"cue_id": F.col("_number"), "pos": F.col("_number") - 1}).drop("_number")


def sanitize(cues: DataFrame) -> DataFrame:
    """The whole cleaning; the result has no overlap."""
    return renumber(repair_overlaps(collapse_repeats(row_rules(cues))))
