"""Ranges of time: retry ranges from issues, replacement, and ownership of overlapped segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import bins

from .clean import renumber


def retry_ranges(issues: DataFrame, durations: DataFrame, regions: int = C.RETRY_REGIONS) -> DataFrame:
    """Errors padded by 1.5 s within the audio, merged over gaps of up to 1 s, cut into pieces of up to 30 s, at most
    `regions` a medium. durations: (media_id, audio_ms)."""
    padded = issues.where("severity = 'error'").join(durations, "media_id").select(
        "media_id", F.greatest(F.col("start_ms") - C.PAD_MS, F.lit(0)).alias("start_ms"), F.least(F.col("end_ms") + C.PAD_MS, F.col("audio_ms")).alias("end_ms")
    ).where("end_ms > start_ms")
    merged = bins.merged(padded, "media_id", C.MERGE_MS)
    last = F.floor((F.col("end_ms") - F.col("start_ms") - 1) / C.PIECE_MS).cast("int")
    pieces = merged.select("*", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    begin = F.col("start_ms") + F.col("i") * C.PIECE_MS
    cut = pieces.select("media_id", begin.alias("start_ms"), F.least(begin + C.PIECE_MS, F.col("end_ms")).alias("end_ms"))
    piece = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms"))
    return cut.withColumn("piece", piece).where(F.col("piece") <= regions)


def replace_ranges(cues: DataFrame, ranges: DataFrame, replacement: DataFrame) -> DataFrame:
    """Cues whose midpoint lies in a range give way to the replacement; then all are numbered anew."""
    kept = bins.outside(cues, "media_id", F.col("start_ms") + F.col("end_ms"), ranges)
    return renumber(kept.unionByName(replacement.select(*cues.columns)))


def segments(durations: DataFrame) -> DataFrame:
    """(media_id, segment, core_start, core_end, clip_start, clip_end): cores of 300 s with overlapped clips."""
    last = F.greatest(F.ceil(F.col("audio_ms") / C.SEGMENT_MS).cast("int") - 1, F.lit(0))
    rows = durations.select("media_id", "audio_ms", F.explode(F.sequence(F.lit(0), last)).alias("segment"))
    start = F.col("segment").cast("long") * C.SEGMENT_MS
    end = F.least(start + C.SEGMENT_MS, F.col("audio_ms"))
    clip = (F.greatest(start - C.SEGMENT_OVERLAP_MS, F.lit(0)).alias("clip_start"), F.least(end + C.SEGMENT_OVERLAP_MS, F.col("audio_ms")).alias("clip_end"))
    return rows.select("media_id", "segment", start.alias("core_start"), end.alias("core_end"), *clip)


def owning_segment(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """cues with the segment whose core holds their midpoint; the last one has no end."""
    last = F.greatest(F.ceil(F.col("audio_ms") / C.SEGMENT_MS).cast("int") - 1, F.lit(0))
    at = F.floor((F.col("start_ms") + F.col("end_ms")) / (2 * C.SEGMENT_MS)).cast("int")
    return cues.join(durations, "media_id").withColumn("segment", F.least(F.greatest(at, F.lit(0)), last)).drop("audio_ms")


def recognized_in(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """Cues that were recognised in clips of ranges, at their place in the whole: shifted by the range's start, and kept if
    their midpoint lies in the range. ranges: media_id, piece, start_ms, end_ms; found: media_id, piece and cues."""
    at = ranges.select("media_id", "piece", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    placed = found.join(at, ["media_id", "piece"])
    placed = placed.withColumn("start_ms", F.col("start_ms") + F.col("from_ms")).withColumn("end_ms", F.col("end_ms") + F.col("from_ms"))
    mid = F.col("start_ms") + F.col("end_ms")
    return placed.where((mid >= 2 * F.col("from_ms")) & (mid < 2 * F.col("to_ms"))).drop("from_ms", "to_ms", "piece")


def retry(cues: DataFrame, ranges: DataFrame, found: DataFrame) -> DataFrame:
    """cues with the ranges' cues replaced by those that were recognised anew, where a range gave any."""
    new = recognized_in(ranges, found)
    hit = found.select("media_id", "piece").distinct()
    return replace_ranges(cues, ranges.join(hit, ["media_id", "piece"], "left_semi"), new)
