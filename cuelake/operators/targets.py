"""Checks of translated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import text as X
from cuelake.operators.terms import hits, with_variants


def defect(target: Column) -> Column:
    """The first rule that a target breaks, or null."""
    trimmed = F.regexp_replace(F.coalesce(target, F.lit("")), rf"^{X.SPACE}+|{X.SPACE}+$", "")
    return (
        F.when(F.length(trimmed) == 0, "missing")
        .when(trimmed.rlike(X.LEAK), "source-leak")
        .when(F.length(trimmed) > 96, "too-long")
        .when(X.excessive_repetition(trimmed), "repetition")
    )


def translated(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """cues with their target, null where there is none."""
    return cues.join(translations.select("media_id", "cue_id", "target"), ["media_id", "cue_id"], "left")


def defects(pairs: DataFrame) -> DataFrame:
    """(media_id, cue_id, defect) of the pairs with a defect."""
    return pairs.select("media_id", "cue_id", defect(F.col("target")).alias("defect")).where(F.col("defect").isNotNull())


def accept_repairs(proposals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """proposals (media_id, cue_id, original, proposed) with `accepted` and `reason`. conflicts: (media_id, cue_id) of the
    proposals that break a term which the original kept."""
    bad = conflicts.select("media_id", "cue_id").distinct().withColumn("conflict", F.lit(True))
    reason = (
        F.when(F.col("original").eqNullSafe(F.col("proposed")), "unchanged")
        .when(defect(F.col("proposed")).isNotNull(), "deterministic-defect")
        .when(F.coalesce("conflict", F.lit(False)), "new-terminology-conflict")
    )
    out = proposals.join(bad, ["media_id", "cue_id"], "left").withColumn("reason", reason).drop("conflict")
    return out.withColumn("accepted", F.col("reason").isNull())


def new_conflicts(proposals: DataFrame, terms: DataFrame) -> DataFrame:
    """(media_id, cue_id) where some term in the source (or a variant of it) is rendered by the original and not by the
    proposal. An original that is blank breaks no term."""
    usable = proposals.where(F.length(F.trim(F.coalesce("proposed", F.lit("")))) > 0).select("media_id", "cue_id", "source", "original", "proposed")
    original = F.coalesce("original", F.lit(""))
    lost = ~F.contains("proposed", "rendering") & (F.contains(original, F.col("rendering")) | (F.length(F.trim(original)) == 0))
    return hits(usable, "source", with_variants(terms), "form").where(lost).select("media_id", "cue_id").distinct()


def completeness(pairs: DataFrame) -> DataFrame:
    """(media_id, cues, complete): whether each cue has a target that is not blank."""
    blank = F.length(F.trim(F.coalesce("target", F.lit("")))) == 0
    return pairs.groupBy("media_id").agg(F.count("*").alias("cues"), F.bool_and(~blank).alias("complete"))


def repair_batches(found: DataFrame, size: int = C.REPAIR_BATCH) -> DataFrame:
    """The defects in consecutive batches of a medium: (media_id, cue_id, batch)."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("cue_id"))
    return found.select("media_id", "cue_id", F.floor((n - 1) / size).cast("int").alias("batch"))
