"""Translated lines: polishing by rule, repair with a ledger, and the state of a reviewed medium."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import providers
from cuelake.operators import review, targets


def wanted(pairs: DataFrame) -> DataFrame:
    """The pairs (media_id, cue_id, source, target) whose target has a defect: what a repair asks for."""
    return pairs.join(targets.defects(pairs).select("media_id", "cue_id"), ["media_id", "cue_id"], "left_semi")


def propose(pairs: DataFrame, provider: providers.Provider) -> DataFrame:
    """(media_id, cue_id, proposed, status): a service's answers for the wanted pairs."""
    work = wanted(pairs).withColumn("request_id", F.xxhash64("media_id", "cue_id"))
    answers = providers.call(work.select("request_id", F.col("source").alias("body")), provider)
    return work.join(answers, "request_id", "left").select("media_id", "cue_id", F.col("answer").alias("proposed"), "status")


def repair(pairs: DataFrame, proposals: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The ledger of a repair: (media_id, cue_id, seq, before, after, accepted, reason). proposals: media_id, cue_id, proposed.
    Where a wanted pair has no proposal, the original stays."""
    asked = wanted(pairs).withColumnRenamed("target", "original").join(proposals.select("media_id", "cue_id", "proposed"), ["media_id", "cue_id"], "left")
    found = asked.where("proposed is not null")
    none = found.select("media_id", "cue_id").where(F.lit(False))
    judged = targets.accept_repairs(found, targets.new_conflicts(found, terms) if terms is not None else none)
    missing = asked.where("proposed is null").withColumn("reason", F.lit("missing-candidate")).withColumn("accepted", F.lit(False))
    rows = judged.unionByName(missing)
    seq = F.row_number().over(Window.partitionBy("media_id").orderBy("cue_id")).cast("long")
    return rows.select("media_id", "cue_id", seq.alias("seq"), F.col("original").alias("before"), F.col("proposed").alias("after"), "accepted", F.coalesce("reason", F.lit("rule-repair")).alias("reason"))


def apply(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """pairs with the accepted changes in their targets."""
    new = review.replay(ledger).withColumn("changed", F.lit(True))
    out = pairs.join(new, ["media_id", "cue_id"], "left")
    return out.withColumn("target", F.when(F.coalesce("changed", F.lit(False)), F.col("value")).otherwise(F.col("target"))).drop("value", "changed")


def revert(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """pairs with the targets that stood before the ledger."""
    old = review.undo(ledger).withColumn("changed", F.lit(True))
    out = pairs.join(old, ["media_id", "cue_id"], "left")
    return out.withColumn("target", F.when(F.coalesce("changed", F.lit(False)), F.col("value")).otherwise(F.col("target"))).drop("value", "changed")
