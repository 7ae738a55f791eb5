"""The chain from recognised cues to an accepted source, and what it reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import clean, quality


def clean_and_gate(cues: DataFrame) -> DataFrame:
    """One row a medium: the report of the cleaned cues, how many cues cleaning removed and compacted, and the gate's
    decision. A medium of which nothing is left has no row."""
    before = cues.groupBy("media_id").agg(F.count("*").alias("initial_count"))
    reported = quality.report(clean.sanitize(cues), F.count_if("compacted").alias("compacted"))
    counted = reported.join(before, "media_id").withColumn("removed", F.col("initial_count") - F.col("cue_count"))
    return quality.gate(counted)


def recovered(stored: DataFrame, previous: DataFrame) -> DataFrame:
    """Stored candidates cleaned and judged again: as `clean_and_gate`, where what was removed and compacted before counts too.
    stored: cues; previous: media_id, gated, initial_count, removed, compacted (of the earlier report). Only media whose
    earlier report was gated have a row."""
    gated = previous.where("gated").select("media_id", *(F.col(c).alias(f"_{c}") for c in ("initial_count", "removed", "compacted")))
    kept = stored.join(gated.select("media_id"), "media_id", "left_semi")
    before = kept.groupBy("media_id").agg(F.count("*").alias("stored"))
    reported = quality.report(clean.sanitize(kept), F.count_if("compacted").alias("compacted")).join(before, "media_id").join(gated, "media_id")
    counted = reported.withColumns({
        "initial_count": F.when(F.col("_initial_count") > 0, F.col("_initial_count")).otherwise(F.col("stored")),
        "removed": F.col("_removed") + F.col("stored") - F.col("cue_count"), "compacted": F.col("_compacted") + F.col("compacted"),
    })
    return quality.gate(counted).drop("stored", "_initial_count", "_removed", "_compacted")


def passes(reports: DataFrame) -> DataFrame:
    """The final report's totals over the passes of a medium: removed, compacted and retried cues and retried regions add up.
    reports: media_id, pass, removed, compacted, retried, regions."""
    return reports.groupBy("media_id").agg(*(F.sum(c).alias(c) for c in ("removed", "compacted", "retried", "regions")), F.count("*").alias("passes"))


def prepared(accepted: DataFrame, recovery: DataFrame, recognised: DataFrame) -> DataFrame:
    """Where each medium's source cues come from, and whether translation may go on: (media_id, origin, can_continue). A source
    that was accepted before comes first, then a candidate that passes the gate again, then the new recognition, which
    blocks only if its gate was applied. accepted: media_id; recovery, recognised: media_id, disposition, and for the
    latter gated."""
    goes_on = F.col("disposition") != "blocked"
    ways = (
        accepted.select("media_id", F.lit(0).alias("rank"), F.lit("accepted").alias("origin"), F.lit(True).alias("can_continue")),
        recovery.where(goes_on).select("media_id", F.lit(1).alias("rank"), F.lit("recovered").alias("origin"), F.lit(True).alias("can_continue")),
        recognised.select("media_id", F.lit(2).alias("rank"), F.lit("recognised").alias("origin"), (goes_on | ~F.col("gated")).alias("can_continue")),
    )
    every = ways[0].unionByName(ways[1]).unionByName(ways[2])
    return every.groupBy("media_id").agg(F.min_by(F.struct("origin", "can_continue"), "rank").alias("w")).select("media_id", "w.*")


def term_pass(cues: DataFrame, entries: DataFrame, pattern: str) -> DataFrame:
    """cues with the spellings of their medium's term list made canonical; media without a list stay as they are. entries:
    media_id, source, variants, ord."""
    none = F.array().cast("array<string>")
    forms = entries.where(F.length(F.trim("source")) > 0).select("media_id", "ord", F.col("source").alias("canonical"), F.explode(F.coalesce("variants", none)).alias("variant"))
    first = forms.where(F.length(F.trim("variant")) > 0).groupBy("media_id", "variant").agg(F.min_by("canonical", "ord").alias("canonical"))
    table = first.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("_forms"))  # one medium's list
    runs = F.regexp_extract_all("text", F.lit(f"(?:{pattern})+|(?:(?!{pattern})(?s:.))+"), F.lit(0))
    fixed = F.array_join(F.transform(runs, lambda r: F.coalesce(F.try_element_at("_forms", r), r)), "")
    return cues.join(table, "media_id", "left").withColumn("text", F.when(F.col("_forms").isNotNull(), fixed).otherwise(F.col("text"))).drop("_forms")


def trusted(cues: DataFrame) -> DataFrame:
    """The report of cues from a file or an embedded track: the gate is off, and any cue passes."""
    return quality.report(cues).withColumn("passed", F.col("cue_count") > 0).withColumn("disposition", F.lit("trusted"))


def compare(fast: DataFrame, careful: DataFrame) -> DataFrame:
    """(measure, fast, quality) of two sets of cues."""
    def wide(cues: DataFrame) -> DataFrame:
        length = F.col("end_ms") - F.col("start_ms")
        totals = cues.agg(F.count("*").alias("cues"), F.sum(length).alias("speech_ms"), F.max(length).alias("longest_ms"))
        return totals.select(F.expr("stack(3, 'cues', cues, 'speech_ms', speech_ms, 'longest_ms', longest_ms) as (measure, value)"))

    return wide(fast).withColumnRenamed("value", "fast").join(wide(careful).withColumnRenamed("value", "quality"), "measure")


def summary(fast: DataFrame, careful: DataFrame, initial: DataFrame) -> DataFrame:
    """(measure, fast, quality): the seven measures of the comparison of two sets of cues that were made of the initial
    ones, over all media."""
    before = initial.agg(F.count("*").alias("initial"))
    counted = ("cue_count", "suspicious", "over_10", "over_20", "over_30")

    def tall(cues: DataFrame, name: str) -> DataFrame:
        totals = (*(F.sum(c).alias(c) for c in counted), F.max("longest_ms").alias("longest_ms"))
        wide = quality.report(cues).agg(*totals).na.fill(0).crossJoin(before)  # a row each
        wide = wide.withColumn("removed", F.col("initial") - F.col("cue_count")).drop("initial")
        return wide.select(*(F.col(c).cast("long") for c in wide.columns)).unpivot([], list(wide.columns), "measure", name)

    return tall(fast, "fast").join(tall(careful, "quality"), "measure")
