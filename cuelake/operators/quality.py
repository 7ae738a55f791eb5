"""Data-quality issues of cues, their report, and the gate before translation.

Windows are partitioned by medium and ordered by start, end and position, so one exchange serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import text as X

ORDER = ("start_ms", "end_ms", "pos")


def by_time() -> Window:
    return Window.partitionBy("media_id").orderBy(*ORDER)


def with_measures(cues: DataFrame) -> DataFrame:
    """cues with duration_ms, clean (the meaningful text) and low (low diversity)."""
    clean = X.meaningful(F.col("text"))
    return cues.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).withColumn("clean", clean).withColumn("low", X.low_diversity(F.col("clean")))


def _issue(kind: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))


def cue_issues(cues: DataFrame) -> DataFrame:
    """Issues of single cues: (media_id, cue_id, kind, severity, start_ms, end_ms, preview)."""
    d, n = F.col("duration_ms"), F.length("clean")
    low_information = (n <= 3) & (d > 8000)
    found = F.array_compact(
        F.array(
            _issue("invalid-duration", "error", d <= 0),
            _issue("over-30-seconds", "error", d > 30000),
            _issue("low-information-long", "error", low_information),
            _issue("short-text-long", "warning", ~low_information & (n <= 15) & (d > 15000)),
            _issue("low-character-diversity", "error", F.col("low")),
        )
    )
    rows = with_measures(cues).select("*", F.explode(found).alias("i"))
    at = lambda c: F.greatest(F.col(c), F.lit(0)).alias(c)
    return rows.select("media_id", "cue_id", "i.kind", "i.severity", at("start_ms"), at("end_ms"), X.preview(F.col("text")).alias("preview"))


def overlaps(cues: DataFrame) -> DataFrame:
    """Cues that start over 200 ms before the cue before them ends."""
    before = lambda c: F.lag(c).over(by_time())
    seen = cues.select("media_id", "cue_id", *ORDER, before("end_ms").alias("before_end"), before("cue_id").alias("before_id"))
    late = seen.where(F.col("before_end") - F.col("start_ms") > C.OVERLAP_MS)
    return late.select("media_id", F.col("before_id").alias("first_id"), F.col("cue_id").alias("second_id"), "start_ms", F.greatest("before_end", "end_ms").alias("end_ms"))


def with_islands(cues: DataFrame) -> DataFrame:
    """cues with `norm` and `island`: runs of equal meaningful texts with gaps of four seconds at most."""
    normal = cues.withColumn("norm", X.for_comparison(F.col("text")))
    w = by_time()
    same = (F.col("norm") != "") & (F.col("norm") == F.lag("norm").over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) <= C.REPEAT_GAP_MS)
    return normal.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w)).drop("fresh")


def severe(n: Column, span: Column, vocal: Column) -> Column:
    limit = F.when(vocal, C.SEVERE_VOCAL_MS).otherwise(C.SEVERE_TEXT_MS)
    return (n >= C.CLUSTER_CUES) & ((n >= C.SEVERE_CUES) | (span > limit))


def repeat_clusters(cues: DataFrame) -> DataFrame:
    """Islands of three cues or more: (media_id, first_id, n, start_ms, end_ms, kind, severity, cue_ids)."""
    rows = with_islands(cues)
    grouped = rows.groupBy("media_id", "island").agg(
        F.count("*").alias("n"), F.first("norm").alias("norm"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.struct(*ORDER)).alias("end_ms"), F.min_by("cue_id", F.struct(*ORDER)).alias("first_id"),
        F.array_sort(F.collect_list("cue_id")).alias("cue_ids"),
    ).where(F.col("n") >= C.CLUSTER_CUES)
    vocal = X.vocalization(F.col("norm"))
    bad = severe(F.col("n"), F.col("end_ms") - F.col("start_ms"), vocal)
    return grouped.select(
        "media_id", "first_id", "n", "start_ms", "end_ms", F.when(vocal, "repeated-vocalization-cluster").otherwise("repeated-text-cluster").alias("kind"),
        F.when(bad, "error").otherwise("warning").alias("severity"), "cue_ids",
    )


def all_issues(cues: DataFrame) -> DataFrame:
    """Issues of every rule: (media_id, kind, severity, start_ms, end_ms, cue_ids)."""
    single = cue_issues(cues).select("media_id", "kind", "severity", "start_ms", "end_ms", F.array("cue_id").alias("cue_ids"))
    twice = overlaps(cues).select("media_id", F.lit("timeline-overlap").alias("kind"), F.lit("error").alias("severity"), "start_ms", "end_ms", F.array("first_id", "second_id").alias("cue_ids"))
    many = repeat_clusters(cues).select("media_id", "kind", "severity", "start_ms", "end_ms", "cue_ids")
    return single.unionByName(twice).unionByName(many)


def flagged(cues: DataFrame) -> DataFrame:
    """cues with one boolean a rule. One exchange by medium serves all windows."""
    w = by_time()
    island = Window.partitionBy("media_id", "island")
    d, n = F.col("duration_ms"), F.length("clean")
    rows = with_islands(with_measures(cues)).select(
        "*", (F.lag("end_ms").over(w) - F.col("start_ms") > C.OVERLAP_MS).alias("late"), (F.col("end_ms") - F.lead("start_ms").over(w) > C.OVERLAP_MS).alias("overlapped"),
        F.count("*").over(island).alias("island_n"), F.min("start_ms").over(island).alias("island_from"),
        F.last("end_ms").over(island.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("island_to"),
        F.row_number().over(island.orderBy(*ORDER)).alias("island_i"),
    )
    vocal = X.vocalization(F.col("norm"))
    low_information = (n <= 3) & (d > 8000)
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "invalid": d <= 0, "over": d > 30000, "low_information": low_information, "short_text": ~low_information & (n <= 15) & (d > 15000),
        "late": no(F.col("late")), "overlapped": no(F.col("overlapped")), "vocal": vocal, "cluster": F.col("island_n") >= C.CLUSTER_CUES,
        "bad_cluster": severe(F.col("island_n"), F.col("island_to") - F.col("island_from"), vocal),
    })


def report(cues: DataFrame, *more: Column) -> DataFrame:
    """One row a medium: counts, the longest cue (the first of equals), suspicious cues and whether no error was found;
    and more aggregates of cues' columns."""
    d = F.col("duration_ms")
    error = F.col("invalid") | F.col("over") | F.col("low_information") | F.col("low") | F.col("late") | F.col("bad_cluster")
    any_issue = error | F.col("short_text") | F.col("overlapped") | F.col("cluster")
    head = F.col("cluster") & (F.col("island_i") == 1)
    out = flagged(cues).groupBy("media_id").agg(
        F.count("*").alias("cue_count"),
        F.max(F.struct(d.alias("d"), (-F.col("start_ms")).alias("s"), (-F.col("end_ms")).alias("e"), (-F.col("pos")).alias("p"), "cue_id")).alias("m"),
        *(F.count_if(d > s * 1000).alias(f"over_{s}") for s in (10, 20, 30, 60)),
        F.count_if("invalid").alias("invalid_duration"), F.count_if("low_information").alias("low_information_long"), F.count_if("low").alias("low_diversity"),
        F.count_if("late").alias("n_overlaps"), F.count_if(head).alias("repeated_clusters"), F.count_if(head & F.col("vocal")).alias("repeated_vocalizations"),
        F.count_if(any_issue).alias("suspicious"), (F.count_if(error) == 0).alias("passed"), *more,
    )
    longest = F.when(F.col("m.d") > 0, F.col("m.cue_id")).otherwise(0)
    return out.withColumns({"longest_ms": F.greatest(F.col("m.d"), F.lit(0)), "longest_id": longest}).drop("m")


def gate(reports: DataFrame) -> DataFrame:
    """reports with `disposition` and `reason`. Takes the columns of `report`, and optionally initial_count, removed and
    compacted (0 where missing)."""
    have = reports.columns
    for c in ("initial_count", "removed", "compacted"):
        if c not in have:
            reports = reports.withColumn(c, F.lit(0).cast("long"))
    n, removed = F.col("cue_count"), F.col("removed")
    baseline = F.when(F.col("initial_count") > 0, F.col("initial_count")).otherwise(n + F.greatest(removed, F.lit(0)))
    part = lambda base, share: F.ceil(base * F.lit(share))
    least = lambda k, base, share: F.greatest(F.lit(k).cast("long"), part(base, share))
    blocks = F.concat_ws(
        ",",
        F.when(n == 0, "no-cues"),
        F.when(F.col("invalid_duration") > 0, "invalid-duration"),
        F.when(F.col("over_60") > 0, "over-60-seconds"),
        F.when(F.col("over_30") > least(2, n, 0.01), "too-many-over-30-seconds"),
        F.when(F.col("n_overlaps") > least(5, n, 0.02), "too-many-overlaps"),
        F.when((baseline >= 20) & (n * 100 < baseline * 50), "under-half-kept"),
        F.when((baseline >= 20) & (removed * 100 > baseline * 40), "too-much-removed"),
        F.when((n > 0) & (F.col("suspicious") * 100 > n * 30), "too-many-suspicious"),
    )
    warn = (
        ~F.col("passed")
        | (F.col("suspicious") >= least(5, n, 0.03))
        | (removed >= least(5, F.greatest(baseline, F.lit(1)), 0.03))
        | (F.col("compacted") >= least(5, F.greatest(n, F.lit(1)), 0.01))
    )
    done = F.when(F.length("reason") > 0, "blocked").when(warn, "accepted-with-warning").otherwise("accepted")
    return reports.withColumn("reason", blocks).withColumn("disposition", done)
