"""Work by key that many tasks share: the rows of a key are dealt into bins of time or of positions.

A bin's rows are those of one stretch, which is what a task holds; what reaches over the edges of bins is carried by copies of
the rows beside them, or by a table with few rows a bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds, or positions, of a bin.
BIN_MS, BIN_ROWS = 600_000, 4096


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str, width: int | None = None) -> DataFrame:
    """rows with their number from 1 in the order of their key, whose first column is a time. Rows are ranked within bins, and the
    bins' counts are added up along a key. Both read one exchange, as the counts refer to all columns."""
    dealt = rows.withColumn("_bin", F.coalesce(F.floor(F.col(order[0]) / (width or BIN_MS)), F.lit(-(2**40)))).repartition(key, "_bin")
    counts = dealt.groupBy(key, "_bin").agg(F.count("*").alias("_n"), F.max(F.xxhash64(*dealt.columns)).alias("_all")).where("_all is not null")
    along = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    earlier = counts.select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_bin").orderBy(*order)))
    placed = ranked.join(earlier, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b")))
    return placed.withColumn(name, (F.col("_i") + F.col("_before")).cast("int")).drop("_bin", "_i", "_k", "_b", "_before")


def merged(ranges: DataFrame, key: str, gap_ms: int, width: int | None = None) -> DataFrame:
    """(key, start_ms, end_ms): ranges of a key that meet, or leave a gap of gap_ms at most, as one. They are merged within bins of
    their starts first; of what is left, a bin holds no more than its length has gaps, and that is merged along the key."""

    def joined(rows: DataFrame, *within: str) -> DataFrame:
        w = Window.partitionBy(key, *within).orderBy("start_ms", "end_ms")
        reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0)
        groups = rows.withColumn("_fresh", fresh).withColumn("_g", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return groups.groupBy(key, *within, "_g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_g")

    binned = ranges.select(key, "start_ms", "end_ms", F.floor(F.col("start_ms") / (width or BIN_MS)).alias("_bin"))
    return joined(joined(binned, "_bin").drop("_bin"))


def outside(rows: DataFrame, key: str, twice_at: Column, ranges: DataFrame, width: int | None = None) -> DataFrame:
    """The rows whose time lies in no range [start_ms, end_ms) of their key. twice_at: twice the time, so that midpoints are whole.
    Ranges stand in each bin that they touch, so rows and ranges meet by key and bin."""
    width = width or BIN_MS
    spread = ranges.where("end_ms > start_ms").select(
        F.col(key).alias("_k"), F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))).alias("_b"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")
    )
    placed = rows.withColumn("_at", twice_at).withColumn("_bin", F.floor(F.col("_at") / (2 * width)))
    inside = (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col("_at") >= 2 * F.col("_from")) & (F.col("_at") < 2 * F.col("_to"))
    return placed.join(spread, inside, "left_anti").drop("_at", "_bin")


def with_halo(rows: DataFrame, position: str, before: int, after: int, width: int | None = None) -> DataFrame:
    """rows in bins of their positions (whole numbers without gaps) as `_bin`, and in each bin copies of the rows up to `before` in
    front of it and up to `after` behind it; `_own` tells the bin's own rows. A window by key and bin that reaches so far sees what
    one by key sees."""
    width = width or BIN_ROWS
    at = F.col(position)
    bins = F.sequence(F.floor((at - after) / width), F.floor((at + before) / width))
    own = F.floor(at / width)
    return rows.withColumn("_bin", F.explode(bins)).withColumn("_own", F.col("_bin") == own)
