"""Work by key that tasks share equals work by key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake import model
from cuelake.functions import bins
from cuelake.operators import intervals, scenes

ROWS = "k long, start_ms long, end_ms long, pos int"


def made(n: int, seed: int, reach: int = 50_000) -> list[tuple]:
    """A hot key with two thirds of all rows, ties, a negative time and missing ones."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2, None]), (s := rng.randrange(-2000, reach, 100)), s + rng.randrange(-200, 4000, 100), i) for i in range(n)]
    return [*rows, (1, None, 5, n), (None, None, None, n + 1)]


@pytest.mark.parametrize("width", [700, 10**9])
def test_numbers_are_those_of_a_window(spark, width):
    rows = spark.createDataFrame(made(600, 1), ROWS).repartition(5)
    order = ("start_ms", "end_ms", "pos")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = bins.numbered(rows, "k", order, "n", width)
    assert sorted(map(str, got.select("k", "pos", "n").collect())) == sorted(map(str, want.select("k", "pos", "n").collect()))
    assert got.columns == want.columns


def test_numbering_reads_its_rows_once(spark):
    out = bins.numbered(spark.createDataFrame(made(300, 2), ROWS).repartition(3), "k", ("start_ms", "pos"), "n", 700)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def merged_by_loop(ranges, gap):
    out = []
    for k, start, end in sorted(ranges):
        if out and out[-1][0] == k and start <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([k, start, end])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [500, 3000, 10**9])
def test_ranges_are_merged_over_the_edges_of_bins(spark, width):
    for seed in range(3):
        rng = random.Random(seed)
        ranges = [(rng.choice([1, 1, 2]), (s := rng.randrange(0, 60_000, 50)), s + rng.choice([0, 100, 400, 9000])) for _ in range(150)]
        got = bins.merged(spark.createDataFrame(ranges, "k long, start_ms long, end_ms long"), "k", 300, width)
        assert sorted(map(tuple, got.collect())) == merged_by_loop(ranges, 300)


@pytest.mark.parametrize("width", [300, 7000, 10**9])
def test_rows_outside_of_ranges(spark, width):
    rng = random.Random(9)
    points = [(rng.choice([1, 1, 2, 3]), rng.randrange(-500, 20_000), i) for i in range(500)]
    ranges = [(k, s, s + n) for k in (1, 2) for s, n in ((0, 250), (1000, 4000), (4500, 100), (9000, 0), (12_000, 3333), (-400, 100))]
    got = bins.outside(spark.createDataFrame(points, "k long, twice long, i int"), "k", F.col("twice"), spark.createDataFrame(ranges, "k long, start_ms long, end_ms long"), width)
    want = {i for k, t, i in points if not any(k == r and 2 * a <= t < 2 * b for r, a, b in ranges)}
    assert {r.i for r in got.collect()} == want and got.columns == ["k", "twice", "i"]


@pytest.mark.parametrize("width", [3, 10, 4096])
def test_neighbours_over_the_edges_of_bins(spark, monkeypatch, width):
    monkeypatch.setattr(bins, "BIN_ROWS", width)
    rows = spark.createDataFrame([(m, i, f"{m}.{i}") for m, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)], "media_id long, pos int, text string").repartition(4)
    got = {(r.media_id, r.pos): (r.ctx_before, r.ctx_after) for r in scenes.context(rows, 4, 2).collect()}
    n = {1: 40, 2: 3, 3: 1}
    assert got == {(m, i): ([f"{m}.{j}" for j in range(max(0, i - 4), i)], [f"{m}.{j}" for j in range(i + 1, min(n[m], i + 3))]) for m in n for i in range(n[m])}


def scenes_by_loop(times, max_cues, max_ms):
    out, first = [], 0
    began, tested = None, True
    for i, (start, end) in enumerate(times):
        count = i - first
        if count >= C.PAUSE_CUES and start - times[i - 1][1] >= C.PAUSE_MS:
            out.append((first, i - 1))
            first = i
        elif count + 1 >= max_cues or end - times[first][0] >= max_ms:
            out.append((first, i))
            first = i + 1
    return out + ([(first, len(times) - 1)] if first < len(times) else [])


@pytest.mark.parametrize("max_cues, seconds", [(35, 150), (13, 60), (100, 20)])
def test_scenes_of_a_hot_medium_are_made_by_many_tasks(spark, monkeypatch, max_cues, seconds):
    monkeypatch.setattr(bins, "BIN_ROWS", 8)
    rng = random.Random(max_cues)
    data, want = [], []
    for m, n in ((1, 3000), (2, 70), (3, 71), (4, 1), (5, 140), (6, 12)):
        at, times = 0, []
        for _ in range(n):
            at += rng.choice([200, 1000, 3000, 3000, 9000])
            times.append((at, end := at + rng.choice([500, 2000, 4000, 170_000 if rng.random() < 0.05 else 900])))
            at = max(at, min(end, at + 5000))
        data += [(m, i + 1, i, s, e, "x") for i, (s, e) in enumerate(times)]
        want += [(m, k, a, b) for k, (a, b) in enumerate(scenes_by_loop(times, max_cues, seconds * 1000))]
    rng.shuffle(data)
    cues = spark.createDataFrame(data, "media_id long, cue_id int, pos int, start_ms long, end_ms long, text string").repartition(6)
    built = scenes.build(cues, max_cues, seconds)
    assert sorted(map(tuple, built.collect())) == sorted(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        assert built.where("media_id = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scenes_by_other_orders(spark):
    cues = spark.createDataFrame([("a", 10 * i, 1000 * (40 - i), 1000 * (40 - i) + 500) for i in range(40)], "media_id string, pos int, start_ms long, end_ms long")
    assert sorted(map(tuple, scenes.build(cues, 16, 9999, ("start_ms", "end_ms", "pos")).collect())) == [("a", 0, 0, 15), ("a", 1, 16, 31), ("a", 2, 32, 39)]
    assert scenes.build(cues.limit(0)).count() == 0


def test_retry_ranges_over_the_edges_of_bins(spark, monkeypatch):
    rng = random.Random(3)
    issues = [(m, "k", "error", (s := rng.randrange(0, 400_000)), s + rng.randrange(10, 9000), [1], "") for m in (1, 1, 1, 2) for _ in range(20)]
    table = spark.createDataFrame(issues, model.ISSUES)
    durations = spark.createDataFrame([(1, 390_000), (2, 5000)], "media_id long, audio_ms long")
    want = sorted(map(str, intervals.retry_ranges(table, durations).collect()))
    monkeypatch.setattr(bins, "BIN_MS", 4000)
    assert sorted(map(str, intervals.retry_ranges(table, durations).collect())) == want and len(want) > 10
