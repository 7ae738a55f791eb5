from __future__ import annotations

import json
import os
import random

import pytest

from cuelake.streaming import live

SNAPSHOTS = "key long, at_ms long, seq long, players array<string>, running boolean, starts boolean"


def test_launch_policy_steps():
    state = (set(), set(), 0, 0)
    state, tried = live.observe(state, {"a"}, False, 0, False)
    assert tried and state[0] == {"a"}
    state, tried = live.observe(state, {"a"}, False, 1000, False)
    assert not tried
    for now in (5000, 10_000):
        state, tried = live.observe(state, {"a"}, False, now, False)
        assert tried
    assert not state[0]
    state, tried = live.observe(state, {"a", "b"}, False, 16_000, True)
    assert tried and not state[0]
    state, tried = live.observe(state, {"a", "b", "c"}, True, 30_000, True)
    assert not tried and not state[0]


def rows(n=40):
    return [(i % 2, 700 * i, i, [f"p{j}" for j in range(i % 4)], i % 11 == 0, i % 5 == 0) for i in range(n)]


def streamed(spark, tmp_path, name, schema, batches, run):
    """The rows of a stream that reads the batches one after the other."""
    source = tmp_path / "in"
    source.mkdir()
    columns = [c.split()[0] for c in schema.split(", ")]
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in batch))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def shuffled(data, reach, parts, rng):
    """The rows in batches, each out of its place by `reach` at most."""
    order = sorted(range(len(data)), key=lambda i: i + rng.uniform(0, reach))
    size = -(-len(data) // parts)
    return [[data[i] for i in order[k : k + size]] for k in range(0, len(data), size)]


END = 10_000_000


@pytest.mark.parametrize("forget_ms", [None, 5_000])
def test_launch_stream_equals_batch(spark, tmp_path, forget_ms):
    data = [(i % 2, 5000 + 700 * i + 9000 * (i > 25), i, [f"p{j}" for j in range(i % 4)], i % 11 == 0, i % 5 == 0) for i in range(40)]
    batches = [*shuffled(data, 6, 5, random.Random(1)), [(7, END, 999, [], False, False)]]
    got = streamed(spark, tmp_path, f"launches_{forget_ms}", SNAPSHOTS, batches, lambda s: live.launch_stream(s, forget_ms))
    want = sorted(map(tuple, live.launches(spark.createDataFrame(data, SNAPSHOTS), forget_ms).collect()), key=str)
    assert [r for r in got if r[0] < 7] == want and len(want) == 40


def test_a_machine_that_rests_is_new_again(spark):
    data = [(1, 0, 0, ["p"], False, True), (1, 1000, 1, ["p"], False, True), (1, 9000, 2, ["p"], False, True)]
    told = lambda forget: [r.launched for r in live.launches(spark.createDataFrame(data, SNAPSHOTS), forget).orderBy("at_ms").collect()]
    assert told(None) == [True, False, False] and told(8000) == [True, False, True] and told(8001) == [True, False, False]


EVENTS = "session long, at_ms long, seq long, path string"


def test_played_stream_equals_batch(spark, tmp_path):
    data = [(i % 2, 5000 + 300 * i + 2500 * (i // 17), i, [None, "A.mkv", "a.MKV", "b.mkv", "b.mkv"][i * i % 5]) for i in range(70)]
    batches = [*shuffled(data, 9, 6, random.Random(2)), [(7, END, 999, "x.mkv")]]
    got = streamed(spark, tmp_path, "played", EVENTS, batches, live.played_stream)
    want = sorted(map(tuple, live.played(spark.createDataFrame(data, EVENTS)).collect()), key=str)
    assert [r for r in got if r[0] < 7] == want and sum(r[2] is None for r in want) >= 6


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(1, 500, 0, "a.mkv"), (1, 60_000, 1, "b.mkv")], [(1, 60_500, 2, "c.mkv")], [(1, 1000, 3, "late.mkv")], [(7, END, 9, "x.mkv")]]
    got = streamed(spark, tmp_path, "dropped", EVENTS, batches, live.played_stream)
    assert [r for r in got if r[0] < 7] == sorted([(1, 500, "a.mkv"), (1, 2500, None), (1, 60_000, "b.mkv"), (1, 60_500, "c.mkv"), (1, 62_500, None)], key=str)


def test_players_that_show_nothing(spark):
    data = [(1, 0, 0, None), (1, 1000, 1, "a"), (1, 2900, 2, None), (1, 4800, 3, "A"), (1, 9000, 4, "a"), (2, 0, 0, None)]
    got = sorted(map(tuple, live.played(spark.createDataFrame(data, EVENTS)).collect()), key=str)
    assert got == sorted([(1, 1000, "a"), (1, 6800, None), (1, 9000, "a"), (1, 11_000, None)], key=str)


def test_session_stream_counts_runs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = [0, 1, 1.5, 9, 10, 400]  # the last one moves the watermark beyond the others
    (source / "0.json").write_text("\n".join(json.dumps({"key": 1, "ts": f"2024-01-01T00:{int(t // 60):02d}:{t % 60:06.3f}Z"}) for t in at))
    stream = spark.readStream.schema("key long, ts timestamp").json(str(source))
    run = live.session_stream(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.n for r in spark.table("sessions").collect()) == [2, 3]


def test_requests_end_and_players_leave(spark):
    queued = spark.createDataFrame([("a", 1), ("b", 2)], "key string, seq long")
    assert [r.key for r in live.complete(queued, spark.createDataFrame([("a",)], "key string")).collect()] == ["b"]
    known = spark.createDataFrame([(1, ["p", "q"]), (2, ["p"])], "key long, players array<string>")
    now = spark.createDataFrame([(1, ["q", "r"])], "key long, players array<string>")
    assert {r.key: r.players for r in live.still_active(known, now).collect()} == {1: ["q"], 2: []}
