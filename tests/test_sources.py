from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuelake import providers
from cuelake.functions.text import json_object
from cuelake.operators import playback
from cuelake.plans import translation
from cuelake.sources import files


def test_json_files_fall_back(spark, tmp_path):
    for name, text in (("a", json.dumps({"n": 3})), ("b", "{broken"), ("c", "[1")):
        (tmp_path / f"{name}.json").write_text(text)
    out = files.read_json(spark, str(tmp_path), "struct<n:int>", F.struct(F.lit(7).alias("n")))
    assert sorted((r.path[-6:], r.document.n) for r in out.collect()) == [("a.json", 3), ("b.json", 7), ("c.json", 7)]


def test_titles_and_arguments(spark):
    row = spark.createDataFrame([("Film.mkv 1080p - Player", r"C:\v\film.MKV", "Player64.EXE")], "t string, p string, n string")
    shown = playback.display_name(F.col("t"), "Player")
    out = row.select(shown.alias("s"), playback.title_matches(shown, F.col("p")).alias("m"), playback.is_player(F.col("n"), ("player", "player64")).alias("k")).first()
    assert (out.s, out.m, out.k) == ("Film.mkv 1080p", True, True)
    args = spark.createDataFrame([('"C:/a b.mkv"',), ("/full",), ("-x",), ("file:///D:/c.mp4",), ("notes.txt",), ("",)], "a string")
    assert [r.c for r in args.select(playback.candidate(F.col("a")).alias("c")).collect()] == ["C:/a b.mkv", None, None, "D:/c.mp4", None, None]


def echo():
    """A service that translates a text to itself between brackets, fails on texts that hold `fail`, and cuts those that hold
    `long`. A local function, so that it is sent to the workers by value."""

    def answer(body: str, max_tokens: int) -> str:
        if "fail" in body:
            raise ValueError("the service failed")
        if "long" in body and max_tokens < providers.MORE_TOKENS:
            raise providers.OutputLimit
        return f"[{body}]"

    return answer


def test_provider_retries():
    assert providers.ask(echo(), "x") == ("[x]", "ok", 1)
    assert providers.ask(echo(), "long x") == ("[long x]", "ok", 2)
    assert providers.ask(echo(), "fail") == (None, "failed", 3)


def test_repair_and_revert(spark):
    pairs = spark.createDataFrame([(1, 1, "a", None), (1, 2, "fail", " "), (1, 3, "ok", "好")], "media_id long, cue_id int, source string, target string")
    ledger = translation.repair(pairs, translation.propose(pairs, echo()))
    assert {r.cue_id: r.reason for r in ledger.collect()} == {1: "rule-repair", 2: "missing-candidate"}
    new = translation.apply(pairs, ledger)
    assert {r.cue_id: r.target for r in new.collect()} == {1: "[a]", 2: " ", 3: "好"}
    assert {r.cue_id: r.target for r in translation.revert(new, ledger).collect()} == {1: None, 2: " ", 3: "好"}


def test_objects_in_prose(spark):
    rows = [('{"a": "1"}', "1"), ('```json\n{"a": "}"}\n```', "}"), ('so: {"a": "{\\""} and {more', '{"'), ("[1]", None), ("{broken", None), (None, None), ('{"a": "x"', None), ('{no} {"a": "x"}', None), ("  none ", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    parsed = F.from_json(json_object(F.col("t")), "struct<a:string>")
    got = [r.o for r in df.select("i", parsed["a"].alias("o")).orderBy("i").collect()]
    assert got == [o for _, o in rows]


def test_request_bodies(spark):
    rows = [(1, "target", 3, 4, "x"), (1, "before", 2, 3, "b"), (1, "before", 1, 2, "a"), (2, "target", 0, 1, "あ" * 100)]
    got = {r.request_id: json.loads(r.body) for r in providers.request_bodies(spark.createDataFrame(rows, "request_id int, part string, pos int, cue_id int, text string")).collect()}
    assert got[1] == {"context_before": [{"id": 2, "text": "a"}, {"id": 3, "text": "b"}], "target_cues": [{"id": 4, "text": "x"}], "context_after": []}
    assert got[2]["target_cues"] == [{"id": 1, "text": "ああああああ（原文为大量重复拟声）"}]


def test_recent_links(spark):
    links = spark.createDataFrame([("k", "C:/a/film.mkv", 100), ("k", "C:/b/Film.MKV", 950), ("k", "C:/c/film.mkv", 990), ("k", "C:/c/other.mkv", 999), ("k", "C:/c/film.txt", 999), ("j", "C:/a/film.mkv", 399)], "key string, path string, at_s long")
    titles = spark.createDataFrame([("k", "FILM"), ("k", "film.mkv 2/3"), ("k", "nothing"), ("j", "film")], "key string, shown string")
    there = spark.createDataFrame([("c:/B/film.mkv",), ("C:/a/film.mkv",)], "path string")
    assert {tuple(r) for r in playback.recent_link(links, titles, 1000).collect()} == {("k", "FILM", "C:/c/film.mkv"), ("k", "film.mkv 2/3", "C:/c/film.mkv")}
    assert {r.path for r in playback.recent_link(links, titles, 1000, there).collect()} == {"C:/b/Film.MKV"}
    many = spark.createDataFrame([("k", f"C:/x/{i}.mkv", 1000 + i) for i in range(30)] + [("k", "C:/a/film.mkv", 999)], "key string, path string, at_s long")
    assert playback.recent_link(many, titles, 1100).count() == 0


def test_titles_without_a_name(spark):
    titles = ["Film.mkv - Player", "film - PLAYER", "Player", " player ", "", "  ", " - Player", "a - Player - Player", "x - Player ", None]
    shown = spark.createDataFrame([(t,) for t in titles], "t string").select(playback.display_name(F.col("t"), "Player").alias("s")).collect()
    assert [r.s for r in shown] == ["Film.mkv", "film", None, None, None, None, None, "a - Player", "x - Player", None]


def test_paths_are_rooted(spark):
    given = ["notes.mp4", "..\\a.mp4", "C:a.mp4", "\\\\h\\v\\a.MP4", "file:///C:/a%20b+c.mkv", "FILE://h/v/a.mkv", "file:///home/a.mkv", "/a.mkv", "-a.mkv", "C:/a.srt", '"D:/q.avi"', "file:///C:/%zz.mkv"]
    got = spark.createDataFrame([(g,) for g in given], "a string").select(playback.candidate(F.col("a")).alias("c")).collect()
    assert [r.c for r in got] == [None, None, "C:a.mp4", "\\\\h\\v\\a.MP4", "C:/a b+c.mkv", "\\\\h\\v\\a.mkv", None, None, None, None, "D:/q.avi", "C:/%zz.mkv"]


def test_a_title_has_one_row(spark):
    there = spark.createDataFrame([("C:/v/a.mkv",), ("C:/v/b.mkv",), ("C:/w/c.mp4",), ("C:/w/d.mkv",), ("C:/n/now.mkv",)], "path string")
    titles = spark.createDataFrame([(1, t) for t in ("a.mkv", "A", "b.mkv", "c.mp4", "now.mkv", "d", "e", None, "a.mkv", "gone.mkv")], "key int, shown string")
    known = spark.createDataFrame([(1, "C:/v/a.mkv", 5), (1, "C:/v/gone.mkv", 9), (1, "C:/w/x.mkv", 7)], "key int, path string, last_seq long")
    current = spark.createDataFrame([(1, "C:/n/now.mkv")], "key int, path string")
    links = spark.createDataFrame([(1, "C:/w/c.mp4", 10), (1, "C:/w/d.mkv", 10), (1, "C:/v/a.mkv", 10)], "key int, path string, at_s long")
    rows = playback.resolve(titles, known, current, links, there, 20).collect()
    got = {r.shown: r.path for r in rows}
    assert len(rows) == 8 and got == {"a.mkv": "C:/v/a.mkv", "A": "C:/v/a.mkv", "b.mkv": "C:/v/b.mkv", "c.mp4": "C:/w/c.mp4", "now.mkv": "C:/n/now.mkv", "d": "C:/w/d.mkv", "e": None, "gone.mkv": None}
