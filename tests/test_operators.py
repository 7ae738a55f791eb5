from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelake import catalog, model
from cuelake import config as C
from cuelake.operators import clean, identity, intervals, quality, review, scenes, sinks, targets, terms
from cuelake.plans import recognition
from cuelake.sources import srt


def cues(spark, rows, media=1):
    """rows: (start_ms, end_ms, text)."""
    return spark.createDataFrame([(media, i + 1, i, s, e, t) for i, (s, e, t) in enumerate(rows)], model.CUES)


def test_bad_timeline_is_found_and_cleaned(spark):
    bad = cues(spark, [(0, 45000, "う?"), (44000, 46000, "う?"), (46000, 48000, "う?"), (48000, 50000, "う?")])
    r = quality.report(bad).first()
    assert not r.passed and r.over_30 == 1 and r.repeated_vocalizations == 1
    out = clean.sanitize(bad)
    assert out.count() <= 3 and quality.report(out.drop("compacted")).first().passed


def test_repeated_speech_keeps_three(spark):
    many = cues(spark, [(2000 * i, 2000 * i + 1500, "同じ台詞") for i in range(10)])
    assert clean.sanitize(many).count() <= 3
    assert recognition.clean_and_gate(many).first().disposition != "accepted"


@pytest.mark.parametrize(("change", "disposition"), [({}, "accepted"), ({"invalid_duration": 1}, "blocked"), ({"suspicious": 3}, "accepted"), ({"suspicious": 5}, "accepted-with-warning"), ({"suspicious": 28}, "blocked"), ({"n_overlaps": 5}, "accepted"), ({"n_overlaps": 6}, "blocked"), ({"over_30": 3}, "blocked"), ({"removed": 41}, "blocked")])
def test_gate_limits(spark, change, disposition):
    base = {"media_id": 1, "cue_count": 90, "invalid_duration": 0, "over_60": 0, "over_30": 0, "n_overlaps": 0, "suspicious": 0, "passed": True, "initial_count": 100, "removed": 4, "compacted": 0}
    base["removed"] = 2
    row = spark.createDataFrame([tuple((base | change).values())], ", ".join(f"{k} {'boolean' if k == 'passed' else 'long'}" for k in base))
    assert quality.gate(row).first().disposition == disposition


@pytest.mark.parametrize(("rows", "kinds"), [([(0, 0, "abcd")], {"invalid-duration"}), ([(0, 30001, "abcdefghijklmnopqrst")], {"over-30-seconds"}), ([(0, 8000, "abc")], set()), ([(0, 8001, "abc")], {"low-information-long"}), ([(0, 15001, "abcdefghijklmno")], {"short-text-long"}), ([(0, 1000, "a" * 16)], {"low-character-diversity"}), ([(0, 1000, "ab" * 7)], set())])
def test_issue_limits(spark, rows, kinds):
    assert {r.kind for r in quality.cue_issues(cues(spark, rows)).collect()} == kinds


def naive_repair(rows):
    out = []
    for s, e in sorted(rows):
        if out and s < out[-1][1]:
            out[-1][1] = s
            if out[-1][1] - out[-1][0] < 200:
                out.pop()
        if e - s >= 200:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_overlap_repair_equals_the_loop(spark):
    rng = random.Random(5)
    media = {m: [(s := rng.randrange(0, 4000), s + rng.randrange(0, 1500)) for _ in range(rng.randrange(1, 14))] for m in range(60)}
    rows = [(m, i + 1, i, s, e, "x") for m, r in media.items() for i, (s, e) in enumerate(r)]
    got: dict = {m: [] for m in media}
    for r in clean.repair_overlaps(spark.createDataFrame(rows, model.CUES)).collect():
        got[r.media_id].append((r.start_ms, r.end_ms))
    assert {m: sorted(v) for m, v in got.items()} == {m: naive_repair(r) for m, r in media.items()}


def naive_scenes(rows, most=35, seconds=150):
    out, start, i = [], 0, 0
    for i, (s, e) in enumerate(rows):
        if i > start and i - start >= 12 and s - rows[i - 1][1] >= 4000:
            out.append((start, i - 1))
            start = i
        elif i - start + 1 >= most or e - rows[start][0] >= seconds * 1000:
            out.append((start, i))
            start = i + 1
    if start < len(rows):
        out.append((start, len(rows) - 1))
    return out


def test_scenes_equal_the_loop(spark):
    rng = random.Random(7)
    media = {}
    for m in range(40):
        at, rows = 0, []
        for _ in range(rng.randrange(1, 120)):
            at += rng.choice([500, 1500, 4000, 5000])
            rows.append((at, at := at + rng.randrange(500, 4000)))
        media[m] = rows
    media[40] = [(5000 * i, 5000 * i + 2000) for i in range(100)]
    data = [(m, i + 1, i, s, e, "x") for m, r in media.items() for i, (s, e) in enumerate(r)]
    got: dict = {m: [] for m in media}
    for r in scenes.build(spark.createDataFrame(data, model.CUES)).orderBy("media_id", "scene_idx").collect():
        got[r.media_id].append((r.start_pos, r.end_pos))
    assert got == {m: naive_scenes(r) for m, r in media.items()}
    assert got[40] == [(0, 30), (31, 61), (62, 92), (93, 99)]


def test_thirty_scenes_select_six_over_the_whole_medium(spark):
    scored = spark.createDataFrame([(1, i, 1 + 12 * (i < 8), 10_000 * i, 10_000 * i + 2000) for i in range(30)], "media_id long, scene_idx int, score long, start_ms long, end_ms long")
    chosen = [r.scene_idx for r in scenes.select_risky(scored).orderBy("scene_idx").collect()]
    assert len(chosen) == 6 and max(chosen) >= 20 and any(10 <= c < 20 for c in chosen)


def test_srt_round_trip_and_parse(spark):
    two = cues(spark, [(0, 2000, "one"), (3000, 5000, "two\nlines")])
    text = sinks.render(two).first().content
    assert text.startswith("1\r\n00:00:00,000 --> 00:00:02,000\r\none\r\n")
    messy = "﻿7\r\n0:00:01,5 --> x\r\nskipped\r\n\r\n00:75:00.000 --> 00:75:01.500 x\n  kept  \n\n3\n00:00:01,000 --> 00:00:02,000\n\n"
    files = spark.createDataFrame([(1, text), (2, messy)], "media_id long, content string")
    got = [(r.media_id, r.cue_id, r.start_ms, r.end_ms, r.text) for r in srt.parse(files).orderBy("media_id", "cue_id").collect()]
    assert got == [(1, 1, 0, 2000, "one"), (1, 2, 3000, 5000, "two\nlines"), (2, 1, 4_500_000, 4_501_500, "kept")]


def test_retry_ranges_split_and_cap(spark):
    issues = spark.createDataFrame([(1, "k", "error", 0, 70_000, [1], ""), (1, "k", "warning", 80_000, 90_000, [2], "")], model.ISSUES)
    durations = spark.createDataFrame([(1, 60_000)], "media_id long, audio_ms long")
    got = [(r.start_ms, r.end_ms) for r in intervals.retry_ranges(issues, durations).orderBy("piece").collect()]
    assert got == [(0, 30_000), (30_000, 60_000)]
    assert intervals.retry_ranges(issues, durations, 1).count() == 1


def test_circuit_breaker_after_two_failures(spark):
    rows = [(1, i, i in (2, 3)) for i in range(1, 8)]
    out = review.circuit_breaker(spark.createDataFrame(rows, "run_id long, seq long, failed boolean")).orderBy("seq").collect()
    assert [r.skipped for r in out] == [False] * 3 + [True] * 4


def test_budget_is_a_prefix(spark):
    rows = [(1, i, 10, 60_001 if i == 3 else 10, 0) for i in range(1, 6)]
    out = review.admit(spark.createDataFrame(rows, "run_id long, seq long, tokens long, chars long, at_ms long")).orderBy("seq").collect()
    assert [r.admitted for r in out] == [True, True, False, False, False]


def test_envelope_and_review_rows(spark):
    bodies = [('{"choices":[{"finish_reason":"length","message":{"content":"x"}}]}', "output-limit"), ('{"choices":[]}', "no-choices"), ("nonsense", "no-choices"), ('{"choices":[{"finish_reason":"stop","message":{"content":" "}}]}', "blank"), ('{"choices":[{"finish_reason":"stop","message":{"content":"ok"}}]}', "ok"), ('{"choices":[{"finish_reason":"tool","message":{"content":"ok"}}]}', "not-finished")]
    df = spark.createDataFrame([(b,) for b, _ in bodies], "b string")
    assert [r.s for r in df.select(review.envelope(F.col("b"))[0].alias("s")).collect()] == [s for _, s in bodies]
    responses = [(1, '{"issues":[{"id":"1","suggestion":"fix","needs_source_check":false},{"id":2,"suggestion":"x","kind":"misheard","needs_source_check":false}]}'), (2, '{"issues":[{"id":"9","suggestion":"fix"}]}'), (3, '{"issues":[{"id":"1","suggestion":" "}]}')]
    windows = spark.createDataFrame([(r, c) for r in (1, 2, 3) for c in (1, 2)], "response_id long, cue_id int")
    got = review.review_rows(spark.createDataFrame(responses, "response_id long, content string"), windows).orderBy("cue_id").collect()
    assert [(r.response_id, r.cue_id, r.needs_source_check) for r in got] == [(1, 1, False), (1, 2, True)]


def test_translation_rows_are_complete_or_nothing(spark):
    responses = [(1, '{"translations":[{"id":"1","zh":"a"},{"id":"2","zh":"b"},{"zh":"skip"}]}'), (2, '{"translations":[{"id":"1","zh":"a"}]}'), (3, '{"translations":[{"id":"1","zh":"a"},{"id":"2","zh":"b"},{"id":"5","zh":"c"}]}')]
    windows = spark.createDataFrame([(r, c) for r in (1, 2, 3) for c in (1, 2)], "response_id long, cue_id int")
    got = review.translation_rows(spark.createDataFrame(responses, "response_id long, content string"), windows)
    assert {(r.response_id, r.cue_id) for r in got.collect()} == {(1, 1), (1, 2)}


def test_journal(spark):
    rows = [(1, 1, 1, None, "a", True), (1, 1, 2, "a", "b", True), (1, 1, 3, "b", "c", False), (1, 2, 4, "x", None, True)]
    changes = spark.createDataFrame(rows, "media_id long, cue_id int, seq long, before string, after string, accepted boolean")
    assert {(r.cue_id, r.value) for r in review.undo(changes).collect()} == {(1, None), (2, "x")}
    assert {(r.cue_id, r.value) for r in review.replay(changes).collect()} >= {(1, "b")}


def test_resume_and_probe(spark):
    runs = spark.createDataFrame([(1, True, [("failed", 1, None)]), (2, True, [("failed", 2, None)]), (3, True, [("skipped", 0, "circuit-open")]), (4, False, [("failed", 0, None)])], "run_id long, within_budget boolean, windows array<struct<status:string,attempts:int,reason:string>>")
    assert [r.can_resume for r in review.can_resume(runs).orderBy("run_id").collect()] == [True, False, True, False]
    columns = "media_id long, signature string, state_hash string, report_hash string, output_hash string"
    receipts = spark.createDataFrame([(m, "s", "a", "b", "c", False) for m in (1, 2, 3)], columns + ", resumable boolean")
    now = spark.createDataFrame([(1, "s", "a", "b", "c"), (2, "s", "z", "b", "c"), (3, "s", "a", "b", None), (4, "s", "a", "b", "c")], columns)
    assert {r.media_id: r.result for r in identity.probe(receipts, now).collect()} == {1: "hit", 2: "error", 3: "miss", 4: "miss"}


def test_spelling_and_honorifics(spark):
    lines = spark.createDataFrame([(1, "アリスとアリスタ、田中さん")], "media_id long, text string")
    forms = spark.createDataFrame([("アリス", "エリス", 1), ("アリス", "オリス", 2)], "variant string, canonical string, ord int")
    assert terms.correct_spelling(lines, forms, r"[\x{30a1}-\x{30f6}]").first().text == "エリスとアリスタ、田中さん"
    found = {r.term for r in terms.candidates(lines).collect()}
    assert {"アリス", "アリスタ"} <= found and any(t.endswith("田中さん") for t in found)


def test_sources_by_rank(spark):
    files = spark.createDataFrame([("v", "v.jp.srt"), ("v", "v.jpn.srt"), ("w", "w.en.srt")], "stem string, name string")
    wanted = spark.createDataFrame([(1, "v", "ja"), (2, "w", "en"), (3, "v", "ko")], "media_id long, stem string, language string")
    assert {r.media_id: r.name for r in identity.sidecar_source(files, wanted).collect()} == {1: "v.jpn.srt", 2: "w.en.srt"}


def test_target_defects(spark):
    rows = [(None, "missing"), (" ", "missing"), ("こ", "source-leak"), ("字" * 97, "too-long"), ("哈" * 24, "repetition"), ("好的", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.d for r in df.select(targets.defect(F.col("t")).alias("d")).collect()] == [d for _, d in rows]


def test_config():
    assert C.Config(" JA ", "best", 5, 10, -1, 40, 0).normalized() == C.Config("ja", "fast", 35, 150, 4, 16, 3)


def test_keys_of_large_groups_do_not_meet(spark, tmp_path, monkeypatch):
    scenes_of = spark.createDataFrame([(5, 1001), (5, 1002), (6, 2)], "media_id long, scene_idx int")
    monkeypatch.setattr(catalog, "_scenes", lambda *_: scenes_of)
    assert sorted(map(tuple, catalog.pending_scenes(spark, "").collect())) == [(5, 1001), (6, 2)]
    turns = spark.createDataFrame([(1, 102, ""), (2, 2, "better")], "conv_id long, turn int, text string")
    monkeypatch.setattr(catalog.fx, "table", lambda *_: turns)
    assert [(r.response_id, r.cue_id) for r in catalog.review_parse(spark, "").collect()] == [(202, 2)]
    assert [tuple(r) for r in catalog.suggestion_first(spark, "").collect()] == [(2, 2, "better")]


def test_tiers_are_compared_by_seven_measures(spark):
    raw = cues(spark, [(0, 11000, "a line of some length, long enough"), (12000, 33500, "another line of some length here"), (40000, 71000, "a third line of some length here"), (80000, 80050, "short one")])
    got = {r.measure: (r.fast, r.quality) for r in recognition.summary(raw, clean.sanitize(raw), raw).collect()}
    assert got == {"cue_count": (4, 2), "suspicious": (1, 0), "removed": (0, 2), "over_10": (3, 2), "over_20": (2, 1), "over_30": (1, 0), "longest_ms": (31000, 21500)}
    none = raw.limit(0)
    assert {(r.fast, r.quality) for r in recognition.summary(none, none, none).collect()} == {(0, 0)}


def test_conflicts_with_a_long_term_list(spark):
    listed = spark.range(10_050).select(F.format_string("t%05d", "id").alias("term"), F.format_string("r%05d", "id").alias("rendering"))
    wanted = [*range(60), *range(9_990, 10_050)]
    pairs = spark.createDataFrame([(1, i, f"a t{i:05d} b", f"r{i:05d}", "none") for i in wanted], "media_id long, cue_id int, source string, original string, proposed string")
    assert sorted(r.cue_id for r in targets.new_conflicts(pairs, listed).collect()) == wanted


def test_texts_of_both_languages_are_written(spark, tmp_path):
    two = cues(spark, [(0, 2000, " one "), (3000, 5000, "two")])
    told = spark.createDataFrame([(1, 1, "一")], "media_id long, cue_id int, target string")
    assert [r.text for r in sinks.translated(two, told).orderBy("cue_id").collect()] == ["一", ""]
    both = sinks.render(sinks.bilingual(two, told), "body")
    assert both.first().content == "1\r\n00:00:00,000 --> 00:00:02,000\r\none\r\n一\r\n\r\n2\r\n00:00:03,000 --> 00:00:05,000\r\ntwo\r\n\r\n\r\n"
    sinks.write(both, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).where("value like '%two%'").select("media_id").first().media_id == 1


def test_published_files(spark):
    row = {"media_id": 1, "stem": "a:b", "present": True, "beside": True, "existing": None, "legacy_target": "t", "legacy_bilingual": "x", "source": "s", "target": "t", "bilingual": "b", "own": None}
    kinds = ", ".join(f"{k} {'long' if k == 'media_id' else 'boolean' if k in ('present', 'beside') else 'array<string>' if k == 'own' else 'string'}" for k in row)
    cases = {None: "write", "b": "keep", "s": "replace", "t": "replace", "old": "replace", "f": "foreign"}
    media = spark.createDataFrame([tuple((row | {"media_id": i, "existing": e, "own": ["old"]}).values()) for i, e in enumerate(cases)] + [tuple((row | {"media_id": 50, "present": False}).values()), tuple((row | {"media_id": 51, "beside": False}).values())], kinds)
    files = sinks.publish_files(media)
    got = {(r.media_id, r.name): r.action for r in files.collect()}
    assert [got[i, "a:b.srt"] for i in range(len(cases))] == list(cases.values())
    assert got[0, "a:b.zh-CN.srt"] == "delete" and (0, "a:b.ja-zh-CN.srt") not in got and got[0, "a_b-bilingual.srt"] == "write"
    assert not any(m == 50 for m, _ in got) and sum(m == 51 for m, _ in got) == 3
    assert sorted(r.media_id for r in sinks.publish_warnings(media, files).collect()) == [5, 50]


def test_untagged_sidecars_only_for_japanese(spark):
    files = spark.createDataFrame([("v", "v.srt", "これは日本語の字幕です"), ("w", "w.srt", "plain english"), ("x", "x.srt", "これは日本語の字幕です"), ("x", "x.jpn.srt", "x")], "stem string, name string, content string")
    wanted = spark.createDataFrame([(1, "v", "ja"), (2, "w", "ja"), (3, "x", "ja"), (4, "v", "en"), (5, "v", "ja")], "media_id long, stem string, language string")
    own = spark.createDataFrame([(5, "これは日本語の字幕です")], "media_id long, t string").select("media_id", identity.text_hash(F.col("t")).alias("hash"))
    assert {r.media_id: r.name for r in identity.sidecar_source(files, wanted, own).collect()} == {1: "v.srt", 3: "x.jpn.srt"}


def test_flags_that_are_no_booleans_need_a_check(spark):
    flags = {"false": False, "true": True, '"false"': True, "0": True, "null": True}
    responses = [(i, f'Well: {{"issues":[{{"id":1,"suggestion":"fix","needs_source_check":{f}}}]}} done') for i, f in enumerate(flags)]
    windows = spark.createDataFrame([(i, 1) for i in range(len(flags))], "response_id long, cue_id int")
    got = review.review_rows(spark.createDataFrame(responses, "response_id long, content string"), windows)
    assert {r.response_id: r.needs_source_check for r in got.collect()} == dict(enumerate(flags.values()))


def test_repair_answers_may_be_partial(spark):
    answer = '{"translations":[{"id":"1","zh":"a"},{"id":1,"zh":" b "},{"id":"9","zh":"c"},{"id":"2","zh":" "},{"zh":"d"}]}'
    got = review.repair_rows(spark.createDataFrame([(1, answer), (2, "none")], "response_id long, content string"), spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "response_id long, cue_id int"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "b")]


def test_time_is_up_at_the_limit(spark):
    rows = [(1, 1, 10, 10, 0), (1, 2, 10, 10, C.TIME_LIMIT_MS - 1), (1, 3, 10, 10, C.TIME_LIMIT_MS), (2, 1, C.TOKEN_LIMIT + 1, 10, 0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, tokens long, chars long, at_ms long")
    assert [r.admitted for r in review.admit(df).orderBy("run_id", "seq").collect()] == [True, True, False, False]
    assert all(r.admitted for r in review.admit(df, thinking=True).collect())


def test_usage_is_known_only_with_both_counts(spark):
    bodies = ['{"usage":{"prompt_tokens":5,"completion_tokens":7,"completion_tokens_details":{"reasoning_tokens":3}}}', '{"usage":{"prompt_tokens":5}}', "{}", "nonsense", '{"usage":{"prompt_tokens":-1,"completion_tokens":2}}']
    r = review.usage(spark.createDataFrame([(1, b) for b in bodies], "run_id long, body string")).first()
    assert (r.responses, r.unknown, r.prompt_tokens, r.completion_tokens, r.reasoning_tokens, r.with_reasoning) == (5, 3, 5, 9, 3, 1)


def test_summary_of_a_run_with_everything_open(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    windows = frame([(1, 0, "succeeded"), (1, 1, "failed"), (2, 0, "succeeded")], "run_id long, scene_idx long, status string")
    issues = frame([(1, 0, 3, False), (1, 0, 4, True), (1, 1, 5, False), (2, 0, 1, False)], "run_id long, scene_idx long, cue_id long, needs_source_check boolean")
    changes = frame([(1, 3, False, "deterministic-defect"), (2, 1, True, "fix")], "run_id long, cue_id long, accepted boolean, reason string")
    repairs = frame([(1, "failed"), (2, "succeeded")], "run_id long, status string")
    remaining = frame([(1, 2, 1), (2, 0, 0)], "run_id long, defects long, conflicts long")
    got = {r.run_id: r for r in review.summary(windows, issues, changes, repairs, remaining, frame([(1,)], "run_id long")).collect()}
    assert got[1].warning == "reviewed 1/2; limit reached; repairs not finished; defects 2; source checks 1; unresolved 2; term conflicts 1"
    assert (got[1].status, got[1].readable, got[2].status, got[2].warning, got[2].fixed) == ("partial", False, "limited-review-complete", "", 1)


def test_variants_and_words_of_terms(spark):
    pairs = spark.createDataFrame([(1, 1, "Annie's annual O'Neil", "x"), (1, 2, "the neil", "x"), (1, 3, "東京へ", "y"), (1, 4, "Ann", "A"), (1, 5, "kanji 山", "z"), (1, 6, "New  York", "z"), (1, 7, "in NEW YORK.", "z")], "media_id long, cue_id int, source string, target string")
    listed = spark.createDataFrame([("Ann", "A", None), ("O'Neil", "N", [" ", "neil"]), ("東京", "T", []), ("山", "Y", None), ("New York", "NY", None), (" ", "?", ["the"])], "term string, rendering string, variants array<string>")
    assert sorted(r.cue_id for r in terms.glossary_defects(pairs, listed).collect()) == [1, 2, 3, 5, 7]
    lines = pairs.select("cue_id", F.col("source").alias("text"))
    assert {(r.cue_id, r.term) for r in terms.matches(lines, listed, ("cue_id",)).collect()} == {(1, "O'Neil"), (3, "東京"), (4, "Ann"), (5, "山"), (7, "New York")}


def test_many_spellings_are_joined_by_run(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "ab cd, ab"), (2, ""), (3, "ab cd, ab"), (4, None)], "media_id long, text string")
    forms = spark.createDataFrame([("ab", "AB", 1), ("cd", "X", 2), ("cd", "Y", 1)], "variant string, canonical string, ord int")
    few = sorted(map(str, terms.correct_spelling(lines, forms, "[a-z]").collect()))
    monkeypatch.setattr(terms, "FORMS_IN_A_ROW", 0)
    assert sorted(map(str, terms.correct_spelling(lines, forms, "[a-z]").collect())) == few
    assert "AB Y, AB" in few[0]


def test_context_falls_back_to_sampled_lines(spark):
    lines = spark.createDataFrame([(0, "a x"), (1, "b"), (2, "x x")], "pos int, text string")
    none = spark.createDataFrame([], "term string")
    sampled = lines.where("pos = 1").select("pos", F.col("text").alias("line"))
    assert [r.pos for r in terms.build_context(lines, none, sampled, ("pos",)).collect()] == [1]
    assert [r.pos for r in terms.build_context(lines, spark.createDataFrame([("x",)], "term string"), sampled, ("pos",)).orderBy("pos").collect()] == [0, 2]


def test_term_answers_and_cache_keys(spark):
    answer = '{"terms":[{"source":"a","target":"A","variants":["x","x"]},{"source":"a","target":"B"},{"source":" ","target":"C"},{"source":"d"}]}'
    got = review.term_rows(spark.createDataFrame([(1, "Terms: " + answer)], "response_id long, content string")).collect()
    assert [(r.source, r.target, r.variants) for r in got] == [("a", "A", ["x"])]
    keys = spark.createDataFrame([("0123456789abcdef01234567",), ("short",), ("0123456789ABCDEF01234567",)], "k string")
    assert [r.v for r in keys.select(identity.is_cache_key(F.col("k")).alias("v")).collect()] == [True, False, False]


def test_sources_from_files_are_trusted(spark):
    bad = cues(spark, [(0, 45000, "う?")])
    assert (r := recognition.trusted(bad).first()).passed and r.disposition == "trusted"


def test_large_contents_are_fingerprinted_by_segments(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(identity, "SMALL", 100)
    monkeypatch.setattr(identity, "SEGMENT", 16)
    raw = bytes(range(250))
    parts = b"".join((o := (250 - 16) * i // 8).to_bytes(8, "little") + raw[o : o + 16] for i in range(9))
    want = hashlib.sha256(b"cue-content-v1" + (250).to_bytes(8, "little") + parts).hexdigest()
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(identity.fingerprint(F.col("c")).alias("f")).first().f == want


def test_renderings_are_handed_on_by_their_size(spark, monkeypatch):
    import pyarrow as pa

    cues = spark.createDataFrame([(1, 1, 0, 1000, "ああ")], "media_id long, cue_id int, start_ms long, end_ms long, text string")
    kept = []
    with monkeypatch.context() as m:
        m.setattr(type(cues), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
        sinks.render(cues)
    media, block = [i // 40 for i in range(8000)], "あ" * 1000 + "\r\n"
    rows = pa.table({"media_id": media, "block": [block] * 8000, "cue_id": pa.array([i % 40 for i in range(8000)], pa.int32())})
    out = list(kept[0](iter(rows.to_batches(500))))
    assert pa.Table.from_batches(out).to_pydict() == {"media_id": list(range(200)), "content": [block * 40] * 200}
    assert sum(b.nbytes for b in out) > 24_000_000 and max(b.nbytes for b in out) < 1_300_000


def test_bilingual_renderings_of_long_media_go_one_by_one(spark, monkeypatch):
    import pyarrow as pa

    cues = spark.createDataFrame([(1, 1, 0, 1000, "ああ")], "media_id long, cue_id int, start_ms long, end_ms long, text string")
    told = spark.createDataFrame([(1, 1, "A")], "media_id long, cue_id int, target string")
    kept = []
    with monkeypatch.context() as m:
        m.setattr(type(cues), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
        sinks.render(sinks.bilingual(cues, told), "body")
    rows = pa.table({"media_id": [i // 400 for i in range(1600)], "block": ["あ\r\n" * 600] * 1600, "cue_id": pa.array([i % 400 for i in range(1600)], pa.int32())})
    out = [b.to_pydict() for b in kept[0](iter(rows.to_batches(100))) if b.num_rows]
    assert out == [{"media_id": [i], "content": ["あ\r\n" * 240_000]} for i in range(4)]


def test_a_rendering_is_held_once(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    cues = spark.createDataFrame([(1, 1, 0, 1000, "ああ")], "media_id long, cue_id int, start_ms long, end_ms long, text string")
    told = spark.createDataFrame([(1, 1, "A")], "media_id long, cue_id int, target string")
    kept = []
    with monkeypatch.context() as m:
        m.setattr(type(cues), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
        sinks.render(sinks.bilingual(cues, told), "body")
    block = "あ\r\n" * 600
    rows = (pa.record_batch({"media_id": [i // 40] * 100, "block": [block] * 100, "cue_id": pa.array(range(100), pa.int32())}) for i in range(120))
    list(kept[0](iter([])))  # modules are loaded
    tracemalloc.start()
    try:
        sizes = [len(b["content"][0].as_buffer()) for b in kept[0](rows) if b.num_rows]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [4000 * 600 * 5] * 3 and peak < 1.5 * sizes[0]
