from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as X


def value(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column(F.col("t"), F.col("u") if "u" in values else None).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [("う?", "う"), (" a　b! ", "ab"), (None, ""), ("", ""), ("…。", "")],
)
def test_meaningful(spark, text, expected):
    assert value(spark, lambda t, u: X.meaningful(t.cast("string")), t=text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ん" * 15, "ん" * 15), ("ん" * 16, "ん、ん、ん……"), ("ab" * 10, "ab、ab、ab……"), ("hello there everyone", "hello there everyone")],
)
def test_compact_repetition(spark, text, expected):
    assert value(spark, lambda t, u: X.compact_repetition(t), t=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("ああ", True), ("ふう", True), ("z" * 12, True), ("z" * 13, False), ("ab", False), ("", False)])
def test_vocalization(spark, text, expected):
    assert value(spark, lambda t, u: X.vocalization(t), t=text) is expected


@pytest.mark.parametrize(
    ("text", "term", "expected"),
    [
        ("annual Anna", "Ann", False), ("in ANN's home", "Ann", True), ("Ann", "Ann", True), ("xAnn", "Ann", False), ("_Ann", "Ann", False),
        ("東京タワー", "東京", True), ("東", "東京", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("", "Ann", False), ("Ann", " ", False),
    ],
)
def test_contains_term(spark, text, term, expected):
    assert value(spark, lambda t, u: X.contains_term(t, u), t=text, u=term) is expected


@pytest.mark.parametrize(("ms", "expected"), [(0, "00:00:00,000"), (3_723_004, "01:02:03,004"), (360_000_000, "100:00:00,000")])
def test_clock(spark, ms, expected):
    assert value(spark, lambda t, u: X.clock(t.cast("long")), t=ms) == expected


@pytest.mark.parametrize(("text", "expected"), [("```json\n{}\n```", "{}"), ("{}", "{}"), ("```x", "```x")])
def test_strip_fence(spark, text, expected):
    assert value(spark, lambda t, u: X.strip_fence(t), t=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("哈" * 24, True), ("哈" * 19, False), ("!" * 24, True), ("!" * 23, False), ("普通的一句话没有问题普通的一句话", False)])
def test_excessive_repetition(spark, text, expected):
    assert value(spark, lambda t, u: X.excessive_repetition(t), t=text) is expected


@pytest.mark.parametrize(("text", "expected"), [("こんにちは", True), ("こんに", False), ("abcdefghijklmnopqrstuvwこんにちは", False), ("東京都庁舎", True), ("東京 abc 12, 都庁舎", True), ("漢字", False), ("漢字かな交 a", True)])
def test_looks_japanese(spark, text, expected):
    assert value(spark, lambda t, u: X.looks_japanese(t), t=text) is expected


def test_compact_cue_and_names(spark):
    assert value(spark, lambda t, u: X.compact_cue(t), t="あ" * 100) == "ああああああ（原文为大量重复拟声）"
    assert value(spark, lambda t, u: X.compact_cue(t), t="short") == "short"
    assert value(spark, lambda t, u: X.safe_file_name(t), t="a<b>:c..") == "a_b__c"
    assert value(spark, lambda t, u: X.safe_file_name(t), t="..") == "video"
    assert value(spark, lambda t, u: X.media_extension(t), t="x/y.MKV") is True
    assert value(spark, lambda t, u: X.media_extension(t), t="x.srt") is False
