"""Answers with fields of other types than asked for."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuelake.functions import tree
from cuelake.operators import review
from cuelake.sources import files

R = "response_id int, content string"


def answers(spark, *documents):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], R)


def test_texts_of_values(spark):
    values = ["s", " s ", 5, -1.5, True, False, None, {"a": 1}, [1]]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)] + [(9, "{}"), (10, "[1]"), (11, "nothing"), (12, '{"v": "a"} and {more'), (13, None)], R)
    v = tree.field(tree.tree(F.col("content")), "v")
    got = {r.response_id: (r.t, r.there, r.f) for r in df.select("response_id", tree.text_of(v).alias("t"), v.isNotNull().alias("there"), tree.is_false(v).alias("f")).collect()}
    assert [got[i][0] for i in range(14)] == ["s", " s ", "5", "-1.5", "True", "False", "", "", "", "", "", "", "a", ""]
    assert [got[i][1] for i in range(14)] == [True] * 9 + [False] * 3 + [True, False] and [i for i in got if got[i][2]] == [5]


def test_reviews_with_loose_rows(spark):
    row = lambda **x: {"id": 1, "kind": "style", "suggestion": "s", "needs_source_check": False} | x
    docs = [
        {"issues": [row(), row(id=" 2 ", kind=None)]}, {"issues": [row(), 5]}, {"issues": [row(), None]}, {"issues": {"0": row()}}, {"issues": [row(suggestion=7, kind={"x": 1})]},
        {"issues": [row(needs_source_check=0), row(id="2", needs_source_check="false")]}, {"issues": [row(suggestion=[])]}, {"issues": [row(id=1.5)]}, {"issues": [{"id": 1}]}, {"issues": []},
        {"issues": [row(kind=True, suggestion=" Misheard ")]}, [row()], {"issues": [row(id="99999999999")]},
    ]
    r = answers(spark, *docs)
    window = r.select("response_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cue_id"))
    got = {}
    for x in review.review_rows(r, window).orderBy("response_id", "ord").collect():
        got.setdefault(x.response_id, []).append((x.cue_id, x.kind, x.suggestion, x.needs_source_check))
    assert got == {0: [(1, "style", "s", False), (2, "", "s", False)], 4: [(1, "", "7", False)], 5: [(1, "style", "s", True), (2, "style", "s", True)], 10: [(1, "True", "Misheard", True)]}


def test_translations_with_loose_rows(spark):
    pair = lambda i, zh: {"id": i, "zh": zh}
    docs = [
        {"translations": [pair(1, "a"), 5, None, {"id": 2}, pair("2", 7), pair("1", " b ")], "glossary_updates": {"x": 5, " ": "y", "z": None, "w": [1], "q": " t "}},
        {"translations": [pair(1, "a"), pair(" 2", "b")]}, {"translations": [pair(1, "a"), pair(2, {"t": "b"})]}, {"translations": "none"}, {"translations": [pair(1, "a"), pair(2, "b")], "glossary_updates": [1]},
    ]
    r = answers(spark, *docs)
    window = r.select("response_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cue_id"))
    assert sorted(map(tuple, review.translation_rows(r, window).collect())) == [(0, 1, "b"), (0, 2, "7"), (4, 1, "a"), (4, 2, "b")]
    assert sorted(map(tuple, review.glossary_updates(r, window).collect())) == [(0, "q", "t"), (0, "x", "5")]
    assert sorted(map(tuple, review.repair_rows(r, window.where("cue_id = 2")).collect())) == [(0, 2, "7"), (1, 2, "b"), (4, 2, "b")]


def test_terms_with_loose_rows(spark):
    docs = [{"terms": [{"source": " a ", "target": 1, "variants": ["x", " x", "", 3, None, {"k": 1}]}, 4, {"source": "a", "target": "again"}, {"source": "b", "target": "B", "variants": "x"}, {"source": "c", "target": []}]}]
    got = sorted(map(tuple, review.term_rows(answers(spark, *docs)).collect()))
    assert got == [(0, "a", "1", ["x", "3"]), (0, "b", "B", [])]


def test_json_files_of_any_shape(spark, tmp_path):
    for name, text in (("a", '{"x": [1, {"y": "z"}]}'), ("b", "[1, 2]"), ("c", "{broken"), ("d", "7")):
        (tmp_path / f"{name}.json").write_text(text)
    found = files.read_tree(spark, str(tmp_path)).select("path", tree.kind(F.col("document")).alias("kind"), F.try_variant_get("document", "$.x[1].y", "string").alias("y"))
    assert sorted((r.path[-6:], r.kind, r.y) for r in found.collect()) == [("a.json", "OBJECT", "z"), ("b.json", "ARRAY", None), ("c.json", None, None), ("d.json", "BIGINT", None)]
