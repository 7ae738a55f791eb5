"""Terms in texts: the automaton against the rule tried term by term."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from cuelake.functions import automaton
from cuelake.functions import text as X
from cuelake.operators import targets, terms

PIECES = ["a", "A", "Ann", "ann", "ANN ", "annual", "é", "É", "ß", "_", "-", " ", ".", "1", "カ", "カナ", "さん", "K", "ſ", "s", "k", "I", "İ", "ı", "i", "Σ", "ς", "σ", "o'neil", "\\E", "𝒜", "x", "\n"]


def test_terms_equal_the_rule_tried_one_by_one(spark):
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, n)))
    texts = [(i, made(12)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "   ")]
    forms = sorted({made(4) for _ in range(250)} - {t for t in ("",)})
    forms = [(f,) for f in forms if "\\E" not in f] + [(None,), (" ",), ("",)]
    rows, listed = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(forms, "term string")
    got = {tuple(r) for r in terms.hits(rows, "text", listed).collect()}
    want = {tuple(r) for r in rows.crossJoin(listed).where(X.contains_term(F.col("text"), F.col("term"))).select("id", "term").collect()}
    assert got == want and len(want) > 1000


def test_terms_are_taken_literally(spark):
    rows = spark.createDataFrame([(1, r"see a\Eb and c")], "id int, text string")
    assert [r.term for r in terms.hits(rows, "text", spark.createDataFrame([(r"a\Eb",), ("a.Eb",)], "term string")).collect()] == [r"a\Eb"]


def test_more_terms_than_an_automaton_holds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i} and w{i + 1} in {i}") for i in range(50)], "id int, text string")
    listed = spark.createDataFrame([(f"w{i}", i) for i in range(60)] + [("w7", 100), ("W7", 101)], "term string, note int")
    want = sorted(map(tuple, terms.hits(rows, "text", listed).collect()))
    monkeypatch.setattr(automaton, "TERMS", 7)
    assert sorted(map(tuple, terms.hits(rows, "text", listed).collect())) == want
    monkeypatch.setattr(automaton, "TERMS", 100)
    monkeypatch.setattr(automaton, "CHARS", 30)
    assert sorted(map(tuple, terms.hits(rows, "text", listed).collect())) == want
    assert {(i, n) for i, _, n in want if n > 99} == {(i, n) for i in (6, 7) for n in (100, 101)}


def test_long_texts_and_long_lists(spark):
    listed = [f"名{i}" for i in range(6000)] + [f"Term{i:05d}" for i in range(4001)]
    lookup = automaton.Lookup(listed)
    rng = random.Random(1)
    made = [" ".join(rng.choice(listed + ["and", "the", "言葉"] * 4000) for _ in range(n)) for n in (20_000, 160_000)]
    took = []
    for text in made:
        began = time.process_time()
        found = lookup(text)
        took.append(time.process_time() - began)
        assert set(found) >= {w for w in text.split(" ") if w.startswith("Term")} and len(found) > 3000
    assert len(made[1]) > 800_000 and took[1] < 20 and took[1] < 24 * max(took[0], 0.05)
    rows = spark.createDataFrame([(1, made[1], "t"), (2, "Term00007x", "t"), (3, "term00007", "t")], "id int, text string, other string")
    table = spark.createDataFrame([(t,) for t in listed], "term string")
    got = terms.hits(rows, "text", table)
    assert "text" not in got.columns and got.groupBy("id").count().orderBy("id").collect()[1] == (3, 1)


@pytest.mark.parametrize("terms_at_once", [3, 100])
def test_defects_and_conflicts_by_variants(spark, monkeypatch, terms_at_once):
    monkeypatch.setattr(automaton, "TERMS", terms_at_once)
    listed = spark.createDataFrame([("Alice", "艾丽丝", ["Alyce", " "]), ("ボブ", "鲍勃", None), ("Eve", " ", None)], "term string, rendering string, variants array<string>")
    pairs = spark.createDataFrame([(1, 1, "alyce came", "她来了"), (1, 2, "ALICE came", "艾丽丝来了"), (1, 3, "malice", "恶意"), (1, 4, "ボブさん", "先生"), (1, 5, "ボブ", None), (1, 6, "Eve", "x")], "media_id long, cue_id int, source string, target string")
    assert {r.cue_id for r in terms.glossary_defects(pairs, listed).collect()} == {1, 4}
    proposals = pairs.select("media_id", "cue_id", "source", F.col("target").alias("original"), F.lit("别的").alias("proposed"))
    assert {r.cue_id for r in targets.new_conflicts(proposals, listed).collect()} == {2, 5}


def test_context_lines_keep_their_order(spark):
    cues = spark.createDataFrame([(i, t) for i, t in enumerate(["a x", "b", "a", "ab", "a b", None, "a", "c" * 200 + "b"])], "pos int, text string")
    got = terms.context_lines(cues, spark.createDataFrame([("a",), ("b",), ("zz",)], "term string"), ("pos",)).collect()
    assert [tuple(r) for r in got] == [(0, "a x"), (1, "b"), (2, "a"), (3, "ab"), (4, "a b")]
