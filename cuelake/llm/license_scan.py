"""License scans by diagonal voting, with DataFrame functions only.

Every run of k words of every text is hashed and joined to the positions of the same run in the license templates. A hit
votes for its diagonal, the offset between text and template; hits of one copy of a template share a diagonal, and where
words were put in or left out the copy goes on at a neighbouring one. Votes are counted by diagonal, neighbouring
diagonals are merged to spans, and a span counts if its hits, whose words are compared with the template's, cover
enough of the template. Templates of a few words, phrases above all, must be there as they are.

Defined results: a null, empty or wordless text has no spans, score 0 and empty labels; a text of fewer than k words has no
k-gram; overlapping spans of different templates all count; rows that repeat a doc_id and text give one equal row each;
extra columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import documents, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run for phrases and for longer templates.
PHRASE_K, TEXT_K = 2, 4
#: Diagonals that are so near are one copy; share of a template that a span must cover, if it has so many words or more.
NEIGHBOURS, COVER, LONG_WORDS = 3, 0.6, 10


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        return PHRASE_K if self.base else TEXT_K


# Phrases, and the words by which licenses are usually stated.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by", "licensed under cc by 3 0"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by", "creative commons attribution 3 0 unported"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row a run of k words of a template: a table of fixed size."""
    rows = []
    for i, t in enumerate(templates):
        for p in range(len(t.words) - t.k + 1):
            rows.append((i, t.label, t.base, t.k, len(t.words), p, t.words[p : p + t.k]))
    kind = "tid int, label string, base boolean, k int, t_words int, t_pos int, t_gram array<string>"
    grams = spark.createDataFrame(rows, kind)
    hashed = F.when(F.col("k") == PHRASE_K, F.xxhash64(*(F.col("t_gram")[j] for j in range(PHRASE_K)))).otherwise(F.xxhash64(*(F.col("t_gram")[j] for j in range(TEXT_K))))
    return grams.withColumn("h", hashed)


def words_of(text: Column) -> Column:
    """The words after A-Z are lower-cased. `lower` also maps U+212A to an ASCII letter, so that one is replaced before."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ǩ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def spans(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans: _id, _tx, doc_id, n_words, label, base, first, last (words from 0) and cover; and for each row of docs
    one row more, with a null label."""
    key = ["_id", "_tx", "doc_id", "n_words"]
    words = docs.select(*row_key(), "doc_id", words_of(F.col(text)).alias("w"))
    n = F.size("w")
    rolled = [F.col("w"), *(F.slice("w", j + 1, F.greatest(n - j, F.lit(0))) for j in range(1, TEXT_K))]
    zipped = words.select("_id", "_tx", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(rolled)))))
    named = zipped.select(*key, "pos", *(F.expr(f"col.`{name}`").alias(f"w{j}") for j, name in enumerate(zipped.schema["col"].dataType.names)))
    run = lambda k: F.struct(F.lit(k).alias("k"), F.xxhash64(*(F.col(f"w{j}") for j in range(k))).alias("h"))
    both = [run(PHRASE_K), run(TEXT_K)]
    row_mark = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("h"))  # one a row of docs
    marked = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.array(row_mark, *both)).otherwise(F.array(*both))
    grams = named.withColumn("kh", F.explode(marked)).select(*key, "pos", F.col("kh.k").alias("k"), F.col("kh.h").alias("h"), F.array(*(f"w{j}" for j in range(TEXT_K))).alias("gram"))
    known = F.broadcast(template_grams(docs.sparkSession, templates))  # fixed size
    voted = grams.join(known, ["k", "h"], "left").where((F.col("k") == 0) | F.slice("gram", 1, F.col("k")).eqNullSafe(F.col("t_gram")) & F.col("tid").isNotNull())

    # Votes by diagonal; the row marks make groups of their own, whose votes are the rows.
    kind = ["tid", "label", "base", "k", "t_words"]
    by_diagonal = voted.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy(*key, *kind, "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("hits")
    )
    # Neighbouring diagonals of a longer template become one span.
    along = Window.partitionBy(*key, *kind).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.when(F.col("base") | step.isNull() | (step > NEIGHBOURS), 1).otherwise(0)
    merged = by_diagonal.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along)).groupBy(*key, *kind, "span").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    cover = covered / F.col("t_words")
    told = merged.withColumn("cover", F.when(F.col("tid").isNotNull(), cover))
    enough = F.col("cover") >= F.when(F.col("t_words") < LONG_WORDS, 1.0).otherwise(COVER)
    return told.where(F.col("tid").isNull() | enough).select(*key, "label", "base", "first", (F.col("last") + F.col("k") - 1).alias("last"), "cover", "votes")


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    base = F.col("base")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(docs, text, templates).groupBy("_id", "_tx", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"),
        join("label").alias("labels"),
        F.coalesce(F.round(F.max("cover"), 6), F.lit(0.0)).alias("score"),
        F.count("label").alias("n_spans"),
        F.max(F.when(F.col("label").isNull(), F.col("votes"))).alias("rows"),
    )
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("_id", "_tx", "rows", "row")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


OP1_SQL = f"""
WITH t AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '{t.label}', {t.base}, {t.k}, {_quoted(t.words)})" for i, t in enumerate(TEMPLATES))}) AS v(tid, label, base, k, words)),
tg AS (SELECT tid, label, base, k, len(words) AS t_words, p AS t_pos, array_to_string(words[p + 1:p + k], ' ') AS gram
       FROM t, unnest(range(len(words) - k + 1)) AS r(p)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, kk.k, p AS pos, array_to_string(w[p + 1:p + kk.k], ' ') AS gram
       FROM d, (VALUES ({PHRASE_K}), ({TEXT_K})) AS kk(k), unnest(range(len(w) - kk.k + 1)) AS r(p)),
hits AS (SELECT dg.doc_id, dg.pos, tg.*, dg.pos - tg.t_pos AS diagonal FROM dg JOIN tg ON dg.k = tg.k AND dg.gram = tg.gram),
s1 AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER q IS NULL OR diagonal - lag(diagonal) OVER q > {NEIGHBOURS} THEN 1 ELSE 0 END AS apart
       FROM (SELECT DISTINCT doc_id, tid, base, diagonal FROM hits) WINDOW q AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
s2 AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM s1),
m AS (SELECT h.doc_id, h.tid, any_value(h.label) AS label, any_value(h.base) AS base, any_value(h.t_words) AS t_words, min(h.pos) AS first,
             len(list_distinct(flatten(list(range(h.t_pos, h.t_pos + h.k))))) / any_value(h.t_words) AS cover
      FROM hits h JOIN s2 ON h.doc_id = s2.doc_id AND h.tid = s2.tid AND h.diagonal = s2.diagonal GROUP BY h.doc_id, h.tid, s2.span),
v AS (SELECT * FROM m WHERE cover >= CASE WHEN t_words < {LONG_WORDS} THEN 1.0 ELSE {COVER} END)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base,
       CAST(min(first) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(first) FILTER (WHERE base) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE label IS NOT NULL))), ','), '') AS labels,
       coalesce(round(max(cover), 6), 0.0) AS score, count(label) AS n_spans
FROM d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id
"""
