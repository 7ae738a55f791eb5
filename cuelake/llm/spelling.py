"""Spelling variants: words that are one edit apart, found in a forward and a reversed sorted dictionary.

Of two words that differ by one inserted, deleted or replaced character, with m the length of the shorter one, the first or
the last m // 2 characters are the same. So the dictionary is sorted twice, by the words and by the reversed words, and read
as blocks that share such a prefix or suffix; each word stands in the blocks of its own length and of one less. A block of
more than BLOCK words is divided, and so are its parts: the same holds for the characters between what a block is known to
share, so of these again the first or the last half stays intact. Each level is one range-partitioned scan whose tasks
verify the pairs of small blocks and hand the words of larger ones on, as they stream by, to the next level. A block
ends at one character between, where it holds no more words than the alphabet allows.

A pair is counted once: a block by a suffix leaves out the pairs that share the prefix as well (`cap`).

Defined results: null texts have no words; a null doc_id counts as empty in the checksum; equal counts go by code points;
documents that are repeated count as often; extra columns are not looked at; with no words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, scratch, small_batches, staged

#: Fewest characters and occurrences of a word.
LENGTH, COUNT = 5, 3
#: One run in so many loses a character.
NOISE = 97
#: How many times as frequent as a word its form must be.
RATIO = 2
#: Words of a block whose pairs are verified; larger blocks are divided.
BLOCK = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_ROW = "m int, a int, b int, cap int, pre string, suf string, word string, n long"
_KEY = ("m", "pre", "suf", "a", "b", "cap")


def noisy(run: Column, doc_id: Column) -> Column:
    """The run, or where NOISE divides the checksum of document and run, the run without one character."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of LENGTH characters and COUNT occurrences at least, with their noise."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    found = each.select(noisy(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def dictionaries(counted: DataFrame) -> DataFrame:
    """Each word in the blocks by its first and by its last characters, in its own length and in one less."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))
    sized = counted.select(m.alias("m"), "word", "n").where(F.col("m") > 0).withColumn("h", (F.col("m") / 2).cast("int"))
    none = F.lit("")
    forward = sized.select("m", F.col("h").alias("a"), F.lit(0).alias("b"), "m", F.substring("word", F.lit(1), F.col("h")), none, "word", "n")
    last = F.when(F.col("h") > 0, F.reverse(F.substring(F.reverse("word"), F.lit(1), F.col("h")))).otherwise(none)
    backward = sized.select("m", F.lit(0).alias("a"), F.col("h").alias("b"), "h", none, last, "word", "n")
    names = [f.split()[0] for f in _ROW.split(", ")]
    return forward.toDF(*names).withColumn("cap", F.col("cap") + 1).unionByName(backward.toDF(*names))


def shared(x: str, y: str, a: int) -> int:
    """Length of the common prefix of x and y, of which `a` characters are known to be alike."""
    n = min(len(x), len(y))
    while a < n and x[a : a + 16] == y[a : a + 16]:
        a += 16
    a = min(a, n)
    while a < n and x[a] == y[a]:
        a += 1
    return a


def near(x: str, y: str, at: int) -> bool:
    """Whether x and y, different words that share exactly their first `at` characters, are one edit apart; x isn't longer."""
    return x[at + 1 :] == y[at + 1 :] if len(x) == len(y) else x[at:] == y[at + 1 :]


def verified(m: int, a: int, cap: int, block: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """(word, number of near words, n of the most frequent one, that word) of a block, for pairs whose shorter word has m
    characters and whose common prefix is shorter than `cap`."""
    found: dict[str, tuple[int, int, str]] = {}

    def met(word: str, n: int, other: str) -> None:
        c, most, best = found.get(word, (0, 0, ""))
        found[word] = (c + 1, n, other) if (-n, other) < (-most, best) else (c + 1, most, best)

    short, long = [w for w in block if len(w[0]) == m], [w for w in block if len(w[0]) == m + 1]
    for i, (x, nx) in enumerate(short):
        for others in (short[i + 1 :], long):
            for y, ny in others:
                at = shared(x, y, a)
                if at < cap and near(x, y, at):
                    met(x, ny, y)
                    met(y, nx, x)
    return [(word, *rest) for word, rest in found.items()]


def divided(m: int, a: int, b: int, cap: int, word: str) -> list[tuple[int, int, int, int, str, str]]:
    """The keys of a word of a large block by the first and by the last half of what is between its shared ends."""
    q = (m - a - b) // 2
    key = lambda a, b, cap: (m, a, b, cap, word[:a], word[len(word) - b :])
    return [key(a + q, b, cap), key(a, b + q, min(cap, a + q))]


def scan(rows: DataFrame, limit: int = BLOCK) -> DataFrame:
    """One level: rows (word, n_near, best_n, best) of the verified blocks, and those with `word` null in place of it, whose
    other columns are the rows of the next level."""
    small_batches(rows.sparkSession)
    schema = T.StructType.fromDDL(f"near string, n_near long, best_n long, best string, {_ROW}")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (m, _, _, a, b, cap), mine in groupby(every, key=lambda row: row[: len(_KEY)]):
            block: list[tuple[str, int]] = []
            large = False
            for *_, word, n in mine:
                block.append((word, n))
                if large := large or len(block) > limit and m - a - b > 1:
                    out += ((None, None, None, None, *key, w, c) for w, c in block for key in divided(m, a, b, cap, w))
                    block.clear()
                if len(out) >= 10_000:
                    yield handed()
            if len(block) > 1:
                out += ((*row, *[None] * 8) for row in verified(m, a, cap, block))
        yield handed()

    spread = rows.select(*_KEY, "word", "n").repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "word")
    return spread.mapInArrow(run, schema)


def near_words(counted: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; each once) that have near words, `best` being the most frequent."""
    level, found = staged(dictionaries(counted), "spelling-blocks"), []
    while True:
        scanned = staged(scan(level, limit), "spelling-near")
        found.append(scanned.where("near is not null").select(F.col("near").alias("word"), "n_near", "best_n", "best"))
        level = scanned.where("near is null").select(*(f.split()[0] for f in _ROW.split(", ")))
        if level.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    first = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.n")).alias("best_n"), "f.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which have no circles: the last form, by doubling the steps."""
    hops = staged(forms.select("word", F.col("form").alias("to")), "spelling-hops")
    while True:
        on = hops.select(F.col("word").alias("to"), F.col("to").alias("then"))
        hops = staged(hops.join(on, "to", "left").select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "spelling-hops")
        if hops.where("moved").isEmpty():
            return hops.select("word", F.col("to").alias("root"))


def variants(counted: DataFrame, ratio: int = RATIO, limit: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n; each once): a word's form is its most frequent near word, if
    that has `ratio` times its count."""
    with scratch(counted.sparkSession):
        listed = staged(counted, "spelling-words", outlives=True)
        chosen = listed.join(near_words(listed, limit), "word", "left")
        formed = F.col("best_n") >= ratio * F.col("n")
        chosen = staged(
            chosen.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")),
            "spelling-forms",
            outlives=True,
        )
        ends = staged(roots(chosen.where("form is not null")), "spelling-roots", outlives=True)
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(documents(spark, sf_dir)))


OP12_SQL = f"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY i) AS crc_of FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
runs AS (
  SELECT p, run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS p, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents) GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(p || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x) - 64] END)),
                                 lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc),
counted AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {COUNT}),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM counted, unnest(range(length(word))) AS r(i)),
pairs AS (
  SELECT DISTINCT x.word, y.word AS other, y.n AS m FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT DISTINCT x.word, y.word, y.n FROM less x JOIN counted y ON x.rest = y.word
  UNION SELECT DISTINCT y.word, x.word, x.n FROM less x JOIN counted y ON x.rest = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, ROW(-m, other)) AS other FROM pairs GROUP BY word),
f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
      FROM counted c LEFT JOIN best b ON c.word = b.word),
path AS (SELECT word, word AS root, form FROM f UNION ALL SELECT path.word, f.word, f.form FROM path JOIN f ON path.form = f.word)
SELECT f.word, f.form, path.root, f.n, f.n_near, f.form_n FROM f JOIN path ON f.word = path.word WHERE path.form IS NULL
"""
