"""Quality rules: counts of bad signs, and how far a text's distributions lie from its language's.

Each text gives a histogram of character classes and one of common words. A language's reference is the sum of the
histograms of all its rows. A text is compared with the references by the Jensen-Shannon distance (square root of the
divergence, base 2, so 0 to 1); the nearest language counts, for words and characters together. Short texts have
unsteady histograms, so a text is judged only from a minimum length on.

Defined results: null and empty texts have no words, so they fail the base rules; a text under the minimum length is
not judged by distance (both distances are null); rows with a null lang belong to no reference; with no references no
text is judged; equal distances go to the first language by code point; a repeated row counts each time; extra
columns pass through, but those that have the names of results are replaced by them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, small_batches, staged
from ._words import chunks

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Words and letters from which on a text is judged by its distributions.
JUDGED_WORDS = 40
JUDGED_CHARS = 200
#: Distances beyond which a text is dropped.
MOST_CHAR_DISTANCE = 0.32
MOST_WORD_DISTANCE = 0.45
SYMBOLS = "#*$%&|<>"
#: What may stand around a word of the histogram.
AROUND = ".,;:!?\"'()|%&*$#"

# Frequent words of some languages; the bins of the word histogram, beside one for all other words.
COMMON_WORDS = (
    "a and are as at be by for from in is it of on that the this to was with "
    "au avec ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "als auch auf aus das dem den der des die ein eine für ist mit nicht sich sie und von werden zu "
    "al como con del el en es la las lo los más no para por que se su una y"
).split()
WORD_BINS = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
N_WORD_BINS = len(WORD_BINS) + 1

# Character classes: ASCII lower and upper case, digit, line feed, other space, sentence mark, other mark, symbol,
# accented letter, other letter, control, rest.
N_CHAR_BINS = 12


def _char_classes() -> np.ndarray:
    out = np.full(65536, 11, np.uint8)
    for c in range(65536):
        x = chr(c)
        if c < 128:
            k = 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if c == 10 else 4 if x.isspace() else 5 if x in ".,;:!?" else 7 if x in SYMBOLS else 10 if c < 32 else 6
        elif 0xD800 <= c < 0xE000:
            k = 11
        else:
            k = 8 if x.isalpha() and c < 0x250 else 9 if x.isalpha() else 2 if x.isdecimal() else 4 if x.isspace() else 11
        out[c] = k
    return out


_CLASSES: list[np.ndarray] = []


def char_histogram(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_char_classes())
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
    return np.bincount(_CLASSES[0][points], minlength=N_CHAR_BINS)


def word_histogram(words: list[bytes]) -> np.ndarray:
    out = np.zeros(N_WORD_BINS, np.int64)
    seen = Counter(words)
    for w, n in seen.items():
        out[WORD_BINS.get(w.decode("utf-8", "replace").lower().strip(AROUND), 0)] += n
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of WINDOW words that occur twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(cover)[: len(words)] > 0).sum())


def signs(text: str | None) -> dict:
    """The counts of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at space and \x09-\x0D, and nothing else
    lines = Counter(s for s in text.split("\n") if s.strip(" \t\n\r\x0b\x0c"))
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": sum(lines.values()) - len(lines),
        "n_repeat_words": repeated_words(words),
        "chars": char_histogram(text),
        "words": word_histogram(words),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts and both histograms (`chars`, `words`) of each whole text."""
    small_batches(df.sparkSession)
    added = T.StructType.fromDDL(", ".join(f"{c} long" for c in COUNTS) + ", chars array<long>, words array<long>")
    keep = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    schema = T.StructType(keep + added.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in (c for batch in batches for c in chunks(batch, text)):
            rows = [signs(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            columns = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            columns += [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in added.fields]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def references(measured: DataFrame, lang: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Each language's summed histograms of characters and words: one row a language comes to the driver."""

    def total(column: str, n: int):
        return F.array(*(F.sum(F.col(column)[i]) for i in range(n))).alias(column)

    got = measured.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(total("chars", N_CHAR_BINS), total("words", N_WORD_BINS))
    return {r.lang: (r.chars, r.words) for r in sorted(got.collect(), key=lambda r: r.lang)}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of each row of counts p to one row of counts q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2

    def part(x):
        ratio = np.divide(x, m, out=np.ones_like(m), where=(x > 0) & (m > 0))
        return (x * np.log2(ratio)).sum(1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def judge(measured: DataFrame, known: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """measured with `nearest`, `char_distance`, `word_distance` (to the nearest language), base_failed and kept."""
    added = T.StructType.fromDDL("nearest string, char_distance double, word_distance double")
    keep = [f for f in measured.schema.fields if f.name not in ("chars", "words", *added.fieldNames())]
    schema = T.StructType(keep + added.fields)
    names = list(known)
    chars = [np.array(known[x][0], float) for x in names]
    words = [np.array(known[x][1], float) for x in names]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            n = b.num_rows
            get = lambda c: b.column(b.schema.get_field_index(c))
            p = np.array(get("chars").to_pylist(), float).reshape(n, N_CHAR_BINS)
            w = np.array(get("words").to_pylist(), float).reshape(n, N_WORD_BINS)
            told = (w.sum(1) >= JUDGED_WORDS) & (p.sum(1) >= JUDGED_CHARS) & bool(names)
            dc = np.stack([distance(p, q) for q in chars]) if names else np.zeros((1, n))
            dw = np.stack([distance(w, q) for q in words]) if names else np.zeros((1, n))
            k = (dc + dw).argmin(0)
            at = np.arange(n)
            new = [[names[i] if t else None for i, t in zip(k, told, strict=True)], *([float(v) if t else None for v, t in zip(d[k, at], told, strict=True)] for d in (dc, dw))]
            columns = [get(f.name) for f in keep] + [pa.array(v, arrow.field(f.name).type) for v, f in zip(new, added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return measured.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    measured = staged(measure(docs).drop("text"), "rules")
    out = judge(measured, references(measured))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "nearest", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


# Character classes in the order of their bins, as SQL knows them; the last is what is left.
_SQL_CLASSES = (
    "a-z", "A-Z", r"0-9\p{Nd}", r"\x0A", r"\x09\x0B-\x0D\x1C-\x20\x{85}\p{Z}", ".,;:!?", r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F",
    SYMBOLS, r"\x{80}-\x{24F}", r"\p{L}", r"\x00-\x08\x0E-\x1B",
)


def _sql_counts() -> str:
    """A list of the counts of t's characters by class. `s` has none of the marks and symbols, `l` is t's letters beyond ASCII."""
    size = lambda text, keep: f"length(regexp_replace({text}, '[^{keep}]', '', 'g'))"
    marks, symbols = size("t", _SQL_CLASSES[5]), size("t", _SQL_CLASSES[7])
    counts = [size("t", c) for c in _SQL_CLASSES]
    counts[6] = f"({counts[6]} - {marks} - {symbols})"
    counts[8], counts[9] = size("l", _SQL_CLASSES[8]), f"(length(l) - {size('l', _SQL_CLASSES[8])})"
    return f"[{', '.join(counts)}]"


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, regexp_replace(coalesce(text, ''), '[\\x{{10000}}-\\x{{10FFFF}}]', chr(9731), 'g') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
             regexp_replace(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'), '[^\\p{{L}}]', '', 'g') AS l FROM d),
u AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
g AS (SELECT * FROM (SELECT rid, p, word{"".join(f" || ' ' || lead(word, {i}) OVER q" for i in range(1, WINDOW))} AS k FROM u WINDOW q AS (PARTITION BY rid ORDER BY p)) WHERE k IS NOT NULL),
r AS (SELECT rid, len(list_distinct(flatten(list(range(p, p + {WINDOW}))))) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1 GROUP BY rid),
m AS (SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) AS n_chars, {_sql_counts()} AS c
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT word, i FROM (SELECT unnest({list(WORD_BINS)}) AS word, unnest(range(1, {N_WORD_BINS})) AS i)),
f AS (SELECT rid, coalesce(i, 0) AS bin, count(*) AS n FROM (SELECT rid, trim(lower(unnest(w)), '{AROUND.replace("'", "''")}') AS word FROM w) LEFT JOIN b USING (word) GROUP BY ALL),
x AS (  -- histograms: every bin of every text
  SELECT rid, lang, 'char' AS part, bin, CASE WHEN bin < {N_CHAR_BINS - 1} THEN c[bin + 1] ELSE n_chars - list_sum(c) END AS n, n_chars AS total FROM m, unnest(range({N_CHAR_BINS})) AS r(bin)
  UNION ALL SELECT m.rid, lang, 'word', r.bin, coalesce(n, 0), n_words FROM m CROSS JOIN unnest(range({N_WORD_BINS})) AS r(bin) LEFT JOIN f ON f.rid = m.rid AND f.bin = r.bin),
q AS (SELECT *, n / greatest(sum(n) OVER (PARTITION BY lang, part), 1) AS q FROM (SELECT lang, part, bin, sum(n) AS n FROM x WHERE lang IS NOT NULL GROUP BY ALL)),
js AS (SELECT rid, lang, part, sqrt(greatest(least(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 1), 0)) AS js
       FROM (SELECT rid, q.lang, x.part, x.n / greatest(total, 1) AS p, q FROM x JOIN q ON x.part = q.part AND x.bin = q.bin) GROUP BY ALL),
n AS (SELECT rid, arg_min(lang, (dc + dw, lang)) AS nearest, arg_min(dc, (dc + dw, lang)) AS dc, arg_min(dw, (dc + dw, lang)) AS dw
      FROM (SELECT rid, lang, max(js) FILTER (WHERE part = 'char') AS dc, max(js) FILTER (WHERE part = 'word') AS dw FROM js GROUP BY ALL) GROUP BY rid),
j AS (SELECT m.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, nearest, dc, dw
      FROM m LEFT JOIN n ON n.rid = m.rid AND n_words >= {JUDGED_WORDS} AND n_chars >= {JUDGED_CHARS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > {MOST_CHAR_DISTANCE} OR dw > {MOST_WORD_DISTANCE}, false) AS kept, nearest, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance
FROM j
"""
