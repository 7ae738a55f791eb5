"""Many terms looked up in texts at once: one pass over a text, however many terms there are.

The terms of a pass are compiled into two Aho-Corasick automata: terms that match whole words in any case over folded texts,
others over the texts as they are. Bounds of words are looked at where a term is hit. Terms are counted before they are handed
to the tasks; more of them than one automaton holds make several passes, each with its share."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of one automaton, and their characters altogether; about 60 bytes of a worker's memory a character.
TERMS, CHARS = 100_000, 1_000_000
#: Hits that are handed on at once.
ROWS = 5_000

_LATIN = re.compile("[A-Za-z]")


@lru_cache(maxsize=4096)
def _folded(c: str) -> str:
    up = c.upper() if len(c.upper()) == 1 else c
    return up.lower()[0] if c == "İ" or len(up.lower()) == 1 else up


def fold(text: str) -> str:
    """Characters that differ in case only fold alike; each stays one character."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


def part_of_word(c: str) -> bool:
    return c == "_" or c <= "\uffff" and unicodedata.category(c)[0] in "LN"


class Lookup:
    """Terms by where they stand in a text. words: whether terms with an ASCII letter match whole words in any case."""

    def __init__(self, terms: Iterable[str], words: bool = True):
        self.exact, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        alike: dict[str, list[str]] = {}
        for term in terms:
            if words and _LATIN.search(term):
                alike.setdefault(fold(term), []).append(term)
            else:
                self.exact.add_word(term, term)
        for form, same in alike.items():
            self.folded.add_word(form, (len(form), same))
        for automaton in (self.exact, self.folded):
            if len(automaton):
                automaton.make_automaton()

    def __call__(self, text: str) -> list[str]:
        """The terms that a text holds, each once."""
        found: dict[str, None] = {}
        if len(self.exact):
            found.update((term, None) for _, term in self.exact.iter(text))
        if len(self.folded):
            low = fold(text)
            met: set[str] = set()
            for end, (size, same) in self.folded.iter(low):
                before, after = end - size, end + 1
                if same[0] in met or before >= 0 and part_of_word(text[before]) or after < len(text) and part_of_word(text[after]):
                    continue
                met.add(same[0])
                found.update(dict.fromkeys(same))
        return list(found)


_last: dict[str, Lookup] = {}


def _lookup(key: str, terms: Broadcast, words: bool) -> Lookup:
    """The lookup of a pass: a worker that runs several of its tasks builds it once."""
    if key not in _last:
        _last.clear()
        _last[key] = Lookup(terms.value, words)
    return _last[key]


def shares(terms: DataFrame, term: str) -> Iterator[list[str]]:
    """The different terms that are not null, in lists that one automaton holds. Where one list is enough the terms are computed
    once."""
    named = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct()
    first = [r["term"] for r in named.limit(TERMS + 1).collect()]
    if len(first) <= TERMS and sum(map(len, first)) <= CHARS:
        yield first
        return
    size = named.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("chars")).first()
    n = 2 * max(-(-size["n"] // TERMS), -(-size["chars"] // CHARS))  # shares by hash are not quite even
    for i in range(n):
        yield [r["term"] for r in named.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()]


def found_terms(rows: DataFrame, text: str, terms: DataFrame, term: str, words: bool = True, usable: Callable[[str], bool] = bool) -> DataFrame:
    """rows once for each different term that their text holds, with that term as `_term` in place of the text, which is not
    copied for each hit. Only terms and texts that are usable are looked at."""
    spark = rows.sparkSession
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != text), T.StructField("_term", T.StringType())])

    def within(share: list[str]) -> DataFrame:
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast([t for t in share if usable(t)])  # bounded: see shares

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = _lookup(key, shared, words)
            for b in batches:
                rest = b.drop_columns([text])
                at, hit = [], []
                for i, value in enumerate(b.column(text)):
                    if (value := value.as_py()) and usable(value):
                        got = lookup(value)
                        at += [i] * len(got)
                        hit += got
                    if len(at) >= ROWS or i == b.num_rows - 1:
                        for k in range(0, len(at), ROWS):
                            part = rest.take(pa.array(at[k : k + ROWS]))
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hit[k : k + ROWS], pa.string())], schema.names)
                        at, hit = [], []

        return rows.mapInArrow(run, schema)

    out = None
    for share in shares(terms, term):
        part = within(share)
        out = part if out is None else out.unionByName(part)
    return out
