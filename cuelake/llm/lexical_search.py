"""Ranked lexical search: items against all documents as a blocked sparse matrix product.

Items are the rows of one matrix (how often an item has a term), documents the columns of another (the integer impact of a
term in a document). The product is taken block by block: a task reads documents until a block is full, turns their counts
into rows of impacts by term, and merges for each item the rows of its terms, each times its multiplicity (Gustavson's row
merging). Of each block only the best documents of an item are kept; what tasks keep is reduced in two steps.

Texts are read once for each block of items: `count` keeps of a document its length and the counts of the items' terms. A
block of items holds about ITEM_ENTRIES (item, term) pairs; more items make more blocks, each with a pass of its own.

Defined results: null texts have no terms and are not counted; items without terms, and all items where no document has a
term, have no rows; items that repeat id and text are one item, those that repeat the id only are several; documents that
repeat a doc_id each have a place; equal scores go by doc_id, nulls last; extra columns are not looked at. Terms are told
apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import documents, lean, scratch, small_batches, staged
from ._words import ascii_lower, chunks, row_bounds, spans, utf8, word_hashes

#: Documents of an item that are returned.
BEST = 20
#: (item, term) pairs of a block of items, about: what a pass broadcasts.
ITEM_ENTRIES = 500_000
#: Counts (document, term) of a block of documents.
BLOCK_ENTRIES = 400_000
#: Parts in which the rows that tasks keep are reduced first.
PARTS = 32

#: Bytes of terms: ASCII letters and digits, and all of characters beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Items:
    """A block of items: sparse rows of multiplicities over the block's own terms."""

    ids: list[int | None]
    terms: np.ndarray  # hashes of the terms, ascending
    bounds: np.ndarray  # of the entries of each item
    term: np.ndarray  # of an entry
    times: np.ndarray  # of an entry


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every term of the texts."""
    data, offsets = utf8(texts)
    data = ascii_lower(data)
    starts, ends, rows = spans(data, offsets, _TERM)
    return word_hashes(data, starts, ends), rows


def item_entries(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of items (item_id, text): `item` tells apart those of one id, `term` is a hash."""
    small_batches(items.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                hashed, rows = term_hashes(c.column("text"))
                pairs, times = np.unique(np.stack([rows.astype(np.uint64), hashed]), axis=1, return_counts=True)
                at = pa.array(pairs[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [c.column("item").take(at), c.column("item_id").take(at), pa.array(pairs[1].view(np.int64)), pa.array(times)],
                    ["item", "item_id", "term", "times"],
                )

    named = items.where("text is not null").select("item_id", "text").distinct()
    keyed = named.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), "text")
    return keyed.mapInArrow(run, "item long, item_id long, term long, times long")


def gathered(entries: DataFrame) -> Items:
    """A block of entries on the driver: as many as its caller has counted."""
    rows = entries.select("item", "item_id", "term", "times").toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
    item = np.asarray(rows["item"])
    first = np.flatnonzero(np.diff(item, prepend=item[0] - 1)) if len(item) else np.zeros(0, np.int64)
    terms, term = np.unique(np.asarray(rows["term"]).view(np.uint64), return_inverse=True)
    return Items(rows["item_id"].take(first).to_pylist(), terms, np.append(first, len(item)), term, np.asarray(rows["times"]))


def count(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, term, tf) of each document that has a term: its terms with repeats, and the counts of those among `terms`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(terms)  # bounded: a block of items

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = max(1, len(known))
        for b in batches:
            for c in chunks(b):
                hashed, rows = term_hashes(c.column("text"))
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1) if len(known) else np.zeros(len(hashed), np.int64)
                hit = known[at] == hashed if len(known) else np.zeros(len(hashed), bool)
                pairs, tf = np.unique(rows[hit] * width + at[hit], return_counts=True)
                n = np.bincount(rows, minlength=c.num_rows)
                ends = pa.array(row_bounds(pairs // width, c.num_rows), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % width, tf)]
                out = pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def weights(counted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term."""
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    found = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a block's terms
    w = np.zeros(terms, np.int64)
    for r in found:
        w[r["term"]] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r["df"] + 1)))
    return total.docs, total.words, w


def impacts(n: np.ndarray, tf: np.ndarray, w: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What an occurrence of a term in an item adds, for counts tf of terms of weight w in documents of n terms; int64."""
    m = 75 + (25 * n * docs) // words
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def best_of(score: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; of equal ones those of the smallest ids, missing ids last."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], missing[at], -score[at]))[:k]]


def product(items: Items, ids: np.ndarray, missing: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, positions of its best documents, their scores) of a block: entries (doc, term, impact) times the items' rows."""
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    rows = np.searchsorted(term[order], np.arange(len(items.terms) + 1))
    for i in range(len(items.ids)):
        total = np.zeros(len(ids), np.int64)
        for e in range(items.bounds[i], items.bounds[i + 1]):
            row = slice(rows[items.term[e]], rows[items.term[e] + 1])
            total[doc[row]] += items.times[e] * impact[row]  # a row has a document once
        found = np.flatnonzero(total > 0)
        if len(found):
            best = found[best_of(total[found], ids[found], missing[found], k)]
            yield i, best, total[best]


def ranked(counted: DataFrame, items: Items, docs: int, words: int, w: np.ndarray, k: int = BEST) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item within each task."""
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast((items, w))  # bounded: a block of items

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> None:
            b = pa.Table.from_batches(held).combine_chunks()
            if not b.num_rows:
                return
            column = lambda name: b.column(name).combine_chunks()
            lists = column("term")
            per = np.asarray(lists.value_lengths())
            doc = np.repeat(np.arange(b.num_rows), per)
            term, tf = (np.asarray(x.flatten()).astype(np.int64) for x in (lists, column("tf")))
            impact = impacts(np.asarray(column("n"))[doc], tf, w[term], docs, words)
            missing = np.asarray(column("doc_id").is_null())
            ids = np.asarray(column("doc_id").fill_null(0))
            for i, best, score in product(items, ids, missing, doc, term, impact, k):
                now = (score, ids[best], missing[best])
                if i in kept:
                    both = tuple(np.concatenate(x) for x in zip(kept[i], now, strict=True))
                    top = best_of(*both, k)
                    now = tuple(x[top] for x in both)
                kept[i] = now

        for b in batches:
            held.append(b)
            size += b.num_rows + len(b.column("term").flatten())
            if size >= BLOCK_ENTRIES:
                block()
                held, size = [], 0
        if held:
            block()
        for i, (score, ids, missing) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids, pa.int64(), mask=missing), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = BEST, entries: int = ITEM_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item. items: item_id, text; docs:
    doc_id, text."""
    spark = docs.sparkSession
    with scratch(spark):
        listed = staged(item_entries(items), "search-items")
        blocks = max(1, -(-listed.count() // entries))
        out = None
        for at in range(blocks):
            block = gathered(listed.where(F.pmod(F.xxhash64(F.col("item"), F.lit(1)), F.lit(blocks)) == at))  # about `entries` rows
            counted = staged(count(docs, block.terms), "search-counts")
            n_docs, n_words, w = weights(counted, len(block.terms))
            order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
            rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")  # noqa: B023, E731
            tops = ranked(counted, block, n_docs, n_words, w, k).withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
            tops = tops.withColumn("_r", rank("item", "_part")).where(F.col("_r") <= k)
            tops = tops.withColumn("rank", rank("item")).where(F.col("rank") <= k)
            ids = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
            part = staged(tops.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "search-best", outlives=True)
            out = part if out is None else out.unionByName(part)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
it AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_words FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (SELECT it.item, p.r, CAST(sum(it.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.t) * s.n_docs) // s.n_words)))) AS BIGINT) AS score
      FROM it JOIN p ON it.term = p.term JOIN w ON it.term = w.term JOIN d ON d.r = p.r CROSS JOIN s GROUP BY it.item, p.r)
SELECT i.item_id, CAST(row_number() OVER (PARTITION BY g.item ORDER BY score DESC, d.doc_id NULLS LAST) AS INT) AS rank, d.doc_id, score
FROM g JOIN i ON g.item = i.item JOIN d ON d.r = g.r WHERE score > 0
QUALIFY rank <= {BEST}
"""
