"""Substring dedup by relative Lempel-Ziv parsing against an index of all blocks.

Every text is cut into reference blocks by its content: each window of WINDOW words elects its smallest ANCHOR-word hash,
and the windows that elect one anchor make a block. The index deals all blocks by anchor. A block that stands earlier
somewhere is copied whole; where blocks share an anchor but differ, a copy begins or ends inside them, and their
windows are looked up one by one. So every window that stands earlier is found, also those over the ends of copies.

A document is then parsed greedily from its copied runs: a factor goes on as long as the next window is copied from the next
place of one earlier text. Before that, each run, with which a factor begins, goes on or ends, is checked: a second hash of
the words at both of its boundaries and between them, computed from the text itself, must be the one that the index has
of the earlier place. The words under the factors are the duplicate spans.

`spans` gives the parse as factors, `remove` the texts without their duplicate spans.

Tasks first settle what repeats among their own rows, and remember what repeats often, so a block or window that many
rows share is dealt a few times a task; what is dealt is settled as a stream, whatever the number of rows of a key.

Defined results: texts of fewer words than a window lose nothing; a null text has no words; of equal windows the one with
the smallest doc_id (null first), then hash of the text, then start stays; rows that repeat a doc_id and text are one
document with several rows, all with the same result; windows are told apart by two 64-bit hashes; extra columns pass
through `remove`, but n_words and n_removed are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, row_key, scratch, small_batches, staged
from ._packed import packed, unpacked
from ._words import chunks, gram_hashes, mix, row_bounds, span_hashes, utf8, word_hashes
from ._words import spans as word_spans

WINDOW = 20
ANCHOR = 5
#: Words that a task holds before it settles its repeats.
SEGMENT = 250_000
#: Times that a block or window stands in a segment to be remembered for the next one.
OFTEN = 4

#: Kinds of rows: a block by anchor, a window, a copy that is settled, and a block whose windows are to be looked up.
BLOCK, LOOKUP, COPY, CHECK = 0, 1, 2, 3
# `seal` is the second hash of a block's or window's words; that of a COPY row is the earlier place's.
ROWS = "kind int, key long, sub long, seal long, _id long, _tx long, pos int, len int, ref_id long, ref_tx long, ref_pos int"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 5, *[pa.int32()] * 2, *[pa.int64()] * 2, pa.int32()]
_SEALED = np.uint64(0x5851F42D4C957F2D)


def _rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    out = []
    for name, t in zip(NAMES, _TYPES, strict=True):
        value = np.full(n, kind) if name == "kind" else columns.get(name)
        if value is None:
            out.append(pa.nulls(n, t))
        else:
            value = value.view(np.int64) if value.dtype == np.uint64 else value
            out.append(pa.array(value).cast(t))
    return pa.RecordBatch.from_arrays(out, NAMES)


def sealed(words: np.ndarray) -> np.ndarray:
    """Other hashes of words, from which seals are made."""
    return mix(words ^ _SEALED)


class Often:
    """The first places of what stood often in the segment before: at most SEGMENT / OFTEN entries."""

    def __init__(self):
        self.places = np.zeros((0, 5), np.int64)  # hash, seal, id, tx, start; sorted by hash

    def known(self, new: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Index among the places of each row of new (hash, seal, id, tx, start) that stands no earlier than it, or -1.
        The rows that stand often become the places."""
        at = np.minimum(np.searchsorted(self.places[:, 0], new[:, 0]), max(len(self.places) - 1, 0))
        old = self.places[at] if len(self.places) else np.full_like(new, -1)
        same = (old[:, :2] == new[:, :2]).all(1) & bool(len(self.places))
        (i, t, p), (j, u, q) = old.T[2:], new.T[2:]
        later = same & ((i < j) | (i == j) & ((t < u) | (t == u) & (p <= q)))
        often = times >= OFTEN
        kept = np.where(later[:, None], old, new)[often]
        found = np.where(later, at, -1)
        self.before, self.places = self.places, kept[np.argsort(kept[:, 0], kind="stable")]
        return found


class Segment:
    """Windows and blocks of some texts, gathered and then settled among themselves."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0
        self.blocks, self.windows = Often(), Often()

    def add(self, ids: np.ndarray, txs: np.ndarray, doc: np.ndarray, start: np.ndarray, *more: np.ndarray):
        """Of each window: its row's number, start, hash and seal, its anchor's hash and place, and its block's hash and seal."""
        self.parts.append((ids[doc], txs[doc], start, *more))
        self.words += len(start)

    def settle(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        ids, txs, start, window, seal, anchor, at, block, block_seal = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts, self.words = [], 0
        # Blocks: runs of windows of one text with one anchor.
        head = np.ones(len(ids), bool)
        head[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]) | (txs[1:] != txs[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(ids)))
        order = np.lexsort((start[first], txs[first], ids[first], block_seal[first], block[first], anchor[first]))
        first, size = first[order], size[order]
        a, b, c = anchor[first], block[first], block_seal[first]
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_b = new_a.copy()
        new_b[1:] |= (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        lead = np.maximum.accumulate(np.where(new_b, np.arange(len(b)), 0))  # the first equal block
        places = Places(ids, txs, start)
        yield from places.copies(first[~new_b], first[lead[~new_b]], size[~new_b], block_seal)
        group = np.cumsum(new_a) - 1
        several = np.bincount(group[new_b]) > 1  # by anchor
        one = new_b & ~several[group]
        single, length = first[one], size[one]
        found = self.blocks.known(places.rows(single, block, block_seal), np.bincount(lead, minlength=len(b))[one])
        yield from places.remembered(single, length, found, self.blocks)
        single, length = single[found < 0], length[found < 0]
        yield _rows(BLOCK, len(single), key=anchor[single], sub=block[single], seal=block_seal[single], _id=ids[single], _tx=txs[single], pos=start[single], len=length)
        marks = first[new_a & several[group]]  # anchors of several blocks, told to the others by two blocks at once
        for k in (0, 1):
            yield _rows(BLOCK, len(marks), key=anchor[marks], sub=np.full(len(marks), k))
        inner = new_b & several[group]
        chosen = np.repeat(first[inner], size[inner]) + _within(size[inner])
        yield from settle_windows(Places(ids[chosen], txs[chosen], start[chosen]), window[chosen], seal[chosen], self.windows)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Places:
    """Where windows start: ids and text hashes of documents, and word numbers."""

    def __init__(self, ids: np.ndarray, txs: np.ndarray, start: np.ndarray):
        self.ids, self.txs, self.start = ids, txs, start

    def rows(self, at: np.ndarray, hashes: np.ndarray, seals: np.ndarray) -> np.ndarray:
        return np.stack([hashes[at].view(np.int64), seals[at].view(np.int64), self.ids[at], self.txs[at], self.start[at]], 1).reshape(-1, 5)

    def copies(self, copy: np.ndarray, of: np.ndarray, size: np.ndarray, seal: np.ndarray) -> Iterator[pa.RecordBatch]:
        """COPY rows: each of `copy` stands at the place `of` too."""
        yield from self.copies_of(copy, size, seal[of], self.ids[of], self.txs[of], self.start[of])

    def remembered(self, copy: np.ndarray, size: np.ndarray, found: np.ndarray, often: Often) -> Iterator[pa.RecordBatch]:
        of = often.before[found[found >= 0]]
        yield from self.copies_of(copy[found >= 0], size[found >= 0], *of.T[1:])

    def copies_of(self, copy, size, seal, ref_id, ref_tx, ref_pos) -> Iterator[pa.RecordBatch]:
        ids, txs, start = self.ids[copy], self.txs[copy], self.start[copy]
        other = (ids != ref_id) | (txs != ref_tx) | (start != ref_pos)  # else the same row again
        if other.any():
            ids, txs, start = ids[other], txs[other], start[other]
            spread = mix(ids.view(np.uint64) ^ txs.view(np.uint64)) + start.astype(np.uint64)  # deals them evenly
            yield _rows(COPY, len(ids), key=spread, seal=seal[other], _id=ids, _tx=txs, pos=start, len=size[other], ref_id=ref_id[other], ref_tx=ref_tx[other], ref_pos=ref_pos[other])


def settle_windows(places: Places, window: np.ndarray, seal: np.ndarray, often: Often) -> Iterator[pa.RecordBatch]:
    """The first of equal windows as a LOOKUP row, the others as copies of it."""
    order = np.lexsort((places.start, places.txs, places.ids, seal, window))
    w, c = window[order], seal[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    yield from places.copies(order[~new], order[lead[~new]], np.ones((~new).sum(), np.int64), seal)
    one = order[new]
    found = often.known(places.rows(one, window, seal), np.bincount(lead, minlength=len(w))[new])
    yield from places.remembered(one, np.ones(len(one), np.int64), found, often)
    one = one[found < 0]
    yield _rows(LOOKUP, len(one), key=window[one], sub=seal[one], seal=seal[one], _id=places.ids[one], _tx=places.txs[one], pos=places.start[one])


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the batch's texts and the bounds of each row among them."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, rows = word_spans(data, offsets)
    return word_hashes(data, starts, ends), row_bounds(rows, batch.num_rows)


def _blocks(docs: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, wide = Segment(), WINDOW - ANCHOR + 1
        for b in batches:
            for c in chunks(b):
                words, bounds = _hashed(c)
                if len(words) < WINDOW:
                    continue
                doc = np.searchsorted(bounds, np.arange(len(words)), "right") - 1
                s = np.arange(len(words) - WINDOW + 1)
                s = s[doc[s] == doc[s + WINDOW - 1]]
                if not len(s):
                    continue
                grams = gram_hashes(words, ANCHOR)
                at = np.lib.stride_tricks.sliding_window_view(grams, wide)[s].argmin(1) + s
                head = np.ones(len(s), bool)
                head[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
                number = np.cumsum(head) - 1
                first = s[head]
                last = s[np.append(np.flatnonzero(head)[1:], len(s)) - 1]
                other, ids, txs = sealed(words), c.column("_id").to_numpy(), c.column("_tx").to_numpy()
                by_window = [span_hashes(x, s, s + WINDOW) for x in (words, other)]
                by_block = [span_hashes(x, first, last + WINDOW)[number] for x in (words, other)]
                segment.add(ids, txs, doc[s], s - bounds[doc[s]], *by_window, grams[at], at - bounds[doc[s]], *by_block)
                if segment.words >= SEGMENT:
                    yield from segment.settle()
        yield from segment.settle()

    return docs.select(*row_key(), "text").mapInArrow(run, ROWS)


def _resolve(dealt: DataFrame) -> DataFrame:
    """From BLOCK and LOOKUP rows that are dealt by key: COPY rows for blocks and windows that stand earlier, CHECK rows for
    the first of each block that shares its anchor with another, and LOOKUP rows for the first of each window. COPY rows
    pass. The sorted rows are a stream: of a key that goes on in the next batch, only the first row of its last equal
    block or window is held."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        known = False  # whether the held row's key has several blocks, as was told already
        for b in batches:
            kinds = b.column(0).to_numpy()
            if (kinds == COPY).any():
                yield b.filter(pa.array(kinds == COPY))
                b = b.filter(pa.array(kinds != COPY))
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            old = held is not None
            kind, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            sub, seal, ids, txs, pos = (b.column(c).fill_null(0).to_numpy() for c in ("sub", "seal", "_id", "_tx", "pos"))
            real, size = ~np.asarray(b.column("_id").is_null()), b.column("len").fill_null(1).to_numpy()
            new_key = np.ones(len(key), bool)
            new_key[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
            new_sub = new_key.copy()
            new_sub[1:] |= (sub[1:] != sub[:-1]) | (seal[1:] != seal[:-1])
            group = np.cumsum(new_key) - 1
            several = np.bincount(group[new_sub]) > 1
            several[0] |= known
            lead = np.maximum.accumulate(np.where(new_sub, np.arange(len(key)), 0))
            again = real & ~new_sub & real[lead]
            yield from Places(ids, txs, pos).copies(np.flatnonzero(again), lead[again], size[again], seal)
            check = real & ~again & several[group] & (kind == BLOCK)
            check[0] &= not (old and known)
            if check.any():
                yield _rows(CHECK, int(check.sum()), _id=ids[check], _tx=txs[check], pos=pos[check], len=size[check])
            one = new_sub & (kind == LOOKUP)
            one[0] &= not old
            if one.any():
                yield _rows(LOOKUP, int(one.sum()), key=key[one], sub=sub[one], seal=seal[one], _id=ids[one], _tx=txs[one], pos=pos[one])
            held, known = b.slice(int(lead[-1]), 1), bool(several[-1])

    sort = ["kind", "key", "sub", "seal", "_id", "_tx", "pos"]
    return dealt.sortWithinPartitions(*sort).mapInArrow(run, ROWS)


def _looked_up(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """LOOKUP and COPY rows for the windows of the blocks to be checked."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held, often = 0, Often()

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                ids, txs, start, window, seal = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield from settle_windows(Places(ids, txs, start), window, seal, often)
                parts.clear()

        for b in batches:
            for c in chunks(unpacked(b)):
                words, bounds = _hashed(c)
                other, ids, txs = sealed(words), c.column("_id").to_numpy(), c.column("_tx").to_numpy()
                for i, blocks in enumerate(c.column("blocks").to_pylist()):
                    size = np.array([x["len"] for x in blocks])
                    s = np.repeat([x["pos"] for x in blocks], size) + _within(size)
                    s = np.unique(s)  # repeated rows
                    by_window = [span_hashes(x[bounds[i] : bounds[i + 1]], s, s + WINDOW) for x in (words, other)]
                    parts.append((np.full(len(s), ids[i]), np.full(len(s), txs[i]), s, *by_window))
                    held += len(s)
                if held >= SEGMENT:
                    held = 0
                    yield from flush()
        yield from flush()

    by_doc = checks.groupBy("_id", "_tx").agg(F.collect_list(F.struct("pos", "len")).alias("blocks"))  # a document's own
    return packed(docs).join(by_doc, ["_id", "_tx"]).mapInArrow(run, ROWS)


RUN = ["pos", "len", "seal", "ref_id", "ref_tx", "ref_pos"]


def copies(docs: DataFrame) -> DataFrame:
    """(_id, _tx, runs): runs of windows of a document, by start, that stand earlier too, and where. One document's own."""
    with scratch(docs.sparkSession):
        found = staged(_resolve(_blocks(docs).repartition("kind", "key")), "blocks")
        checked = staged(_looked_up(docs, found.where(F.col("kind") == CHECK)), "windows")
        lookups = found.where(F.col("kind") == LOOKUP).unionByName(checked.where(F.col("kind") == LOOKUP))
        late = _resolve(lookups.repartition("kind", "key"))
        parts = [x.where(F.col("kind") == COPY).select("_id", "_tx", *RUN) for x in (found, checked, late)]
        runs = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return staged(runs.groupBy("_id", "_tx").agg(F.collect_list(F.struct(*RUN)).alias("runs")), "copies", outlives=True)


def factors_of(runs: list[tuple[int, int, tuple[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one document's copied windows, from runs (start, windows, earlier document, start there):
    (start, words, earlier document's id, start there) for each factor, in order. A factor goes on as long as the next
    window is copied from the next place."""
    out: list[list] = []
    for a, n, ref, at in sorted(runs, key=lambda r: (r[0], -r[1])):
        if out and a <= out[-1][1] and out[-1][2] == (ref, at - a):
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n, (ref, at - a)])
    return [(a, b - a + WINDOW - 1, ref[0], a + shift) for a, b, (ref, shift) in out]


def parsed(batch: pa.RecordBatch) -> list[list[tuple[int, int, int, int]]]:
    """The factors of each row, from the runs whose seals the row's own words make."""
    words, bounds = _hashed(batch)
    runs = batch.column("_runs")
    each, flat = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(), runs.flatten()
    pos, size, seal, ref_id, ref_tx, ref_pos = (flat.field(name).to_numpy() for name in RUN)
    start = bounds[np.repeat(np.arange(batch.num_rows), each)] + pos
    ok = span_hashes(sealed(words), start, start + size + WINDOW - 1).view(np.int64) == seal
    at = np.cumsum(each) - each
    out = []
    for i, n in zip(at.tolist(), each.tolist(), strict=True):
        if not n:
            out.append([])
            continue
        x = slice(i, i + n)
        rows = zip(pos[x].tolist(), size[x].tolist(), zip(ref_id[x].tolist(), ref_tx[x].tolist(), strict=True), ref_pos[x].tolist(), strict=True)
        out.append(factors_of([r for r, sure in zip(rows, ok[x].tolist(), strict=True) if sure]))
    return out


def _per_document(docs: DataFrame, keep: list[str], added: str, fn) -> DataFrame:
    """The columns to keep, and those that fn(text, factors) makes of each row."""
    small_batches(docs.sparkSession)
    joined = packed(docs, *keep).join(copies(docs).withColumnRenamed("runs", "_runs"), ["_id", "_tx"], "left").drop("_id", "_tx")
    new = T.StructType.fromDDL(added)
    schema = T.StructType([f for f in joined.schema.fields if f.name in keep] + new.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for c in chunks(unpacked(b)):
                made = [fn(t, f) for t, f in zip(c.column("text").to_pylist(), parsed(c), strict=True)]
                columns = [c.column(c.schema.get_field_index(n)) for n in keep]
                columns += [pa.array([m[f.name] for m in made], arrow.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(run, schema)


def cut_out(n_words: int, factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The words under factors, as disjoint intervals in order."""
    out: list[list[int]] = []
    for a, n, _, _ in factors:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, min(b, n_words)) for a, b in out]


def kept_words(text: str, factors: list[tuple[int, int, int, int]]) -> tuple[list[bytes], list[bytes]]:
    """All words of a text, and those under no factor."""
    words = text.encode("utf-8", "surrogatepass").split()
    kept, at = [], 0
    for a, b in cut_out(len(words), factors):
        kept += words[at:a]
        at = b
    return words, kept + words[at:] if factors else words


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, factors: list[tuple[int, int, int, int]]) -> tuple[str, int, int]:
    """The text without the words under its factors, all other lines and spaces being kept; its words and those cut out. Of
    the space around a cut, what stands before it stays."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at, gone = [], 0, 0
    for a, b in cut_out(len(places), factors):
        out.append(raw[at : places[a][0]])
        at = places[b][0] if b < len(places) else places[-1][1]
        gone += b - a
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), len(places), gone


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and `factors`: the duplicate spans of each row as (start, words, ref_id, ref_pos), by words from 0."""

    def one(text: str, factors: list) -> dict:
        names = ("start", "words", "ref_id", "ref_pos")
        return {"factors": [dict(zip(names, f, strict=True)) for f in factors]}

    return _per_document(docs, ["doc_id"], "factors array<struct<start:int,words:int,ref_id:long,ref_pos:int>>", one)


def remove(docs: DataFrame) -> DataFrame:
    """docs with the duplicate spans cut out of `text`, n_words and n_removed. A text without duplicates is unchanged, a null
    one becomes empty."""

    def one(text: str, factors: list) -> dict:
        rest, n, gone = without(text, factors)
        return {"text": rest, "n_words": n, "n_removed": gone}

    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    return _per_document(docs, rest, "text string, n_words long, n_removed long", one)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(text: str, factors: list) -> dict:
        words, kept = kept_words(text, factors)
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _per_document(docs, ["doc_id"], "n_words long, n_removed long, kept_sha256 string", one)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p + 1:p + {WINDOW}], ' ') AS k FROM d, unnest(range(len(w) - {WINDOW} + 1)) AS r(p)),
c AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + {WINDOW})))) AS gone
      FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM x) WHERE n > 1 GROUP BY doc_id),
g AS (SELECT c.doc_id, i FROM c, unnest(gone) AS u(i)),
k AS (SELECT d.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS rest
      FROM (SELECT doc_id, p AS i, w[p + 1] AS word FROM d, unnest(range(len(w))) AS r(p)) d ANTI JOIN g USING (doc_id, i) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
