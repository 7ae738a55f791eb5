"""Similarity join on word n-gram sets by Jaccard, exact at every size.

Documents with equal sets are one node. A node joins the tiles of its prefix: of its shingles in one global order, so
many that two similar sets must share one of them. The order puts the most common shingles last, so tiles stay small.
Tiles are cut into size bands, and nodes meet those of their own band and of the next. For a pair of nodes, the bits that
are set in one signature and not in the other bound the overlap from above; pairs that pass are decided by the exact
intersection of their sorted arrays.

Two rounds keep pairs few where a group has many members: the first tests each node of a tile with the tile's hub and
joins what it finds into components; the second tests every pair of a tile whose nodes lie in different components
still. No pair that could join two components is left out. A tile of many nodes is cut into blocks, and each pair of
blocks is a task's group of its own. Tables are written between an aggregation and a join by the same key, so that Spark
can split the join of a node, tile or component with many rows.

Defined results: a text with fewer words than a shingle has one shingle, its whole sequence; a null, empty or blank text
has none and links with nothing; a null doc_id ranks before all others, and a component led by it has a null
id; rows that repeat a doc_id and text are one document with several rows, all with the same result; shingles and
sets are told apart by 64-bit hashes; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import NULL_ID, documents, lean, most_frequent, row_key, scratch, small_batches, staged
from ._graph import components
from ._packed import packed, unpacked
from ._words import ascii_lower, chunks, gram_hashes, row_bounds, spans, utf8, word_hashes

SHINGLE = 4
PERCENT = 85
#: Bits of a signature: the power of two from twice a set's size on, between these. In tiles they are folded to TILE_BITS
#: at most.
LEAST_BITS, MOST_BITS, TILE_BITS = 64, 8192, 1024
#: Nodes whose sets are to be read, up to which their keys are broadcast to the scan (they are counted first).
BROADCAST_NODES = 200_000
#: Common shingles, at most, that go last in the order (any choice gives the same links).
COMMON = 300_000
#: Shingles that a task looks over at once for common ones, and the sets among them that make one common.
LOOK_OVER, COMMON_SETS = 1_500_000, 2
#: Least shingles of a node's tiles by which a pair is left to the first tile that both nodes are known to share.
LEADING = 8
#: Nodes of a tile that are compared with the tile at once, and nodes of a block of a tile.
BLOCK = TILE_BLOCK = 256
#: Sets that a task remembers, so as not to write their prefixes again.
REMEMBERED = 200_000


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, rows = spans(data, offsets)
    words = word_hashes(ascii_lower(data), starts, ends)
    grams, at = gram_hashes(words, k), row_bounds(rows, batch.num_rows)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def signature(shingles: np.ndarray) -> bytes:
    size = min(max(2 << max(len(shingles) - 1, 0).bit_length(), LEAST_BITS), MOST_BITS)
    bits = np.zeros(size, np.uint8)
    bits[(shingles >> np.uint64(7)) % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(signatures: list[bytes], least: int = 0) -> np.ndarray:
    """Signatures in the length of the shortest (or a shorter one): bits that fall together are joined."""
    least = least or min(map(len, signatures))
    out = np.zeros((len(signatures), least), np.uint8)
    for i, s in enumerate(signatures):
        whole = np.frombuffer(s, np.uint8)
        out[i] = whole if len(whole) == least else np.bitwise_or.reduce(whole.reshape(-1, least))
    return out


def may_be_similar(nu: np.ndarray, nv: np.ndarray, only_u: np.ndarray, only_v: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the bits in one signature only leave enough overlap."""
    most = np.minimum(nu - only_u, nv - only_v)
    return 100 * most >= percent * (nu + nv - most)


def prefix_length(n: int, percent: int) -> int:
    """Two sets with a Jaccard similarity of `percent` share at least ceil(n * percent / 100) shingles."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _sketch(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """One row a document (_id, _tx, node, n, signature), and the sorted hashes of the most common shingles."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_tx", "node", "n", "signature", "shingle"]
        held: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            found, sets = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            held.clear()
            often = found[sets >= COMMON_SETS].view(np.int64)
            none = pa.nulls(len(often), pa.int64())
            columns = [none, none, none, pa.array(sets[sets >= COMMON_SETS]), pa.nulls(len(often), pa.binary()), pa.array(often)]
            return pa.RecordBatch.from_arrays(columns, names)

        size, seen = 0, set()
        for b in batches:
            for c in chunks(b):
                nodes, sizes, bits = [], [], []
                for s in shingle_sets(c, k):
                    nodes.append(node_of(s))
                    sizes.append(len(s))
                    bits.append(signature(s))
                    if nodes[-1] not in seen:  # equal sets count once
                        seen.add(nodes[-1])
                        held.append(s)
                        size += len(s)
                columns = [c.column("_id"), c.column("_tx"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(c.num_rows, pa.int64())], names)
                if size > LOOK_OVER:
                    yield common()
                    size = 0
                    seen.clear()
        yield common()

    both = staged(docs.select(*row_key(), "text").mapInArrow(run, "_id long, _tx long, node long, n long, signature binary, shingle long"), "sketch")
    counted = both.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    last = [r.shingle for r in most_frequent(staged(counted, "common"), "n", COMMON).collect()]  # at most COMMON
    return both.where("shingle is null").drop("shingle"), np.sort(np.array(last, np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, common: np.ndarray, k: int, percent: int) -> DataFrame:
    """(shingle, node, n) for the shingles of each set's prefix; a task writes equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = shared.value, set()
        for b in batches:
            for c in chunks(b):
                out: list[tuple[np.ndarray, int, int]] = []
                for s in shingle_sets(c, k):
                    node = node_of(s)
                    if len(s) and node not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
                        is_late = late[at] == s if len(late) else np.zeros(len(s), bool)
                        ordered = np.concatenate((s[~is_late], s[is_late]))
                        out.append((ordered[: prefix_length(len(s), percent)], node, len(s)))
                if out:
                    each = [len(p) for p, _, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([p for p, _, _ in out]).view(np.int64)),
                            pa.array(np.repeat([x for _, x, _ in out], each)),
                            pa.array(np.repeat([n for _, _, n in out], each)),
                        ],
                        ["shingle", "node", "n"],
                    )

    return docs.select("text").mapInArrow(run, "shingle long, node long, n long")


def _tiles(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose shingle has two nodes or more, each (shingle, node) once. Each task streams through its sorted
    rows, so a tile may be of any size."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, not yet written
        held_with = False  # whether the row before it had the same shingle
        for b in batches:
            rows = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()
            if not rows:
                continue
            b = rows[0]
            s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
            first_with = held_with if held is not None else False
            b, s = b.filter(pa.array(fresh)), s[fresh]
            before = np.zeros(len(s), bool)
            before[1:] = s[1:] == s[:-1]
            before[0] = first_with
            after = np.zeros(len(s), bool)
            after[:-1] = s[:-1] == s[1:]
            keep = (before | after)[:-1]
            held, held_with = b.slice(len(s) - 1), bool(before[-1])
            if keep.any():
                yield b.slice(0, len(s) - 1).filter(pa.array(keep))
        if held is not None and held_with:
            yield held

    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle", "node")
    return dealt.mapInArrow(run, "shingle long, node long, n long")


def short(bits: bytes) -> bytes:
    """A signature of TILE_BITS at most."""
    return folded([bits], min(len(bits), TILE_BITS // 8)).tobytes()


def _nodes(sketch: DataFrame, tiles: DataFrame) -> DataFrame:
    """(node, n, signature, _id, _tx, short, leading) of the nodes in tiles, with one document of each and the least
    shingles of its tiles."""
    least = F.slice(F.array_sort(F.collect_set("shingle")), 1, LEADING).alias("least")  # of one set's prefix
    listed = tiles.groupBy("node").agg(least)
    one = F.min(F.struct("_id", "_tx")).alias("d")
    found = sketch.groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), one).join(listed, "node")
    found = found.select("node", "n", "signature", "d._id", "d._tx", "least")
    schema = T.StructType([*found.schema.fields[:-1], T.StructField("short", T.BinaryType()), T.StructField("leading", T.BinaryType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            padded = [np.array((x + [2**63 - 1] * LEADING)[:LEADING], np.int64).tobytes() for x in b.column("least").to_pylist()]
            more = [pa.array(map(short, b.column("signature").to_pylist()), pa.binary()), pa.array(padded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], schema.names)

    return found.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted (node, _id, _tx). Few wanted keys are broadcast, so no text is shuffled; else texts are
    packed before they are."""

    @lean
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(unpacked(b) if "_packed" in b.schema.names else b):
                yield pa.RecordBatch.from_arrays([c.column("node"), pa.array([s.tobytes() for s in shingle_sets(c, k)], pa.binary())], ["node", "shingles"])

    wanted = staged(wanted, "wanted")
    if wanted.count() <= BROADCAST_NODES:
        found = docs.select(*row_key(), "text").join(F.broadcast(wanted), ["_id", "_tx"]).select("node", "text")
    else:
        found = packed(docs).join(wanted, ["_id", "_tx"]).select("node", "_packed")
    found = found.mapInArrow(unpack, "node long, shingles binary")
    return staged(found.dropDuplicates(["node"]), "sets")  # rows that repeat doc_id and text


def _ends(what: DataFrame, end: str) -> DataFrame:
    return what.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in what.columns if c != "node"))


def _both_ends(pairs: DataFrame, what: DataFrame) -> DataFrame:
    """The written pairs (u, v) with the columns of the written `what` for both nodes. A hub's many pairs can be split."""
    return pairs.join(_ends(what, "u"), "u").join(_ends(what, "v"), "v")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that their signatures allow to be similar."""

    @lean
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for nu, nv, su, sv in zip(*(b.column(c).to_pylist() for c in ("n_u", "n_v", "signature_u", "signature_v")), strict=True):
                x, y = folded([su, sv])
                keep.append(bool(may_be_similar(nu, nv, np.bitwise_count(x & ~y).sum(dtype=int), np.bitwise_count(y & ~x).sum(dtype=int), percent)))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _both_ends(staged(pairs, "pairs"), nodes.select("node", "n", "signature")).mapInArrow(bound, "u long, v long")


TILE = ["shingle", "band", "lo", "hi"]


def _met(tiles: DataFrame, percent: int) -> DataFrame:
    """From rows (shingle, band, lo, hi, block, home, node, n, root, signature, leading), the pairs of nodes of one tile, band and
    pair of blocks that lie in different components and that their signatures allow to be similar. Guests, from the band
    below, meet only those at home. A pair that meets in an earlier tile, as both nodes' leading shingles tell, is left to
    that tile."""

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, root, home, block = (rows[c].to_numpy() for c in ("node", "n", "root", "home", "block"))
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        bits = folded(rows["signature"].to_pylist())
        leading = np.frombuffer(b"".join(rows["leading"].to_pylist()), np.int64).reshape(len(n), LEADING)
        early = np.where(leading < rows["shingle"][0].as_py(), leading, -(2**63))  # later ones equal nothing
        for at in range(0, len(n), BLOCK):
            x = slice(at, at + BLOCK)
            fit = home[None, :] & (root[x, None] != root[None, :]) & (100 * n[x, None] >= percent * n[None, :])
            fit &= np.where(home[x, None], np.arange(len(n))[x, None] < np.arange(len(n))[None, :], True)
            if lo != hi:
                fit &= block[x, None] != block[None, :]
            i, j = np.nonzero(fit)
            for k in range(0, len(i), 20_000):
                u, v = i[k : k + 20_000] + at, j[k : k + 20_000]
                only_u, only_v = (np.bitwise_count(a & ~b).sum(1, dtype=np.int64) for a, b in ((bits[u], bits[v]), (bits[v], bits[u])))
                ok = may_be_similar(n[u], n[v], only_u, only_v, percent)
                u, v = u[ok], v[ok]
                ok = ~((early[u][:, :, None] == early[v][:, None, :]) & (early[u][:, :, None] > -(2**63))).any((1, 2))
                if ok.any():
                    a, b = node[u[ok]], node[v[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the group that may go on: two blocks of a tile
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table if held is None else pa.concat_tables([held, table])
            change = np.zeros(max(table.num_rows - 1, 0), bool)
            for c in TILE:
                value = table[c].to_numpy()
                change |= value[1:] != value[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield from pairs_of(table.slice(x, y - x))
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from pairs_of(held)

    dealt = tiles.repartition(*TILE).sortWithinPartitions(*TILE, "n", "node")
    return dealt.mapInArrow(run, "u long, v long")


def _links(likely: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar, by exact intersection."""

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("shingles_u").to_pylist(), b.column("shingles_v").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    likely = staged(likely.distinct(), "likely")
    if not likely.head(1):
        return likely
    wanted = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
    sets = _sets(docs, nodes.select("node", "_id", "_tx").join(wanted, "node"), k)
    return staged(_both_ends(likely, sets).mapInArrow(decide, "u long, v long"), "links")


def similar(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, and `leads` (the document with the component's
    smallest doc_id)."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _similar(docs.select("doc_id", "text"), k, percent)


def _similar(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sketch, common = _sketch(docs, k)
    tiles = staged(_tiles(_prefixes(docs, common, k, percent)), "tiles")
    nodes = staged(_nodes(sketch, tiles), "nodes")

    # The first round: in each tile, each node with the hub, the node of whose prefix the largest share lies in tiles (an
    # original has more in common with its copies than they have with each other).
    share = tiles.groupBy("node", "n").agg(F.count("*").alias("met")).select("node", (F.col("met") / F.col("n")).alias("share"))
    hub = staged(tiles.join(share, "node").groupBy("shingle").agg(F.max(F.struct("share", "node", "n")).alias("h")), "hubs")
    starred = tiles.join(hub, "shingle").select(F.col("h.node").alias("u"), F.col("h.n").alias("nu"), F.col("node").alias("v"), F.col("n").alias("nv"))
    fit = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    pairs = starred.where((F.col("u") != F.col("v")) & fit).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = _links(_likely(pairs, nodes, percent), nodes, docs, k, percent)
    roots = components(first)

    # The second round: in each tile, nodes of fitting sizes that lie in different components.
    placed = tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    banded = placed.select("*", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("b"))
    banded = banded.select("shingle", "node", "n", "root", "b.band", "b.home")
    several = (F.min("root") != F.max("root")) & F.bool_or("home")
    open_tiles = staged(banded.groupBy("shingle", "band").agg(several.alias("open"), F.count("*").alias("members")).where("open").drop("open"), "open")
    rows = banded.join(open_tiles, ["shingle", "band"])
    blocks = F.ceil(F.col("members") / TILE_BLOCK).cast("int")
    rows = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", "shingle"), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other", "members")
    rows = rows.join(nodes.select("node", F.col("short").alias("signature"), "leading"), "node")
    second = _links(_likely(_met(rows, percent).distinct(), nodes, percent), nodes, docs, k, percent)
    if second.head(1):
        roots = components(first.unionAll(second))

    # Leads are found by nodes, then handed to their documents.
    own = sketch.groupBy("node").agg(F.min(F.struct("_id", "_tx")).alias("own"))
    counted = staged(own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "counted")
    leader = staged(counted.groupBy("root").agg(F.min("own").alias("lead")), "leaders")
    led = staged(counted.select("node", "root").join(leader, "root").select("node", "lead"), "led")
    out = sketch.select("_id", "_tx", "n", "node").join(led, "node", "left")
    own_key = F.struct("_id", "_tx")
    lead = F.when(F.col("n") > 0, F.coalesce("lead", own_key)).otherwise(own_key)
    out = staged(out.select("_id", "_tx", "n", lead.alias("lead")), "placed", outlives=True)
    value = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        value(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), value(F.col("lead._id")).alias("component_id"),
        (F.col("lead") == own_key).alias("leads"), "_tx",
    )


def _can_be_ordered(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _can_be_ordered(t.elementType)
    if isinstance(t, T.StructType):
        return all(_can_be_ordered(f.dataType) for f in t.fields)
    return not isinstance(t, T.MapType | T.VariantType)


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that another of their component leads: one row of each component. Of rows that repeat a
    doc_id and text, the one with the smallest other columns (those that can be ordered) stays."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    leads = similar(docs, k, percent).where("leads").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "_tx").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in rest), "_packed")
    order = F.struct(*(F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and _can_be_ordered(f.dataType)))
    kept = packed(docs, *rest).join(leads, ["_id", "_tx"]).groupBy("_id", "_tx").agg(F.min_by(row, order).alias("_row")).select("_row.*")
    schema = T.StructType([*(docs.schema[c] for c in rest), docs.schema["text"]])

    @lean
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield unpacked(b)

    return kept.select(*(f"`{c}`" for c in rest), "_packed").mapInArrow(unpack, schema).select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - {SHINGLE - 1}, least(len(w), 1))), lambda p: array_to_string(w[p + 1:p + {SHINGLE}], ' '))) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, u AS v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT u, min(v) AS m FROM r GROUP BY u) q ON q.u = s.doc_id
"""
