"""Mixing sources to target weights by a min-cost flow.

Documents with the same pattern of sources are alike to the flow, so they are aggregated first: one node a pattern,
with its documents' total size as capacity. Every source has a quota. Words flow from patterns to the quotas of their
sources; the first copy of a word is free, each further copy costs more than the one before (convex), up to
MOST_COPIES. The flow says how many words each pattern gives to each source. A pattern gives whole copies of all its
documents as long as they fit, and the rest goes to documents in the order of a seeded hash.

Defined results: a null source is a source of its own, ordered last; null and empty texts have size 0 and give nothing;
with no words at all every target is 0; ties of the seeded hash go by doc_id, then by the text's hash; nothing tells rows
apart that repeat a doc_id and text, so they are taken together; extra columns pass through `mix`, but those that have
the names of results are replaced. More than MOST_PATTERNS patterns are an error.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import BROADCAST_ROWS, NULL_ID, documents, scratch, small, staged

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
#: Hex digits of the hash that make a bucket: the last copy's documents are found in two steps, so that no window holds a
#: whole source.
BUCKET_DIGITS = 3
#: Patterns of sources whose flow the driver can solve (measured: README). They are counted first.
MOST_PATTERNS = 200_000


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+")))
    return F.coalesce(words, F.lit(0)).cast("long")


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `size` (words) and `_tx` (a hash of the text, which tells rows with the same doc_id apart)."""
    return docs.withColumns({"size": size_of(F.col(text)), "_tx": F.xxhash64(F.coalesce(text, F.lit("")))})


def weights_of(sources: list[str | None], weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Weights in turn to the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def targets_of(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = MOST_COPIES) -> dict[str | None, float]:
    """Shares of the total size by weight; a target stops at `most` times its source's size, and the excess is shared
    again among the others by weight until no target is above."""
    open_, left, out = dict(weights), float(sum(sizes.values())), {}
    while open_:
        each = left / sum(open_.values())
        full = [s for s, w in open_.items() if each * w > most * sizes[s]]
        if not full:
            return out | {s: each * w for s, w in open_.items()}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


class Network:
    """A flow from `start` through patterns and sources to `end`, on arrays: arc e leads to `to[e]` and has room for `room[e]`,
    arc e ^ 1 leads back."""

    def __init__(self, nodes: int, start: int, end: int):
        self.start, self.end = start, end
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int) -> int:
        e = len(self.to)
        self.to += (b, a)
        self.room += (room, 0)
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def levels(self) -> list[int]:
        """Steps from the start to each node over arcs with room (-1: not reached), up to those of the end."""
        level = [-1] * len(self.out)
        level[self.start], front = 0, [self.start]
        while front and level[self.end] < 0:
            reached = []
            for x in front:
                for e in self.out[x]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[x] + 1
                        reached.append(self.to[e])
            front = reached
        return level

    def fill(self) -> None:
        """Send as much as there is room for: along all shortest ways at once, as long as there are any."""
        to, room, out = self.to, self.room, self.out
        while (level := self.levels())[self.end] >= 0:
            at, path, x = [0] * len(out), [], self.start
            while True:
                if x == self.end:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    full = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[full] ^ 1]
                    del path[full:]
                elif at[x] < len(out[x]):
                    e = out[x][at[x]]
                    if room[e] and level[to[e]] == level[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        at[x] += 1
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict[str | None, int], most: int) -> dict[tuple[tuple, str | None], int]:
    """Words that each (pattern, source) pair passes, as many as the quotas take, at the least cost, where the words of each
    further copy of a pattern cost more than those of the one before.

    The costs of a copy are the same for all patterns and rise from copy to copy, and what patterns can pass together is a
    polymatroid; so copies may be let in one after the other: what a fuller flow sends of a pattern never gets less."""
    sources = {s: i for i, s in enumerate(quotas)}
    start, end = 0, 1 + len(patterns) + len(sources)
    net = Network(end + 1, start, end)
    into = [net.arc(start, 1 + i, 0) for i in range(len(patterns))]
    pairs = [(net.arc(1 + i, 1 + len(patterns) + sources[s], most * size), p, s) for i, (p, size) in enumerate(patterns) for s in p]
    for s, i in sources.items():
        net.arc(1 + len(patterns) + i, end, quotas[s])
    for _ in range(most):
        for e, (_, size) in zip(into, patterns, strict=True):
            net.room[e] += size
        net.fill()
    return {(p, s): net.room[e ^ 1] for e, p, s in pairs if net.room[e ^ 1]}


def linked_sources(patterns: list[tuple]) -> dict[object, object]:
    """One source for each source: the same for those that patterns link."""
    up: dict[object, object] = {s: s for p in patterns for s in p}

    def top(s):
        while up[s] != s:
            up[s] = s = up[up[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            up[top(s)] = top(p[0])
    return {s: top(s) for s in up}


def route(patterns: list[tuple[tuple, int]], quotas: dict[str | None, float], most: int = MOST_COPIES) -> dict[tuple[tuple, str | None], int]:
    """Words that each (pattern, source) pair passes: from (pattern, size) pairs to the sources' quotas. Sources that no
    pattern links have nothing to do with each other, so each linked group has a flow of its own."""
    group = linked_sources([p for p, _ in patterns])
    mine: dict[object, list[tuple[tuple, int]]] = defaultdict(list)
    for p, size in patterns:
        if p:
            mine[group[p[0]]].append((p, size))
    wanted: dict[object, dict[str | None, int]] = defaultdict(dict)
    for s, q in quotas.items():
        if s in group:
            wanted[group[s]][s] = round(q)
    out: dict[tuple[tuple, str | None], int] = {}
    for g, some in mine.items():
        out |= min_cost_flow(some, wanted[g], most)
    return out


def plan_of(buckets: DataFrame, kind: str, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row a pattern: its sources' size and target, and how many whole copies and further words it gives.

    Only one row for each pattern of sources comes to the driver, where the flow is solved."""
    by_pattern = staged(buckets.groupBy("_pattern").agg(F.sum("words").alias("words")), "mix-patterns")
    if (n := by_pattern.count()) > MOST_PATTERNS:
        raise ValueError(f"{n} patterns of sources, more than {MOST_PATTERNS}: name fewer sources")
    patterns = [(tuple(r["_pattern"]), r.words) for r in by_pattern.collect()]
    patterns.sort(key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    total, counted = sum(n for _, n in patterns), sum(sizes.values())
    goals = targets_of(sizes, weights_of(list(sizes), weights), most)
    goals = {s: g * total / counted if counted != total else g for s, g in goals.items()}  # overlaps count once
    passed: dict[tuple, int] = defaultdict(int)
    for (p, _), words in route(patterns, goals, most).items():
        passed[p] += words
    rows = [(list(p), sum(sizes[s] for s in p), sum(goals[s] for s in p), *(divmod(passed[p], n) if n else (0, 0))) for p, n in patterns]
    plan = buckets.sparkSession.createDataFrame(rows, f"_p {kind}, source_size long, target double, _copies long, _rest long")
    return F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan


def mix(sized: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of `with_size` with `source_size`, `target` (of all the row's sources together) and `taken`. `source`
    names a column with one source or with an array of overlapping ones."""
    plain = dict(sized.dtypes)[source]
    pattern = F.array_sort(F.array_distinct(F.col(source))) if plain.startswith("array") else F.array(F.col(source))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.withColumns({"_pattern": pattern, "_order": F.struct(order.alias("h"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"), F.col("_tx").alias("t"))})
    keyed = keyed.withColumn("_bucket", F.conv(F.substring("_order.h", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    with scratch(sized.sparkSession):
        buckets = staged(keyed.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("words")), "mix")
        plan = plan_of(buckets, plain if plain.startswith("array") else f"array<{plain}>", weights, most)
        same = F.col("_pattern").eqNullSafe(F.col("_p"))
        # The bucket in which a pattern's last words lie, and how many of them.
        below = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        at = buckets.withColumn("_below", F.coalesce(F.sum("words").over(below), F.lit(0)))  # at most 16 ** BUCKET_DIGITS rows a pattern
        cuts = at.join(plan, same).where("_below < _rest and _rest <= _below + words")
        cuts = staged(cuts.select("_p", F.col("_bucket").alias("_cut"), (F.col("_rest") - F.col("_below")).alias("_into")), "mix-cut")
        # Within that bucket, the last document taken: the one after it would miss the target by more than it helps.
        mine = keyed.join(small(cuts), same & (F.col("_bucket") == F.col("_cut"))).select("_pattern", "_order", "size", "_into")
        inside = Window.partitionBy("_pattern").orderBy("_order")
        last = mine.withColumn("_before", F.sum("size").over(inside) - F.col("size")).where("2 * _before + size < 2 * _into")
        last = staged(last.groupBy("_pattern").agg(F.max("_order").alias("_last")).withColumnRenamed("_pattern", "_lp"), "mix-last")
        ends = plan.join(cuts.withColumnRenamed("_p", "_cp"), F.col("_p").eqNullSafe(F.col("_cp")), "left").drop("_cp", "_into")
        ends = ends.join(small(last), F.col("_p").eqNullSafe(F.col("_lp")), "left").drop("_lp")
        more = F.coalesce((F.col("_bucket") < F.col("_cut")) | (F.col("_bucket") == F.col("_cut")) & (F.col("_order") <= F.col("_last")), F.lit(False)).cast("int")
        ends = small(staged(ends, "mix-ends", outlives=True))
    out = keyed.join(ends, same)  # ends has one row a pattern
    taken = F.col("size") * (F.col("_copies") + F.when(F.col("_copies") < most, more).otherwise(0))
    return out.withColumn("taken", taken).select(*sized.columns, "source_size", F.round("target", 6).alias("target"), "taken")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = staged(with_size(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 1 THEN {WEIGHTS[0]}.0 WHEN 2 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY {MOST_COPIES} * n / w, i) AS k FROM w),
f AS (  -- sources fill up in the order of the level at which they are full
  SELECT *, (SELECT sum(n) FROM w) - coalesce(sum({MOST_COPIES} * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM o),
lv AS (SELECT arg_min(rest / open_w, k) FILTER (WHERE rest / open_w <= {MOST_COPIES} * n / w) AS level FROM f),
t AS (SELECT source, n, least(w * level, {MOST_COPIES}.0 * n) AS target FROM w, lv),
p AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS words FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source, p.n AS source_size, p.target, CASE WHEN n = 0 THEN 0 ELSE words // n END AS copies,
         CASE WHEN n = 0 THEN 0 ELSE words % n END AS more,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(size * (copies + CASE WHEN 2 * before + size < 2 * more THEN 1 ELSE 0 END) AS BIGINT) AS taken, source
FROM c
"""
