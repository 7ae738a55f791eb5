"""Scenes: sessions of cues, their context, their risk and the choice of those to review."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake import config as C
from cuelake.functions import bins
from cuelake.functions.fold import fold


class Chunk:
    """A stretch of a medium's cues, and those behind it that its last scene may reach: starts and ends from row `base` on. A scene
    begins at a row, with or without that row being tested against the limits (it is not after a pause); such a beginning is
    coded as twice the row, plus one after a pause. All that follows from a beginning is in the rows after it."""

    def __init__(self, base: int, limit: int, max_cues: int, max_ms: int):
        self.base, self.limit, self.max_cues, self.max_ms = base, limit, max_cues, max_ms
        self.starts: list[int] = []
        self.ends: list[int] = []

    def scene(self, code: int) -> tuple[int, int | None]:
        """The last row of the scene that begins there, and where the next one begins (None: the cues end)."""
        first, paused = code >> 1, code & 1
        starts, ends, at = self.starts, self.ends, first - self.base
        began = starts[at]
        for i in range(at + paused, len(starts)):
            count = i - at
            if count >= C.PAUSE_CUES and starts[i] - ends[i - 1] >= C.PAUSE_MS:
                return self.base + i - 1, 2 * (self.base + i) + 1
            if count + 1 >= self.max_cues or ends[i] - began >= self.max_ms:
                return self.base + i, 2 * (self.base + i + 1) if i + 1 < len(starts) else None
        return self.base + len(starts) - 1, None

    def leave(self, entries: list[int]) -> list[tuple[int, int | None, int]]:
        """(entry, beginning behind the chunk, scenes that begin within) for each entry; ways that meet are walked once."""
        known: dict[int, tuple[int | None, int]] = {}
        for entry in entries:
            way, code = [], entry
            while code is not None and code >> 1 < self.limit and code not in known:
                way.append(code)
                code = self.scene(code)[1]
            out, n = known.get(code, (code, 0))
            for step in reversed(way):
                n += 1
                known[step] = (out, n)
        return [(e, *known[e]) for e in entries]


def build(cues: DataFrame, max_cues: int = 35, max_seconds: int = 150, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(media_id, scene_idx, start_pos, end_pos), positions being numbers in the order. A scene ends before a pause of four seconds
    once it has twelve cues, or with the cue that fills it, so each end depends on the one before.

    Yet many tasks share a medium: a chunk of its cues is entered by one of few beginnings, as a scene has max_cues at most. Each
    chunk tells for all of them where it is left; a table with one row a chunk tells then which one holds; and each chunk makes
    its scenes from that."""
    rows = bins.numbered(cues.select("media_id", "start_ms", "end_ms", *(c for c in order if c not in ("start_ms", "end_ms"))), "media_id", order, "_n", None if order[0].endswith("_ms") else bins.BIN_ROWS)
    rows = rows.select("media_id", (F.col("_n") - 1).alias("_row"), "start_ms", "end_ms")
    width = max(bins.BIN_ROWS, 2 * max_cues)
    dealt = bins.with_halo(rows, "_row", 0, max_cues, width).where("_bin >= 0").drop("_own").repartition("media_id", "_bin")
    media = cues.schema["media_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
        every = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("media_id", "_bin", *more, "_row", "start_ms", "end_ms")), strict=True))
        for key, mine in groupby(every, key=lambda row: row[: 2 + len(more)]):
            chunk = Chunk(key[1] * width, (key[1] + 1) * width, max_cues, max_seconds * 1000)
            for *_, start, end in mine:
                chunk.starts.append(start)
                chunk.ends.append(end)
            yield *key, chunk

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, chunk in chunks(batches):
            codes = range(2 * chunk.base, 2 * min(chunk.base + max_cues, chunk.base + len(chunk.starts)))
            ways = chunk.leave([0] if b == 0 else [*codes])
            yield pa.RecordBatch.from_pydict({"media_id": [m], "_bin": [b], "ways": [[{"entry": e, "exit": x, "n": n} for e, x, n in ways]]}, schema=_schema(chunk_ddl))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, _, entry, scene, chunk in chunks(batches, "_entry", "_scene"):
            out: list[tuple] = []
            while entry is not None and entry >> 1 < chunk.limit:
                last, after = chunk.scene(entry)
                out.append((m, scene, entry >> 1, last))
                entry, scene = after, scene + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _schema(scene_ddl), strict=True)], schema=_schema(scene_ddl))

    def entered(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (entry, scene), (m, b, ways) = state, row
        if entry is None:
            return state, []
        after, n = next((w["exit"], w["n"]) for w in ways if w["entry"] == entry)
        return (after, scene + n), [(m, b, entry, scene)]

    chunk_ddl = f"media_id {media}, _bin long, ways array<struct<entry: long, exit: long, n: int>>"
    scene_ddl = f"media_id {media}, scene_idx int, start_pos int, end_pos int"
    chunk_type, scene_type = T.StructType.fromDDL(chunk_ddl), T.StructType.fromDDL(scene_ddl)
    types = {chunk_ddl: chunk_type, scene_ddl: scene_type}

    def _schema(ddl: str) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(types[ddl])

    ways = dealt.sortWithinPartitions("media_id", "_bin", "_row").mapInArrow(left, chunk_type)
    entries = fold(ways, "media_id", ["_bin"], lambda: (0, 0), entered, None, f"media_id {media}, _bin long, _entry long, _scene int")
    entries = entries.withColumnsRenamed({"media_id": "_m", "_bin": "_b"})
    met = dealt.join(entries, F.col("media_id").eqNullSafe(F.col("_m")) & (F.col("_bin") == F.col("_b"))).drop("_m", "_b")
    return met.repartition("media_id", "_bin").sortWithinPartitions("media_id", "_bin", "_row").mapInArrow(made, scene_type)


def assign(cues: DataFrame, scenes: DataFrame) -> DataFrame:
    """cues with their scene_idx, by an equi-join on the positions that a scene covers."""
    each = scenes.select("media_id", "scene_idx", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    return cues.join(each, ["media_id", "pos"])


def context(cues: DataFrame, before: int, after: int, column: str = "text") -> DataFrame:
    """cues with `ctx_before` and `ctx_after`, the texts of the neighbouring cues of the medium, whose positions have no gaps."""
    w = Window.partitionBy("media_id", "_bin").orderBy("pos")
    told = bins.with_halo(cues, "pos", before, after).withColumns({
        "ctx_before": F.collect_list(column).over(w.rowsBetween(-before, -1)), "ctx_after": F.collect_list(column).over(w.rowsBetween(1, after)),
    })
    return told.where("_own").drop("_bin", "_own")


def frames(cues: DataFrame, scenes: DataFrame, n: int) -> DataFrame:
    """The cues around each scene: (media_id, scene_idx, part, pos), part being `before` (n cues), `target` or `after` (n cues).
    Positions are joined, so no medium's cues are gathered."""
    part = lambda name, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda p: F.struct(F.lit(name).alias("part"), p.cast("int").alias("pos"))))
    start, end = F.col("start_pos"), F.col("end_pos")
    parts = [part("before", F.greatest(start - n, F.lit(0)), start - 1), part("target", start, end), part("after", end + 1, end + n)]
    none = F.array().cast("array<struct<part:string,pos:int>>")
    places = scenes.select("media_id", "scene_idx", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("p")).select("media_id", "scene_idx", "p.*")
    return places.join(cues.select("media_id", "pos"), ["media_id", "pos"]).select("media_id", "scene_idx", "part", "pos")


def review_frames(windows: DataFrame, scenes: DataFrame, cues: DataFrame, n: int) -> DataFrame:
    """What a reviewer of the windows (media_id, scene_idx) is shown: (media_id, scene_idx, part, cue_id, text), the scenes' cues and n
    on either side. A window of no scene shows nothing."""
    wanted = scenes.join(windows.select("media_id", "scene_idx").distinct(), ["media_id", "scene_idx"], "left_semi")
    shown = frames(cues, wanted, n).join(cues.select("media_id", "pos", "cue_id", "text"), ["media_id", "pos"])
    return shown.select("media_id", "scene_idx", "part", "cue_id", "text")


def repair_frames(cues: DataFrame, wanted: DataFrame, n: int, column: str = "text") -> DataFrame:
    """The wanted cues (media_id, cue_id) with the texts of up to two neighbours on each side, or of n if that is less."""
    return context(cues, min(2, n), min(2, n), column).join(wanted.select("media_id", "cue_id").distinct(), ["media_id", "cue_id"])


def sample(cues: DataFrame, lines: int = C.CONTEXT_LINES) -> DataFrame:
    """Evenly sampled lines of each medium, blank ones left out, at most `lines`."""
    n = F.count("*").over(Window.partitionBy("media_id"))
    step = F.greatest(F.lit(1), F.floor(n / lines).cast("int"))
    hit = cues.select("*", step.alias("step")).where((F.col("pos") % F.col("step") == 0) & (F.length(F.trim("text")) > 0))
    rank = F.row_number().over(Window.partitionBy("media_id").orderBy("pos"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= lines).select("media_id", "pos", F.substring("text", 1, C.LINE_CHARS).alias("line"))


def risk(cues: DataFrame, scenes: DataFrame, defects: DataFrame, term_hits: DataFrame) -> DataFrame:
    """Scenes with their score: 1, 12 a defect, 3 a cue with a term, 2 a cue over 15 s. defects, term_hits: (media_id,
    cue_id)."""
    flag = lambda df, name: df.select("media_id", "cue_id").distinct().withColumn(name, F.lit(1))
    rows = assign(cues, scenes).join(flag(defects, "bad"), ["media_id", "cue_id"], "left").join(flag(term_hits, "term"), ["media_id", "cue_id"], "left")
    points = 12 * F.coalesce("bad", F.lit(0)) + 3 * F.coalesce("term", F.lit(0)) + F.when(F.col("end_ms") - F.col("start_ms") > 15000, 2).otherwise(0)
    score = rows.groupBy("media_id", "scene_idx").agg((1 + F.sum(points)).alias("score"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))
    return score


def select_risky(scored: DataFrame, limit: int = C.REVIEW_SCENES) -> DataFrame:
    """The scenes to review: the riskiest of each third of the medium, then the riskiest, halved beside chosen ones. Six
    rounds of a windowed maximum; ties go to the lower index."""
    whole = Window.partitionBy("media_id")
    seq = whole.orderBy("scene_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_ms, to_ms = F.first("start_ms").over(seq), F.last("end_ms").over(seq)
    span = F.greatest(F.lit(1000), to_ms - from_ms)
    third = F.least(F.lit(2), F.floor((F.col("start_ms") - from_ms) * 3 / span).cast("int"))
    rows = scored.select("*", third.alias("third"), F.count("*").over(whole).alias("scenes"))
    best = Window.partitionBy("media_id", "third").orderBy(F.desc("score"), "scene_idx")
    rows = rows.withColumn("chosen", F.row_number().over(best) == 1)
    for _ in range(limit - 1):
        w = whole.orderBy("scene_idx")
        beside = F.coalesce(F.lag("chosen").over(w), F.lit(False)) | F.coalesce(F.lead("chosen").over(w), F.lit(False))
        worth = F.when(~F.col("chosen"), F.col("score") / F.when(beside, 2.0).otherwise(1.0))
        rows = rows.withColumn("worth", worth).withColumn("taken", F.sum(F.col("chosen").cast("int")).over(whole))
        top = F.row_number().over(whole.orderBy(F.desc_nulls_last("worth"), "scene_idx")) == 1
        pick = top & F.col("worth").isNotNull() & (F.col("taken") < F.least(F.lit(limit), F.col("scenes")))
        rows = rows.withColumn("pick", pick).withColumn("chosen", F.col("chosen") | F.col("pick"))
    return rows.where("chosen").select("media_id", "scene_idx", "score", "third")
