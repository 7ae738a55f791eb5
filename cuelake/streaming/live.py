"""Live sessions: player events as tables (batch) and as streams.

Streaming forms take the same columns and keep state by key; on a bounded source both forms give equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.streaming import ordered


def media_changes(events: DataFrame) -> DataFrame:
    """Events whose path differs, in any case, from the one before: (session, seq, path)."""
    before = F.lag(F.lower("path")).over(Window.partitionBy("session").orderBy("seq"))
    seen = events.withColumn("before", before)
    return seen.where(F.col("before").isNull() | (F.col("before") != F.lower("path"))).drop("before")


def sessions(events: DataFrame, gap_ms: int = C.INACTIVE_MS) -> DataFrame:
    """(key, session, start_ms, end_ms, n): runs of events with gaps under gap_ms."""
    w = Window.partitionBy("key").orderBy("at_ms")
    fresh = F.when(F.col("at_ms") - F.lag("at_ms").over(w) < gap_ms, 0).otherwise(1)
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = events.withColumn("fresh", fresh).withColumn("session", island)
    return numbered.groupBy("key", "session").agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count("*").alias("n"))


def recent(events: DataFrame, keep: int = C.RECENT_PATHS) -> DataFrame:
    """The `keep` paths of each key that were seen last: (key, path, last_seq, rank)."""
    last = events.groupBy("key", F.lower("path").alias("folded")).agg(F.max("seq").alias("last_seq"), F.max_by("path", "seq").alias("path"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("last_seq")))
    return last.withColumn("rank", rank).where(F.col("rank") <= keep).select("key", "path", "last_seq", "rank")


def take_inbox(slots: DataFrame, now_ms) -> DataFrame:
    """Slots that are not yet expired."""
    return slots.where(F.lit(now_ms) - F.col("at_ms") <= C.INBOX_TTL_MS)


def upsert_queue(requests: DataFrame) -> DataFrame:
    """One request a key (path and language in upper case): the latest."""
    key = F.sha1(F.upper(F.concat_ws("|", "path", "language")))
    return requests.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct("path", "language", "seq"), "seq").alias("r")).select("key", "r.*")


def complete(requests: DataFrame, ended: DataFrame) -> DataFrame:
    """The requests whose work has not ended: success, failure and cancelling all take a request away. ended: key."""
    return requests.join(ended.select("key").distinct(), "key", "left_anti")


def still_active(known: DataFrame, active: DataFrame) -> DataFrame:
    """The known players (key, players) without those that are no longer active (key, players)."""
    now = active.select("key", F.col("players").alias("now"))
    none = F.array().cast("array<string>")
    return known.join(now, "key", "left").withColumn("players", F.array_intersect("players", F.coalesce("now", none))).drop("now")


# The launch policy, a fold over snapshots of players: its state is (pending, known, attempts, next_ms).


def observe(state: tuple, players: set[str], running: bool, now: int, starts: bool) -> tuple[tuple, bool]:
    """The state after a snapshot, and whether a launch was tried."""
    pending, known, attempts, later = state
    new = players - known
    pending = (pending & players) | new
    attempts = 0 if new else attempts
    if running:
        return (set(), players, 0, later), False
    if not pending or now < later:
        return (pending, players, attempts, later), False
    attempts += 1
    done = starts or attempts >= C.LAUNCH_ATTEMPTS
    return (set() if done else pending, players, attempts, now + C.COOLDOWN_MS), True


LAUNCHES = "key long, at_ms long, launched boolean, pending int, attempts int"


def _launcher(forget_ms: int | None) -> ordered.Machine:
    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        key, at, _, players, running, starts = row
        state, launched = observe(state, set(players), running, at, starts)
        return state, [(key, at, launched, len(state[0]), state[2])]

    return ordered.Machine(
        lambda: (set(), set(), 0, 0), step, lambda s: (sorted(s[0]), sorted(s[1]), s[2], s[3]), lambda r: (set(r[0]), set(r[1]), r[2], r[3]),
        "pending array<string>, known array<string>, attempts int, later long", LAUNCHES, forget_ms,
    )


def launches(snapshots: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The launch policy over snapshots (key, at_ms, seq, players, running, starts); a key is one machine, whose snapshots are
    met in order. With `forget_ms`, a machine that sends nothing for so long is new again."""
    return ordered.over_table(snapshots.select("key", "at_ms", "seq", "players", "running", "starts"), _launcher(forget_ms))


def launch_stream(snapshots: DataFrame, forget_ms: int | None = None, late: str = "10 seconds") -> DataFrame:
    """The same over a stream."""
    return ordered.over_stream(snapshots.select("key", "at_ms", "seq", "players", "running", "starts"), _launcher(forget_ms), late)


PLAYED = "session long, at_ms long, path string"


def _player(gap_ms: int) -> ordered.Machine:
    def step(state: str | None, row: tuple) -> tuple[str | None, list[tuple]]:
        session, at, _, path = row
        if path is None or state is not None and path.lower() == state.lower():
            return state, []
        return path, [(session, at, path)]

    return ordered.Machine(lambda: None, step, lambda path: (path,), lambda r: r[0], "current string", PLAYED, gap_ms, lambda path, session, at: [(session, at, None)] if path is not None else [])


def played(events: DataFrame, gap_ms: int = C.INACTIVE_MS) -> DataFrame:
    """(session, at_ms, path): each change of the medium that a player shows, in any case, and null where nothing was heard of the
    player for gap_ms; after that its medium is new again. events: session, at_ms, seq, path (null: playing nothing)."""
    return ordered.over_table(events.select("session", "at_ms", "seq", "path"), _player(gap_ms))


def played_stream(events: DataFrame, gap_ms: int = C.INACTIVE_MS, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: the null comes when the watermark has passed the gap."""
    return ordered.over_stream(events.select("session", "at_ms", "seq", "path"), _player(gap_ms), late)


def session_stream(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Sessions over a stream of (key, ts), by Spark's session windows."""
    window = F.session_window("ts", gap)
    counted = events.withWatermark("ts", late).groupBy("key", window).agg(F.count("*").alias("n"))
    return counted.select("key", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")
