"""What a player plays: names, window titles, command lines and the paths behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import media_extension


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_player(name: Column, players: tuple[str, ...]) -> Column:
    """Whether a process name, with or without .exe, is one of the players, in any case."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\.exe$", "").isin(*(p.lower() for p in players))


def display_name(title: Column, player: str) -> Column:
    """A window title without ` - <player>` at its end, in any case; null where it is blank or the player's name alone."""
    bare = F.trim(F.when(F.endswith(F.lower(title), F.lit(f" - {player.lower()}")), F.substring(title, F.lit(1), F.length(title) - len(player) - 3)).otherwise(title))
    return F.when((F.length(bare) > 0) & (F.lower(bare) != player.lower()), bare)


def title_matches(shown: Column, path: Column) -> Column:
    """Whether a shown name is the path's file, its stem, or starts with the file and a space; in any case."""
    low, name = F.lower(shown), F.lower(file_name(path))
    return (low == name) | (low == F.lower(stem(path))) | F.startswith(low, F.concat(name, F.lit(" ")))


def rooted(path: Column) -> Column:
    """Whether a path begins with a drive or a backslash."""
    return path.rlike(r"^(?:[A-Za-z]:|\\)")


def candidate(argument: Column) -> Column:
    """A command-line argument as the path of a video, or null: quotes are taken off, file URIs are read as paths, options and
    relative paths are none."""
    bare = F.trim(F.regexp_replace(F.trim(argument), '^"+|"+$', ""))
    uri = F.regexp_extract(bare, "(?i)^file://(.*)$", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)
    local = F.when(F.startswith(plain, F.lit("/")), F.substring(plain, F.lit(2), F.length(plain))).otherwise(F.concat(F.lit("\\\\"), F.replace(plain, F.lit("/"), F.lit("\\"))))
    path = F.when(F.length(uri) > 0, local).otherwise(bare)
    return F.when(rooted(path) & media_extension(path), path)


def present(rows: DataFrame, path: str, files: DataFrame | None) -> DataFrame:
    """The rows whose path is among the files (path) that are there, in any case; all rows if no files are given."""
    if files is None:
        return rows
    there = files.select(F.lower("path").alias("_there")).distinct()
    return rows.join(there, F.lower(F.col(path)) == F.col("_there"), "left_semi")


def command_line_media(processes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(pid, path) for each path of a video that is there among a process's arguments; a pid counts once, at its first line.
    processes: pid, seq, line."""
    first = processes.groupBy("pid").agg(F.min_by("line", "seq").alias("line"))
    words = F.regexp_extract_all("line", F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0))
    found = first.select("pid", F.explode(words).alias("a")).select("pid", candidate(F.col("a")).alias("path")).where("path is not null").distinct()
    return present(found, "path", files)


#: Age and number of the links that are looked at.
LINK_SECONDS, LINKS = 600, 30


def recent_link(links: DataFrame, titles: DataFrame, now_s: int, files: DataFrame | None = None) -> DataFrame:
    """(key, shown, path): for each title the newest link to a video that is there and has that title, among the latest LINKS of
    its key that are not older than ten minutes. links: key, path, at_s; titles: key, shown."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at_s"), "path"))
    fresh = links.withColumn("r", newest).where((F.col("r") <= LINKS) & (now_s - F.col("at_s") <= LINK_SECONDS) & media_extension(F.col("path")))
    met = present(fresh, "path", files).join(titles.select("key", "shown").distinct(), "key").where(title_matches(F.col("shown"), F.col("path")))
    return met.groupBy("key", "shown").agg(F.min_by("path", "r").alias("path"))


def known_media(titles: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """(key, shown, path): for each title the known path seen last that has that title, or in whose folder a video of that name
    is. Paths that are not there any more do not count. known: key, path, last_seq."""
    met = titles.select("key", "shown").distinct().join(present(known, "path", files), "key")
    same = title_matches(F.col("shown"), F.col("path"))
    beside = F.when(rooted(F.col("shown")), F.col("shown")).otherwise(F.concat(F.regexp_extract("path", r"^(.*[/\\])[^/\\]*$", 1), "shown"))
    met = met.select("key", "shown", "last_seq", "path", same.alias("same"), F.when(~same & media_extension(beside), beside).alias("beside"))
    there = present(met.where("beside is not null"), "beside", files).select("key", "shown", "last_seq", F.col("beside").alias("path"))
    found = met.where("same").select("key", "shown", "last_seq", "path").unionByName(there)
    return found.groupBy("key", "shown").agg(F.max_by("path", "last_seq").alias("path"))


def resolve(titles: DataFrame, known: DataFrame, current: DataFrame, links: DataFrame, files: DataFrame, now_s: int) -> DataFrame:
    """(key, shown, path), a row a title: the known path, else the current medium, else a recent link; null where none fits.
    titles: key, shown; known: key, path, last_seq; current: key, path (one a key); links: key, path, at_s; files: path."""
    asked = titles.select("key", "shown").where("shown is not null").distinct()
    now = asked.join(present(current, "path", files), "key").where(title_matches(F.col("shown"), F.col("path")))
    out = asked
    for name, found in (("_a", known_media(asked, known, files)), ("_b", now), ("_c", recent_link(links, asked, now_s, files))):
        out = out.join(found.select("key", "shown", F.col("path").alias(name)), ["key", "shown"], "left")
    return out.select("key", "shown", F.coalesce("_a", "_b", "_c").alias("path"))


def current_job(current: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (fingerprint, fallback) with the path of the current medium of the same content, or the fallback."""
    return jobs.join(current.select("fingerprint", "path"), "fingerprint", "left").select("fingerprint", F.coalesce("path", "fallback").alias("path"))
