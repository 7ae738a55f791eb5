"""Cues as SRT texts, and what to publish where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.fold import fold
from cuelake.functions.text import SPACE, clock, safe_file_name
from cuelake.sources import srt_files

_FILE = T.StructType([T.StructField(c, T.StringType()) for c in ("place", "name", "text", "action")])


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def render(cues: DataFrame, body: str | None = None) -> DataFrame:
    """(media_id, content): one SRT text a medium, its cues by id. A cue shows its trimmed text, or the column `body` as it is.
    Cues are sorted and read as a stream; a task holds the text of the medium that it is at. `publish` holds one cue."""
    time = F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")))
    text = F.coalesce(body, F.lit("")) if body else _trimmed(F.col("text"))
    block = F.concat_ws("\r\n", F.col("cue_id").cast("string"), time, text, F.lit(""), F.lit(""))

    def step(content: bytearray, row: tuple) -> tuple:
        content += row[1].encode()
        return content, []

    of = cues.schema["media_id"].dataType.simpleString()
    rows = cues.select("media_id", block.alias("block"), "cue_id")
    return fold(rows, "media_id", ["cue_id", "block"], bytearray, step, lambda content, media_id: [(media_id, content)], f"media_id {of}, content string")


def publish(cues: DataFrame, path: str, overwrite: bool = False) -> None:
    """One SRT file a medium in the folder: all files appear when every task has ended, none if one fails. Files of other media
    stay, unless they are to be overwritten."""
    srt_files.register(cues.sparkSession)
    rows = cues.select(F.col("media_id").cast("string"), F.col("cue_id").cast("int"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "text")
    dealt = rows.repartition("media_id").sortWithinPartitions("media_id", "cue_id")
    dealt.write.format("srt").mode("overwrite" if overwrite else "append").save(path)


def bilingual(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """Cues with `body`: their text, followed by the translation on a line of its own (empty where missing)."""
    joined = cues.join(translations.select("media_id", "cue_id", "target"), ["media_id", "cue_id"], "left")
    return joined.withColumn("body", F.concat_ws("\r\n", _trimmed(F.col("text")), _trimmed(F.col("target")))).drop("target")


def translated(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """Cues with the translation as their `text` (empty where missing)."""
    joined = cues.drop("text").join(translations.select("media_id", "cue_id", "target"), ["media_id", "cue_id"], "left")
    return joined.withColumn("text", F.coalesce("target", F.lit(""))).drop("target")


def publish_files(media: DataFrame) -> DataFrame:
    """Every file that publishing a medium touches: (media_id, place, name, text, action), text being one of source, target and
    bilingual. media: media_id, stem, present (whether the medium is still there), beside (whether a sidecar is wanted),
    existing, legacy_target, legacy_bilingual (hashes of files that are there, or null), source, target, bilingual (hashes of
    our texts), own (hashes of all that we ever made for it).

    A medium that is gone has no rows. A foreign sidecar stays; one that has our text already is not written again, as
    players watch it. Copies under older names go only if they are ours to the byte."""
    old, mine = F.col("existing"), F.array("source", "target", "bilingual")
    ours = F.array_contains(mine, old) | F.array_contains(F.coalesce("own", F.array().cast("array<string>")), old)
    sidecar = F.when(old.isNull(), "write").when(old == F.col("bilingual"), "keep").when(ours, "replace").otherwise("foreign")
    safe = safe_file_name(F.col("stem"))
    row = lambda place, name, text, action: F.struct(F.lit(place).alias("place"), name.alias("name"), F.lit(text).alias("text"), action.alias("action"))
    named = lambda end: F.concat("stem", F.lit(end))
    gone = lambda here, text: F.when(F.col(here) == F.col(text), "delete")
    beside = [
        row("beside", named(".srt"), "bilingual", sidecar), row("beside", named(".zh-CN.srt"), "target", gone("legacy_target", "target")),
        row("beside", named(".ja-zh-CN.srt"), "bilingual", gone("legacy_bilingual", "bilingual")),
    ]
    archive = [row("archive", F.concat(safe, F.lit(f"-{text}.srt")), text, F.lit("write")) for text in ("bilingual", "source", "target")]
    rows = F.concat(F.when(F.col("beside"), F.array(*beside)).otherwise(F.array().cast(T.ArrayType(_FILE))), F.array(*archive))
    return media.where("present").select("media_id", F.explode(rows).alias("f")).select("media_id", "f.*").where("action is not null")


def publish_warnings(media: DataFrame, files: DataFrame) -> DataFrame:
    """(media_id, warning): media that are gone, and sidecars that stay because they are foreign."""
    foreign = files.where("action = 'foreign'").select("media_id", F.lit("foreign sidecar: archived only").alias("warning"))
    return media.where("not present").select("media_id", F.lit("medium is gone: kept in the cache only").alias("warning")).unionByName(foreign)


def publish_plan(files: DataFrame, generated: DataFrame) -> DataFrame:
    """What to do with each file beside a medium. files: (media_id, existing: hash or null, bilingual: hash);
    generated: (media_id, hash) of all texts that we made for the medium."""
    own = generated.select("media_id", F.col("hash").alias("existing"), F.lit(True).alias("own")).distinct()
    action = (
        F.when(F.col("existing").isNull(), "write")
        .when(F.col("existing") == F.col("bilingual"), "keep")
        .when(F.coalesce("own", F.lit(False)), "replace")
        .otherwise("archive-only")
    )
    return files.join(own, ["media_id", "existing"], "left").select("media_id", "existing", "bilingual", action.alias("action"))


def write(texts: DataFrame, path: str) -> None:
    """One text file a medium under path, in folders media_id=...; the job's commit makes the folder appear at once."""
    texts.select("media_id", F.col("content").alias("value")).write.partitionBy("media_id").text(path, lineSep="\r\n")
