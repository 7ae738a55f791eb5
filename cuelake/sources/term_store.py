"""Term lists, a JSON file a medium in a folder of its own: `<path>/<medium>/term-index.json`.

A list is a table of entries: media_id, ord (their order), source, target, variants. Files that are no such list have no rows, so
that its terms are made anew."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from cuelake.sources.places import FilesReader, Found, opened, spelled
from cuelake.sources.staged import StagedWriter

# The file's name, its version and its fields.
NAME, VERSION = "term-index.json", "1"
SCHEMA = "media_id string, ord int, source string, target string, variants array<string>"


def entries_of(raw: bytes) -> list[tuple]:
    """(source, target, variants) of a file; nothing of what is no list of entries."""
    try:
        listed = json.loads(raw.decode("utf-8-sig"))["Entries"]
        return [(e.get("Source"), e.get("Target"), [str(v) for v in e.get("Variants") or [] if v is not None]) for e in listed if isinstance(e, dict)]
    except (ValueError, KeyError, TypeError):
        return []


class TermReader(FilesReader):
    suffix = NAME

    def rows(self, file: Found) -> Iterator[tuple]:
        with opened(file.uri) as f:
            for i, entry in enumerate(entries_of(f.read())):
                yield unquote(file.uri.rsplit("/", 2)[1]), i, *entry


class TermWriter(StagedWriter):
    columns = ("media_id", "ord", "source", "target", "variants", "language")

    def place(self, key: object) -> str:
        return f"{quote(str(key), safe=' ')}/{NAME}"

    def row(self, values: list, first: bool) -> bytes:
        _, source, target, variants, language = values
        entry = json.dumps({"Source": source, "Target": target, "Variants": variants or []}, ensure_ascii=False)
        head = json.dumps({"Version": VERSION, "SourceLanguage": language})[:-1] + ', "Entries": ['
        return ((head if first else ", ") + entry).encode()

    def tail(self) -> bytes:
        return b"]}"

    def mine(self, name: str) -> bool:
        return name.count("/") == 1 and name.endswith(f"/{NAME}")


class TermSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terms"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TermReader:
        return TermReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TermWriter:
        return TermWriter(self.options, overwrite)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all media below a path."""
    spark.dataSource.register(TermSource)
    return spark.read.format("terms").options(**spelled(path)).load()


def save(entries: DataFrame, path: str, language: str) -> None:
    """Write the lists of the media in entries (media_id, ord, source, target, variants); those of other media stay."""
    entries.sparkSession.dataSource.register(TermSource)
    rows = entries.select(F.col("media_id").cast("string"), F.col("ord").cast("int"), "source", "target", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), F.lit(language).alias("language"))
    rows.repartition("media_id").sortWithinPartitions("media_id", "ord").write.format("terms").mode("append").save(path)


def missing(media: DataFrame, stored: DataFrame) -> DataFrame:
    """The media (media_id) that have no entry in the store: their lists are to be built."""
    return media.join(stored.select("media_id").distinct(), "media_id", "left_anti")
