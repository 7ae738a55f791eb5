"""SRT files as a data source: `spark.read.format("srt")` and `.write.format("srt")`, once `register` was called.

Files are read and written cue by cue; a write's files appear all at once (`staged`)."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from cuelake.sources.places import FilesReader, Found, opened
from cuelake.sources.staged import StagedWriter

SCHEMA = "media_id string, cue_id int, start_ms long, end_ms long, text string"
#: White space by Unicode.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The time line of an SRT block.
TIME = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"
LINE = re.compile(rf"[{SPACES}]*{TIME}[{SPACES}]*-->[{SPACES}]*{TIME}")
NUMBER = re.compile("[+-]?[0-9]+")


def is_number(line: str) -> bool:
    """Whether a line is a number of 32 bits."""
    bare = line.strip(SPACES)
    return bool(NUMBER.fullmatch(bare)) and len(bare.lstrip("+-0")) <= 10 and -(2**31) <= int(bare) < 2**31


def cue_of(block: list[str]) -> tuple[int, int, str] | None:
    """(start, end, text) of the lines between blank ones."""
    at = 1 if len(block) > 1 and is_number(block[0]) else 0
    time = LINE.match(block[at]) if len(block) > max(1, at) else None
    if not time:
        return None
    h, m, s, ms, h2, m2, s2, ms2 = map(int, time.groups())
    text = "\n".join(line.rstrip(SPACES) for line in block[at + 1 :]).strip(SPACES)
    return ((h * 60 + m) * 60 + s) * 1000 + ms, ((h2 * 60 + m2) * 60 + s2) * 1000 + ms2, text


def cues(lines: Iterator[str]) -> Iterator[tuple[int, int, int, str]]:
    """(cue_id, start, end, text) of lines, whose ends are taken off; ids count the cues that have a text."""
    block: list[str] = []
    n, begun = 0, False

    def ended() -> tuple[int, int, str] | None:
        found = cue_of(block)
        block.clear()
        return found if found and found[2] else None

    for line in lines:
        begun = begun or bool(line.strip(SPACES))
        if line and begun:
            block.append(line)
        elif block and (cue := ended()):
            n += 1
            yield n, *cue
    if block and (cue := ended()):
        yield n + 1, *cue


class SrtReader(FilesReader):
    suffix = ".srt"

    def rows(self, file: Found) -> Iterator[tuple]:
        with io.TextIOWrapper(io.BufferedReader(opened(file.uri)), encoding="utf-8-sig", errors="replace") as lines:
            for cue in cues(line.removesuffix("\n") for line in lines):
                yield file.uri, *cue


def clock(ms: int) -> str:
    s, ms = divmod(ms, 1000)
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02},{ms:03}"


def shown(cue_id: int, start_ms: int, end_ms: int, text: str | None) -> str:
    return f"{cue_id}\r\n{clock(start_ms)} --> {clock(end_ms)}\r\n{(text or '').strip(SPACES)}\r\n\r\n"


def safe_name(key: object) -> str:
    return re.sub(r'[\x00-\x1f<>:"/\\|?*]', "_", str(key)).rstrip(".").strip() or "video"


def file_name(media_id: object) -> str:
    return safe_name(media_id) + ".srt"


class SrtWriter(StagedWriter):
    """Writes a file for each medium."""

    columns = ("media_id", "cue_id", "start_ms", "end_ms", "text")

    def place(self, key: object) -> str:
        return file_name(key)

    def row(self, values: list, first: bool) -> bytes:
        return shown(*values).encode()

    def mine(self, name: str) -> bool:
        return name.endswith(".srt") and "/" not in name


class SrtSource(DataSource):
    """Options: path, or paths as a JSON list. A folder is read with all below."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SrtReader:
        return SrtReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SrtSource)
