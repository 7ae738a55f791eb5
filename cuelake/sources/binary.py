"""Facts about large files of which only parts are read: WAV headers and content fingerprints, as data sources.

A task seeks in its files; no content becomes a column, so files may be of any size."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from cuelake.operators import identity
from cuelake.sources.places import FilesReader, Found, opened, spelled

#: Bytes that are read at once, and what looking at the chunks of a WAV file costs, about.
PIECE, HEADER = 1024 * 1024, 64 * 1024


def wav_seconds(file) -> float | None:
    """Seconds of a RIFF WAVE file: the bytes of its data chunks by its byte rate. Chunks are padded to even sizes; what is
    none, or has no rate or no data, has no length."""
    size = file.size()
    if size < 12 or file.read(4) != b"RIFF" or file.read(8)[4:] != b"WAVE":
        return None
    at, rate, data = 12, 0, 0
    while at + 8 <= size:
        file.seek(at)
        kind, n = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt " and n >= 12 and at + 20 <= size:
            rate = struct.unpack("<8xI", file.read(12))[0]
        elif kind == b"data":
            data += n
        at += 8 + n + n % 2
    return data / rate if rate and data else None


def fingerprint(file, tag: str = identity.TAG) -> str:
    """As `identity.fingerprint` of the content: all of a small file piece by piece, nine segments of a large one."""
    n = file.size()
    digest = hashlib.sha256(tag.encode() + n.to_bytes(8, "little"))
    if n <= identity.SMALL:
        while piece := file.read(PIECE):
            digest.update(piece)
    else:
        for i in range(identity.SEGMENTS):
            offset = (n - identity.SEGMENT) * i // (identity.SEGMENTS - 1)
            file.seek(offset)
            digest.update(offset.to_bytes(8, "little"))
            digest.update(file.read(identity.SEGMENT))
    return digest.hexdigest()


class WavReader(FilesReader):
    suffix = ".wav"

    def cost(self, file: Found) -> int:
        return min(file.size, HEADER)

    def rows(self, file: Found) -> Iterator[tuple]:
        with opened(file.uri) as f:
            yield file.uri, file.size, wav_seconds(f)


class FingerprintReader(FilesReader):
    def cost(self, file: Found) -> int:
        return file.size if file.size <= identity.SMALL else identity.SEGMENT * identity.SEGMENTS

    def rows(self, file: Found) -> Iterator[tuple]:
        with opened(file.uri) as f:
            yield file.uri, file.size, fingerprint(f)


class WavSource(DataSource):
    """(path, size, seconds) of WAV files at `path`, or at `paths` as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, size long, seconds double"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)


class FingerprintSource(DataSource):
    """(path, size, fingerprint) of files at `path`, or at `paths` as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "fingerprint"

    def schema(self) -> str:
        return "path string, size long, fingerprint string"

    def reader(self, schema: StructType) -> FingerprintReader:
        return FingerprintReader(self.options)


def read_wav(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, seconds) of WAV files."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(**spelled(paths)).load()


def read_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, fingerprint) of files."""
    spark.dataSource.register(FingerprintSource)
    return spark.read.format("fingerprint").options(**spelled(paths)).load()
