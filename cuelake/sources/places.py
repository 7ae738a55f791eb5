"""Files by path or URI, listed on the driver and opened where they are read."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSourceReader, InputPartition

#: Bytes and files of one partition, about; a larger file makes one alone.
PART_BYTES, PART_FILES = 32 * 1024 * 1024, 2_000


def located(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before that. Names of local files are taken as they are,
    with or without `file://`; those of other systems are read by their URI's rules."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:(?://)?", "", path)), "file://"
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def spelled(paths: str | list[str]) -> dict[str, str]:
    """Options of a reader for one path or several."""
    return {"paths": json.dumps([paths] if isinstance(paths, str) else paths)}


@dataclass(frozen=True)
class Found:
    uri: str
    size: int


def listing(paths: list[str], suffix: str) -> list[Found]:
    """The files at the paths, and of folders all below that end with the suffix (in any case), by name. Names that begin with a
    dot or an underscore are left out, and folders of such names."""
    out: list[Found] = []
    for path in paths:
        system, inner, head = located(path)
        at = system.get_file_info(inner)
        if at.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        below = [at] if at.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        for f in below:
            hidden = any(part[:1] in "._" for part in f.path[len(inner) :].split("/") if part)
            if f.type == pafs.FileType.File and (f.path == inner or f.path.lower().endswith(suffix) and not hidden):
                out.append(Found(head + f.path, f.size))
    return sorted(out, key=lambda f: f.uri)


def opened(uri: str):
    """A file that can be searched; only what is asked for is read."""
    system, inner, _ = located(uri)
    return system.open_input_file(inner)


class Part(InputPartition):
    def __init__(self, files: list[Found]):
        super().__init__(None)
        self.files = files


class FilesReader(DataSourceReader):
    """Deals the files at `path` (or `paths`, a JSON list) out to partitions by what of them is read."""

    suffix = ""

    def __init__(self, options: dict):
        listed = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths: list[str] = listed

    def cost(self, file: Found) -> int:
        return file.size

    def partitions(self) -> list[Part]:
        parts: list[list[Found]] = [[]]
        size = 0
        for file in listing(self.paths, self.suffix):
            if parts[-1] and (size + self.cost(file) > PART_BYTES or len(parts[-1]) >= PART_FILES):
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += self.cost(file)
        return [Part(p) for p in parts]

    def rows(self, file: Found) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: Part) -> Iterator[tuple]:
        for file in partition.files:
            yield from self.rows(file)
