"""Writers whose files appear all at once.

A write stages its files beside their places and moves them when all tasks have ended: until then readers see what was there
before, and if a task fails nothing is left. `recover` ends what a driver that was lost while it moved files has begun, and
removes what others have left."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from cuelake.sources.places import located

STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class StagedWriter(DataSourceArrowWriter):
    """Writes a file for each value of the first of `columns`. Its rows have to come one after the other, in their order, in one task.
    A file is its head, its rows and its tail; `place` names it below the path."""

    columns: tuple[str, ...]

    def place(self, key: object) -> str:
        raise NotImplementedError

    def head(self) -> bytes:
        return b""

    def row(self, values: list, first: bool) -> bytes:
        raise NotImplementedError

    def tail(self) -> bytes:
        return b""

    def mine(self, name: str) -> bool:
        """Whether a file below the path is one that an overwriting write replaces."""
        raise NotImplementedError

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staged = f"{STAGED}/{uuid.uuid4().hex}"
        system, root = self._at()
        system.create_dir(f"{root}/{self.staged}", recursive=True)  # here only: a task that is still at work after an abort finds no folder

    def _at(self) -> tuple[pafs.FileSystem, str]:
        system, inner, _ = located(self.path)
        return system, inner.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._at()
        moves: dict[str, str] = {}
        name = out = None
        try:
            for batch in iterator:
                rows = batch.select(list(self.columns))
                for key, *values in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if fresh := out is None or self.place(key) != name:
                        if out is not None:
                            out.write(self.tail())
                            out.close()
                        name = self.place(key)
                        if name in moves:
                            raise ValueError(f"the rows of {name} do not come one after the other")
                        moves[name] = f"{self.staged}/{uuid.uuid4().hex}"
                        out = io.BufferedWriter(system.open_output_stream(f"{root}/{moves[name]}"))
                        out.write(self.head())
                    out.write(self.row(values, fresh))
            if out is not None:
                out.write(self.tail())
        finally:
            if out is not None:
                out.close()
        return Written([(staged, name) for name, staged in moves.items()])

    def commit(self, messages: list[Written]) -> None:
        system, root = self._at()
        moves = [m for message in messages if message is not None for m in message.moves]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks have written the same file")
        gone = [] if not self.overwrite else sorted({n for f in _files(system, root) if self.mine(n := f.path[len(root) + 1 :])} - set(names))
        with system.open_output_stream(f"{root}/{self.staged}/moves") as f:
            f.write(json.dumps({"moves": moves, "gone": gone}).encode())
        system.move(f"{root}/{self.staged}/moves", f"{root}/{self.staged}/moves.json")  # from here on the write holds
        _finish(system, root, self.staged, moves, gone)

    def abort(self, messages: list[Written]) -> None:
        system, root = self._at()
        for last in (False, False, True):
            try:
                if system.get_file_info(f"{root}/{self.staged}").type == pafs.FileType.Directory:
                    system.delete_dir(f"{root}/{self.staged}")
                break
            except OSError:  # a task has begun a file meanwhile
                if last:
                    raise
        _tidy(system, root)


def _files(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """The files below a folder, but for those that writes have staged there."""
    every = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True))
    return [f for f in every if f.type == pafs.FileType.File and not f.path[len(folder) + 1 :].startswith(f"{STAGED}/")]


def _tidy(system: pafs.FileSystem, root: str) -> None:
    if not system.get_file_info(pafs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)) and system.get_file_info(f"{root}/{STAGED}").type == pafs.FileType.Directory:
        system.delete_dir(f"{root}/{STAGED}")


def _finish(system: pafs.FileSystem, root: str, staged: str, moves: list, gone: list[str]) -> None:
    """Move what is not yet in its place. Doing so again changes nothing."""
    there = {f.path for f in _files(system, f"{root}/{staged}")}
    for source, name in moves:
        if f"{root}/{source}" in there:
            if "/" in name:
                system.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            system.move(f"{root}/{source}", f"{root}/{name}")
    there = {f.path for f in _files(system, root)} if gone else set()
    for name in gone:
        if f"{root}/{name}" in there:
            system.delete_file(f"{root}/{name}")
    system.delete_dir(f"{root}/{staged}")
    _tidy(system, root)


def recover(path: str) -> int:
    """End the writes to a folder whose moves have begun, and remove the files of others, which must not be running. The number
    of writes that were ended."""
    system, root, _ = located(path)
    root, n = root.rstrip("/"), 0
    for folder in system.get_file_info(pafs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)):
        if system.get_file_info(f"{folder.path}/moves.json").type == pafs.FileType.File:
            with system.open_input_file(f"{folder.path}/moves.json") as f:
                todo = json.loads(f.read())
            _finish(system, root, f"{STAGED}/{folder.base_name}", todo["moves"], todo["gone"])
            n += 1
        else:
            system.delete_dir(folder.path)
    _tidy(system, root)
    return n
