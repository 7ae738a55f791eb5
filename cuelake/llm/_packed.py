"""Texts on the way through a shuffle: packed by zstandard, keyed by row identity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._base import lean, row_key


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """(_id, _tx, _packed) of each row of docs (a null text is empty), and the columns to keep."""
    rows = docs.select(*row_key(), *keep, "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("_packed", T.BinaryType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with `text` in place of `_packed`."""
    import zstandard

    unsqueeze = zstandard.ZstdDecompressor().decompress
    texts = [unsqueeze(p).decode("utf-8", "surrogatepass") for p in batch.column("_packed").to_pylist()]
    rest = [n for n in batch.schema.names if n != "_packed"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.string())], [*rest, "text"])
