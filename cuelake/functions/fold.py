"""Folds over ordered rows by key, as a stream: what a key holds is never gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Output rows that are handed on at once, and the characters or bytes of their texts: whichever is reached first.
ROWS, TEXT = 10_000, 1_000_000


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, finish: Callable | None, schema: str) -> DataFrame:
    """The rows that step(state, row) and finish(state, key) make, where step returns the next state and its rows.

    Rows are dealt by key and sorted within their partitions; a task reads its sorted rows once and carries one state. `row`
    holds the values of all columns in order, that of the key being the first. Rows are handed on as soon as there are many or
    their texts are long, so a task holds no more of them however many keys it has; a text may be str or UTF-8 bytes. A state
    that is a bytearray can be the text itself; a long one is let go before the next key begins."""
    names = [key, *(c for c in rows.columns if c != key)]
    shape = T.StructType.fromDDL(schema)
    texts = [i for i, f in enumerate(shape) if isinstance(f.dataType, T.StringType | T.BinaryType)]

    def folded(every: Iterator[tuple]) -> Iterator[list[tuple]]:
        for k, mine in groupby(every, key=lambda row: row[0]):
            state = start()
            for row in mine:
                state, made = step(state, row)
                if made:
                    yield made
            if finish is not None:
                yield finish(state, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)

        def handed(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            # As binary first: pa.array decodes the bytes of a string into one more copy, the cast checks them in place.
            plain = [pa.binary() if pa.types.is_string(f.type) else f.type for f in arrow]
            arrays = [pa.array(list(c), t).cast(f.type) for c, t, f in zip(columns, plain, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        out: list[tuple] = []
        held = 0
        every = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for made in folded(every):
            out += made
            held += sum(len(row[i]) for row in made for i in texts if row[i] is not None)
            if len(out) >= ROWS or held >= TEXT:
                yield handed(out)
                out, held = [], 0
            del made
        yield handed(out)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
