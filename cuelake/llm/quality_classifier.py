"""Quality by nearest-neighbour voting in a latent semantic space.

`fit` turns a bounded sample of labelled rows into TF-IDF vectors of hashed byte trigrams, finds their leading singular
directions and keeps the labelled vectors there. `score` projects every whole text, takes the cosine with every labelled
vector in blocks, and lets the K nearest vote with their similarity as weight.

Defined results: null and empty texts have no trigrams and get the share of good labels in the sample, as does a text
without a neighbour of positive similarity; with no labelled rows every score is 0.5; rows with a null label teach
nothing; equal similarities are settled by the sample's order (a hash of doc_id, then doc_id, label and trigrams);
repeated rows get repeated results; extra columns pass through `score`, but one of that name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import crc_mod, documents, lean, small_batches
from ._words import chunks, utf8

#: Labelled rows that are fitted, at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 4096
#: Hashed trigrams, latent dimensions, neighbours that vote, and texts compared at once.
FEATURES = 4096
DIMENSIONS = 32
NEIGHBOURS = 25
BLOCK = 512
SEED = 7


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # FEATURES x DIMENSIONS, with the inverse document frequencies in it
    vectors: np.ndarray  # labelled rows x DIMENSIONS, of length 1
    labels: np.ndarray
    prior: float


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of each hashed byte trigram of each row."""
    n = len(offsets) - 1
    wide = data.astype(np.uint32)
    if len(wide) < 3:
        return np.zeros((n, FEATURES), np.float32)
    grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    at = np.arange(len(grams))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    counts = np.bincount(row[inside] * FEATURES + hashed[inside], minlength=n * FEATURES)
    return np.log1p(counts.reshape(n, FEATURES).astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def leading_directions(x: np.ndarray, k: int) -> np.ndarray:
    """The first k right singular vectors of x by subspace iteration from a seeded start."""
    k = min(k, *x.shape)
    basis = np.random.Generator(np.random.PCG64(SEED)).standard_normal((x.shape[1], k + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turned = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :k].astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents as (doc_id, text, label): those with the smallest hashes of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded: `rows` pairs of numbers


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id and a 0/1 label. At most `rows` labelled rows are used."""
    small_batches(docs.sparkSession)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                rows_of = [x.astype(np.float16).tobytes() for x in trigram_counts(*utf8(c.column("text")))]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("label"), pa.array(rows_of, pa.binary())], ["doc_id", "label", "counts"])

    chosen = sample(docs, labels, label, rows).select("doc_id", F.col("label").cast("int").alias("label"), "text")
    counted = chosen.mapInArrow(count, "doc_id long, label int, counts binary")
    got = counted.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "counts").limit(rows).collect()  # a doc_id may have several rows
    if not got:
        return Model(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    x = np.stack([np.frombuffer(r.counts, np.float16) for r in got]).astype(np.float32)
    y = np.array([r.label for r in got], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32)
    x = unit(x * idf)
    directions = leading_directions(x, DIMENSIONS)
    return Model(idf[:, None] * directions, unit(x @ directions), y, float(y.mean()))


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, of equal ones those that come first."""
    bits = (cosine.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    rank = np.where(bits < 0, -(2**31) - bits, bits)  # in the order of the numbers
    width = cosine.shape[1]
    key = rank * width + (width - 1 - np.arange(width))
    return np.argpartition(-key, k - 1, axis=1)[:, :k]


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """The score of each row of trigram counts."""
    if not len(model.labels):
        return np.full(len(counts), model.prior)
    k = min(NEIGHBOURS, len(model.labels))
    out = np.full(len(counts), model.prior)
    for at in range(0, len(counts), BLOCK):
        cosine = unit(counts[at : at + BLOCK] @ model.projection) @ model.vectors.T
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0)
        total = weight.sum(1)
        good = (weight * model.labels[near]).sum(1)
        out[at : at + BLOCK] = np.divide(good, total, out=np.full(len(total), model.prior, np.float32), where=total > 0)
    return np.clip(out, 0.0, 1.0)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `score`: the similarity-weighted share of good labels among each text's neighbours."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: SAMPLE_ROWS and FEATURES rows of DIMENSIONS floats
    keep = [f for f in df.schema.fields if f.name != "score"]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for c in chunks(b, text):
                got = vote(shared.value, trigram_counts(*utf8(c.column(c.schema.get_field_index(text)))))
                columns = [c.column(c.schema.get_field_index(f.name)) for f in keep] + [pa.array(got, pa.float64())]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(crc_mod(3) != 1))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
