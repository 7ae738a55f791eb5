"""Language identification by compression: the language whose dictionary makes a text smallest.

`train` makes one raw-content zstandard dictionary for each language from a bounded sample of labelled rows.
`identify` cuts the whole text into blocks, compresses each block with every dictionary and adds up the sizes (letter case aside). The
smallest sum names the language; where the next best is nearly as small, `rejected` is set.

Defined results: a null text, or one without letters, is `und` with score 0 (and rejected); equal sizes go to the
first language by code point; rows with a null lang train nothing; with no training rows every text is `und`;
copies of a text train once; repeated rows give repeated results; extra columns pass through `identify`, but one that
has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import crc_mod, documents, lean, small_batches, staged
from ._words import chunks

UNKNOWN = "und"
#: Distinct labelled texts of each language that may train its dictionary, and how long the pieces are that whole texts are
#: cut into.
TRAIN_ROWS = 256
PIECE_CHARS = 256
#: Bytes of a dictionary, and of all of them together (more languages than 600 share those).
DICTIONARY_BYTES = 112_640
ALL_DICTIONARY_BYTES = 600 * DICTIONARY_BYTES
#: Bytes compressed at once. Shorter blocks lean more on the dictionary than on the text itself.
BLOCK = 1024
LEVEL = 6
#: Share of the next best size by which the best must be smaller.
MARGIN = 0.02


def train(df: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_ROWS) -> dict[str, bytes]:
    """A dictionary's content for each language. At most `rows` distinct texts, chosen by their hashes, are cut into pieces from
    beginning to end; if these are more than a dictionary holds, it takes pieces at even distances over all of them."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Copies count once. Of many texts only those with small hashes are ranked: about four times as many as are taken, in one
    # task a language. Hashes of distinct texts are independent, so that too few pass has a chance of about exp(-1.6 * rows).
    distinct = labelled.select("lang", "h").distinct()
    share = distinct.groupBy("lang").agg((F.lit(4.0 * rows * 2**30) / F.count("*")).alias("least"))
    few = distinct.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(2**30)) < F.col("least"))  # a row a language
    ranked = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= rows)
    found = labelled.join(F.broadcast(ranked), ["lang", "h"])  # `rows` rows a language
    whole = found.groupBy("lang", "i").agg(F.min("text").alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))  # one pass, however long the text
    pieces = whole.select("lang", "i", F.posexplode(cut).alias("k", "piece")).withColumn("piece", F.lower("piece"))
    pieces = staged(pieces.withColumn("bytes", F.octet_length("piece")), "pieces")
    each = min(DICTIONARY_BYTES, ALL_DICTIONARY_BYTES // max(pieces.select("lang").distinct().count(), 1))
    of = Window.partitionBy("lang")  # the pieces of `rows` texts
    until = F.sum("bytes").over(of.orderBy("i", "k"))
    # A dictionary's bytes are dealt evenly over all the pieces' bytes: one is taken where its share reaches a whole one.
    step = F.greatest(F.sum("bytes").over(of) / F.lit(each), F.lit(1.0))
    filled = lambda upto: F.floor(upto / F.col("step") / F.col("mean"))
    taken = pieces.withColumns({"until": until, "step": step, "mean": F.avg("bytes").over(of)})
    taken = taken.where((F.col("step") == 1) | (filled(F.col("until")) > filled(F.col("until") - F.col("bytes"))))
    texts = taken.groupBy("lang", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    joined = texts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("p"))
    content = joined.select("lang", F.array_join(F.col("p.piece"), "\n").alias("content")).collect()  # `each` bytes a language
    return {r.lang: r.content.encode() for r in sorted(content)}


def blocks_of(text: str) -> list[bytes]:
    raw = text.lower().encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Sizer:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.languages = list(content)
        self.compressors = []
        for raw in content.values():
            made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.compressors.append(zstandard.ZstdCompressor(dict_data=made, level=LEVEL, **options))

    def sizes(self, text: str) -> np.ndarray:
        pieces = blocks_of(text)
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors])

    def best(self, text: str) -> tuple[str, float]:
        """The language, and by which share of the next best size it is smaller (1 with one language)."""
        got = self.sizes(text)
        k = int(got.argmin())
        rest = np.delete(got, k)
        return self.languages[k], float(1 - got[k] / rest.min()) if len(rest) else 1.0


def identify(df: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """df with lang_pred, score (the margin) and rejected (the margin is narrow, or nothing could be told)."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(content)  # bounded: ALL_DICTIONARY_BYTES
    added = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    keep = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    schema = T.StructType(keep + added.fields)
    letters: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        sizer, arrow = Sizer(shared.value), to_arrow_schema(schema)
        for b in (c for batch in batches for c in chunks(batch, text)):
            texts, told = b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            out = [sizer.best(t) if ok and sizer.languages else (UNKNOWN, 0.0) for t, ok in zip(texts, told, strict=True)]
            columns = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            columns += [
                pa.array([x for x, _ in out], pa.string()),
                pa.array([s for _, s in out], pa.float64()),
                pa.array([x == UNKNOWN or s < MARGIN for x, s in out], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.withColumn("_has_letters", letters).mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    content = train(docs.where(crc_mod(4) != 2))
    out = identify(docs.select("doc_id", "text"), content)
    return out.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
