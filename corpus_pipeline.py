"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

toxicity drops the documents that it rejects; near_duplicates keeps one document of each group; substrings cuts repeated
passages out of the texts; mixing gives each document as many rows as the mix takes copies of it; tokens encodes the
texts, and checks the ids by decoding them.

No SQL states the rows of run(): the toxicity score is a fitted model and the ids come from a vocabulary file. The
stages are tested against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, mixing, ngram_join, substring_dedup, toxicity
from cuelake.llm._base import crc_mod, discard, documents, scratch, staged

ORACLE_SQL = None

#: Near-duplicates: words of a shingle, and the similarity in percent from which on documents are near copies.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score as toxic. A null or empty text has no bad word and stays; repeated rows go or stay
    together; an empty table gives an empty table; columns that begin with an underscore are reserved."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(crc_mod(4) != 2))
    scored = toxicity.score(docs, model, names=("_score", "_restored"))
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (a null one first). Null, empty and blank texts
    are in no group and stay; of rows that repeat a doc_id and text one stays, by its other columns."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, NEAR_PERCENT)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages that stand earlier too; other words, lines and spaces stay, and n_chars follows. Every document
    stays, even with nothing left; a null text becomes empty."""
    out = substring_dedup.remove(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A document without words gives nothing to the mix, so it goes; a null
    source is a source; repeated rows are taken alike; other columns may have any names."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))  # other columns can't clash
    mixed = mixing.mix(mixing.with_size(rows)).where("taken > 0")
    copies = (F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, their number, and the digest of the text that they decode to. Null and empty texts have no
    ids; repeated rows have equal ones; an empty table gives an empty table."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.build_lexicon(docs), made=("n_tokens", "ids", "decoded_sha256"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_substrings),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages write on their way is deleted as soon as nothing reads it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, outlives=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
