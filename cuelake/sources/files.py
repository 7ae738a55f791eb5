"""JSON documents, queues and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake import config as C


def parse_json(text: Column, schema: str, fallback: Column) -> Column:
    """The document (a struct by DDL), or the fallback where the text is missing or malformed."""
    marked = f"{schema.rstrip().removesuffix('>')}, _corrupt:string>"
    parsed = F.from_json(text, marked, {"columnNameOfCorruptRecord": "_corrupt"})
    return F.when(parsed.isNotNull() & parsed["_corrupt"].isNull(), parsed.dropFields("_corrupt")).otherwise(fallback)


def read_json(spark: SparkSession, paths: str | list[str], schema: str, fallback: Column) -> DataFrame:
    """(path, document) of whole-file JSON documents."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return files.select("path", parse_json(F.col("value"), schema, fallback).alias("document"))


def read_tree(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, document) of whole-file JSON documents of any shape, as VARIANT; null where a file is no JSON."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return files.select("path", F.try_parse_json("value").alias("document"))


def next_request(queue: DataFrame) -> DataFrame:
    """The oldest request whose path is not blank, by key: (key, name, modified_ms, path)."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("modified_ms", "name"))
    usable = queue.where(F.length(F.trim(F.coalesce("path", F.lit("")))) > 0)
    return usable.withColumn("r", first).where("r = 1").drop("r")


def library(listing: DataFrame, keep: int = C.LIBRARY_ROWS) -> DataFrame:
    """The `keep` folders that changed last: (folder, modified, srt_files, more), `more` telling whether there are others. listing:
    folder, name, modified, linked (folders behind links are left out); a folder without files has a row with a null name."""
    srt = F.coalesce(F.lower("name").endswith(".srt"), F.lit(False))
    folders = listing.where(~F.col("linked")).groupBy("folder").agg(F.max("modified").alias("modified"), F.count_if(srt).alias("srt_files"))
    first = folders.orderBy(F.desc("modified"), "folder").limit(keep + 1)
    place = Window.orderBy(F.desc("modified"), "folder")  # keep + 1 rows
    placed = first.select("*", F.row_number().over(place).alias("place"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    return placed.where(F.col("place") <= keep).select("folder", "modified", "srt_files", (F.col("n") > keep).alias("more"))
