"""External services behind an interface. Recognition and translation are not part of this library."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import compact_cue

RETRIES = 3
TOKENS, MORE_TOKENS = 4096, 8192


class Provider(Protocol):
    """A chat service: the response body for a request body. It is pickled to the executors."""

    def __call__(self, body: str, max_tokens: int) -> str: ...


class OutputLimit(Exception):
    """The answer was cut at max_tokens."""


def ask(provider: Provider, body: str, retries: int = RETRIES) -> tuple[str | None, str, int]:
    """(answer, status, tries). A cut answer is asked for once more with twice the tokens; other failures up to `retries`
    times. Waiting between tries (1 s times the square of the try) is left to the provider."""
    tries, tokens = 0, TOKENS
    while True:
        tries += 1
        try:
            return provider(body, tokens), "ok", tries
        except OutputLimit:
            if tokens >= MORE_TOKENS:
                return None, "output-limit", tries
            tokens = MORE_TOKENS
        except Exception:
            if tries >= retries:
                return None, "failed", tries


def call(requests: DataFrame, provider: Provider) -> DataFrame:
    """requests (request_id, body) with answer, status and tries; each partition asks for its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(provider, x) for x in b["body"]]
            yield pd.DataFrame({"request_id": b["request_id"], "answer": [g[0] for g in got], "status": [g[1] for g in got], "tries": [g[2] for g in got]})

    return requests.select("request_id", "body").mapInPandas(run, "request_id long, answer string, status string, tries int")


def unfinished(work: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """The work whose key (of one or more columns) is not done yet: what a rerun has to do."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def request_bodies(lines: DataFrame) -> DataFrame:
    """(request_id, body): a JSON request of each group of cues, their texts made short. lines: request_id, part (before, target
    or after), pos, cue_id, text."""
    row = F.struct("pos", F.struct(F.col("cue_id").alias("id"), compact_cue(F.col("text")).alias("text")).alias("cue"))
    cues = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, row))), lambda r: r["cue"]).alias(part)
    grouped = lines.groupBy("request_id").agg(cues("before"), cues("target"), cues("after"))  # one request's cues
    named = F.struct(F.col("before").alias("context_before"), F.col("target").alias("target_cues"), F.col("after").alias("context_after"))
    return grouped.select("request_id", F.to_json(named).alias("body"))
