"""Language by plain calls of the compressor, and toxicity on the labels of the given tables."""

from __future__ import annotations

import random
import subprocess
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def plain_size(text: str, content: bytes) -> int:
    """Bytes of a text's blocks, each compressed by a compressor of its own."""
    import zstandard

    raw, total = text.lower().encode(), 0
    for at in range(0, len(raw), 1024):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(dict_data=dictionary, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        frame = one.compress(raw[at : at + 1024])
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame, max_output_size=1024) == raw[at : at + 1024]
        total += len(frame)
    return total


def test_languages_by_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    content = language.train(docs.where("doc_id % 3 > 0"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 29 = 0 and text is not null").collect()}
    texts |= {-1: "é", -2: "Ab" * 3000, -3: "1 2 3", -4: "", -5: None, -6: "und " * 256, -7: "ÄÖÜ ß " * 200}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(rows, content).collect()}
    assert len(got) == len(texts) > 30
    for d, t in texts.items():
        if not any(c.isalpha() for c in t or ""):
            assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
            continue
        sizes = {lang: plain_size(t, c) for lang, c in content.items()}
        best = min(sizes, key=lambda x: (sizes[x], x))
        rest = min(n for x, n in sizes.items() if x != best)
        assert (got[d].lang_pred, got[d].score) == (best, pytest.approx(1 - sizes[best] / rest)), d
        assert got[d].rejected == (1 - sizes[best] / rest < language.MARGIN)


def auc(pos, neg) -> float:
    return float(np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]))


@pytest.mark.parametrize("sf, recall, area", [("sf0.01", 0.6, 0.78), ("sf0.1", 0.9, 0.95)])
def test_toxicity_of_held_out_rows(spark, sf, recall, area):
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = toxicity.op8_toxicity(spark, folder).join(labels, "doc_id", "left").collect()
    assert sum(r.n_restored for r in rows) == 0  # these tables hold no disguised words
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([s >= toxicity.THRESHOLD for s in pos]) >= recall and auc(pos, neg) >= area
    assert np.mean([s >= toxicity.THRESHOLD for s in neg]) <= 0.02
    assert all(r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)


def test_disguised_words_of_labelled_rows_score_as_the_plain_ones(spark):
    """Words that mark toxic rows are disguised in texts of these tables; a text has to score as it does with the plain word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    assert {"idiot", "moron", "trash"} <= set(model.names)
    rng = random.Random(4)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where(F.length("text").between(200, 600)).orderBy("doc_id").limit(40).collect()]
    ways = [lambda w: w.replace("o", "0").replace("i", "1").replace("a", "@"), " ".join, ".".join, "\t".join, lambda w: w[:2] + w[1] * 3 + w[2:], lambda w: w[0] + w[1:-1].replace(w[2], "*", 1) + w[-1]]
    scorer, same = toxicity.Scorer(model), 0
    for text in clean:
        word, way = rng.choice(["idiot", "moron", "trash"]), rng.choice(ways)
        at = text.index(" ", 100)
        plain, hidden = (f"{text[:at]} {w}{text[at:]}" for w in (word, way(word)))
        scores, _ = scorer.score([plain, hidden, text])
        same += abs(scores[0] - scores[1]) < 0.02 and scores[0] > scores[2]
    assert same >= 36


def test_nothing_else_imports_the_subpackage():
    found = subprocess.run(["grep", "-rlE", r"cuelake\.llm|from \.llm|import llm", "cuelake", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all(f.startswith("cuelake/llm/") for f in found)
