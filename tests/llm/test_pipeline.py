"""Each stage of the pipeline against brute force, on what the stage before it kept."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duck
from test_contracts import SF, removed, similar_by_pairs

import corpus_pipeline as cp
from cuelake.llm import mixing, toxicity
from cuelake.llm._base import crc_mod

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    copy = docs[7]["text"]
    docs += [{"doc_id": 10_000 + i, "text": t, "lang": "en", "source": "src2", "n_chars": len(t or "")} for i, t in enumerate([None, "", copy, copy + " end", "short one"])]
    table = pa.Table.from_pylist(docs)
    for clash in ("size", "taken", "target", "score", "packed", "n_words", "node"):
        table = table.append_column(clash, pa.array(["x"] * len(docs)))
    pq.write_table(table, out / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), out / "labels.parquet")
    frames = [spark.read.parquet(str(out / "documents.parquet"))]
    for name, stage in cp.STAGES:
        stage(spark, frames[-1], str(out)).write.parquet(str(out / name))
        frames.append(spark.read.parquet(str(out / name)))
    return str(out), [f.collect() for f in frames], frames


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(stages):
    _, _, frames = stages
    assert all(f.columns == frames[0].columns for f in frames[1:-1]) and frames[0].columns[:5] == COLUMNS


def test_toxic_documents_go(spark, stages):
    folder, rows, frames = stages
    model = toxicity.fit(frames[0], spark.read.parquet(f"{folder}/labels.parquet").where(crc_mod(4) != 2))
    keep = [r.doc_id for r in rows[0] if toxicity.Scorer(model).score([r.text])[0][0] < toxicity.THRESHOLD]
    assert sorted(r.doc_id for r in rows[1]) == sorted(keep)


def test_one_of_each_near_copy(stages):
    _, rows, _ = stages
    groups = similar_by_pairs(texts(rows[1]), cp.SHINGLE_WORDS, cp.NEAR_PERCENT)
    assert sorted(r.doc_id for r in rows[2]) == sorted(d for d, (_, lead) in groups.items() if d == lead)


def test_repeated_passages_are_cut(stages):
    _, rows, _ = stages
    before, after = texts(rows[2]), texts(rows[3])
    for d, (w, kept) in removed(before).items():
        assert after[d].split() == kept and (len(kept) < len(w) or after[d] == (before[d] or ""))
    assert all(r.n_chars == len(r.text) for r in rows[3])


def test_mix_takes_what_the_sql_says(stages):
    folder, rows, _ = stages
    sql = mixing.OP9_SQL.replace("FROM documents", f"FROM '{folder}/substrings/*.parquet'")
    want = {r.doc_id: r.taken // r.size_ for r in duck(SF, sql).rename(columns={"size": "size_"}).itertuples() if r.taken}
    assert Counter(r.doc_id for r in rows[4]) == want


def test_tokens_equal_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, rows, _ = stages
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    kept = texts(rows[4])
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    for r in rows[5]:
        ids = t.encode(kept[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    folder, rows, _ = stages
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, folder).collect()) == sorted((r.doc_id, r.n_tokens) for r in rows[5])


def test_empty_and_repeated_tables(spark, tmp_path):
    docs, labels = pq.read_table(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/labels.parquet")
    for name, rows in (("empty", docs.slice(0, 0)), ("repeated", pa.concat_tables([docs.slice(0, 20), docs.slice(0, 20), docs.slice(5, 1)]))):
        folder = tmp_path / name
        folder.mkdir()
        pq.write_table(rows, folder / "documents.parquet")
        pq.write_table(labels, folder / "labels.parquet")
        got = cp.run(spark, str(folder)).collect()
        assert (len(got) == 0) == (name == "empty")
        ids = {r.doc_id for r in got}
        assert ids <= set(docs["doc_id"].to_pylist()[:20])
        for d in ids:
            assert len({(r.n_tokens, bytes(r.ids)) for r in got if r.doc_id == d}) == 1
