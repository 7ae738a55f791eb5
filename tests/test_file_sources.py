"""SRT files, WAV headers and fingerprints, read and written where they are."""

from __future__ import annotations

import hashlib
import json
import os
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.operators import identity, sinks
from cuelake.sources import binary, places, srt, srt_files, staged, term_store

CUES = "media_id string, cue_id int, start_ms long, end_ms long, text string"


def names(folder) -> dict[str, bytes]:
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*")) if p.is_file()}


PARTS = [
    "\n", "\n\n", "\r\n", "\r", " ", "1", "+2", "99999999999", "00:00:01,000 --> 00:00:02,000", "0:00:01.5 --> x", " 75:99:00.000-->1:00:00,001 tail", "text", "  two \u3000", "\ufeff", "\u2003\n",
    "1\n00:00:01,000 --> 00:00:02,000\nhi\n\n", "00:00:05,000 --> 00:00:06,000\n\u3000\n", "\t\n", "\x1c", "a\n\n\n\nb",
]


def test_files_are_read_as_whole_texts_are(spark, tmp_path):
    rng = random.Random(6)
    texts = {}
    for i in range(400):
        texts[f"{i:03}.srt"] = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        (tmp_path / f"{i:03}.srt").write_bytes(texts[f"{i:03}.srt"].encode())
    table = spark.createDataFrame(list(texts.items()), "media_id string, content string")
    want = sorted(map(tuple, srt.parse(table).collect()))
    got = sorted((r.media_id.rsplit("/", 1)[1], *r[1:]) for r in srt.read(spark, str(tmp_path)).collect())
    assert got == want and len(want) > 100


def test_srt_files_of_folders_and_lists(spark, tmp_path, monkeypatch):
    one = "1\n00:00:01,000 --> 00:00:02,000\nhi"
    for name in ("a/x.SRT", "a/b/y.srt", "a/notes.txt", "a/_staged/z.srt", "a/.hidden.srt", "c.srt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(one)
    read = lambda paths: sorted(os.path.relpath(r.media_id.removeprefix("file://"), tmp_path) for r in srt.read(spark, paths).collect())
    assert read(str(tmp_path / "a")) == ["a/b/y.srt", "a/x.SRT"]
    assert read([str(tmp_path / "a"), f"file://{tmp_path}/c.srt"]) == ["a/b/y.srt", "a/x.SRT", "c.srt"]
    reader = srt_files.SrtReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(places, "PART_FILES", 2)
    assert [len(p.files) for p in reader.partitions()] == [2, 1]
    with pytest.raises(FileNotFoundError):
        srt_files.SrtReader({"path": str(tmp_path / "none")}).partitions()


def test_a_long_file_is_read_cue_by_cue(tmp_path):
    with open(tmp_path / "long.srt", "w") as f:
        f.writelines(f"{i}\n00:00:01,000 --> 00:00:02,000\n{'x' * 90}\n\n" for i in range(200_000))
    import tracemalloc

    reader = srt_files.SrtReader({"path": str(tmp_path)})
    tracemalloc.start()
    n = sum(1 for part in reader.partitions() for _ in reader.read(part))
    assert n == 200_000 and tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_published_files_come_back(spark, tmp_path):
    rows = [(m, i, 1000 * i, 1000 * i + 500, f" {m} line {i}\nsecond ") for m in ("a", "b:c", "d") for i in range(1, 40)]
    cues = spark.createDataFrame(rows, CUES).repartition(7)
    out = tmp_path / "out"
    sinks.publish(cues, str(out))
    assert sorted(names(out)) == ["a.srt", "b_c.srt", "d.srt"]
    assert names(out)["a.srt"].decode() == sinks.render(cues.where("media_id = 'a'")).first().content
    back = srt.read(spark, str(out)).where(F.endswith("media_id", F.lit("/d.srt"))).orderBy("cue_id").collect()
    assert [(r.cue_id, r.start_ms, r.end_ms, r.text) for r in back] == [(i, s, e, t.strip()) for m, i, s, e, t in rows if m == "d"]
    sinks.publish(cues.where("media_id = 'a' and cue_id < 3"), str(out))
    assert sorted(names(out)) == ["a.srt", "b_c.srt", "d.srt"] and len(names(out)["a.srt"]) < 200
    sinks.publish(cues.where("media_id = 'd'"), str(out), overwrite=True)
    assert sorted(names(out)) == ["d.srt"]


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "out"
    cues = spark.createDataFrame([(f"m{i}", 1, 0, 10, "first") for i in range(20)], CUES)
    sinks.publish(cues, str(out))
    before = names(out)

    def broken(batches):
        for b in batches:
            if "m7" in b.column("media_id").to_pylist():
                raise RuntimeError("the executor's disk is full")
            yield b

    second = cues.withColumn("text", F.lit("second")).repartition(8, "media_id").mapInArrow(broken, CUES)
    srt_files.register(spark)
    with pytest.raises(Exception, match="disk is full"):
        second.write.format("srt").mode("append").save(str(out))
    assert names(out) == before
    split = cues.union(cues.withColumn("cue_id", F.lit(2))).repartition(5, "cue_id").sortWithinPartitions("media_id")
    with pytest.raises(Exception, match="several tasks"):
        split.coalesce(5).write.format("srt").mode("overwrite").save(str(out))
    assert names(out) == before


def batch(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(("media_id", "cue_id", "start_ms", "end_ms", "text"), r, strict=True)) for r in rows])


def test_rows_of_a_file_come_together(tmp_path):
    writer = srt_files.SrtWriter({"path": str(tmp_path)}, False)
    with pytest.raises(ValueError, match="one after the other"):
        writer.write(iter([batch(("a", 1, 0, 1, "x"), ("b", 1, 0, 1, "x"), ("a", 2, 0, 1, "x"))]))
    writer.abort([None])
    assert names(tmp_path) == {}


def test_a_commit_that_was_cut_off_is_ended(tmp_path, monkeypatch):
    (tmp_path / "old.srt").write_text("old")
    writer = srt_files.SrtWriter({"path": str(tmp_path)}, True)
    messages = [writer.write(iter([batch(("a", 1, 0, 1, "x"), ("b", 1, 0, 1, "y"))])), writer.write(iter([batch(("c", 1, 0, 1, "z"))])), None]
    left = srt_files.SrtWriter({"path": str(tmp_path)}, False)
    left.write(iter([batch(("never", 1, 0, 1, "x"))]))
    with monkeypatch.context() as m:
        m.setattr(staged, "_finish", lambda system, root, staged, moves, gone: system.move(f"{root}/{moves[0][0]}", f"{root}/{moves[0][1]}"))
        writer.commit(messages)  # the driver is lost after one move
    assert {"a.srt", "old.srt"} <= set(names(tmp_path)) and "b.srt" not in names(tmp_path)
    assert staged.recover(str(tmp_path)) == 1
    assert sorted(names(tmp_path)) == ["a.srt", "b.srt", "c.srt"]
    assert staged.recover(str(tmp_path)) == 0 and not (tmp_path / "_staged").exists()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_digests_are_those_of_whole_arrays(spark, kind):
    rows = [(m, i, 10 * i, 10 * i + 5, None if i % 7 == 0 else f"t{i}") for m in (1, 2, 3) for i in range(1, 30)]
    cues = spark.createDataFrame(rows, "media_id long, cue_id int, start_ms long, end_ms long, text string").withColumn("media_id", F.col("media_id").cast(kind)).repartition(5)
    line = lambda r: "|".join(map(str, (v for v in r[1:] if v is not None)))
    want = {str(m): hashlib.sha256("\n".join(line(r) for r in rows if r[0] == m).encode()).hexdigest() for m in (1, 2, 3)}
    assert {str(r.media_id): r.digest for r in identity.cue_digest(cues).collect()} == want


# Term lists

TERMS = "media_id string, ord int, source string, target string, variants array<string>"


def test_term_lists_are_stored_and_loaded(spark, tmp_path):
    rows = [("a", 2, "ヨシ", "吉", ["ヨ", "シ"]), ("a", 1, 'Ann "x"', "安", []), ("b/c %2F", 5, "b", "B", None), ("d", 1, None, "y", ["q"])]
    out = tmp_path / "terms"
    term_store.save(spark.createDataFrame(rows, TERMS).repartition(3), str(out), "ja")
    assert sorted(names(out)) == ["a/term-index.json", "b%2Fc %252F/term-index.json", "d/term-index.json"]
    assert json.loads(names(out)["a/term-index.json"]) == {"Version": "1", "SourceLanguage": "ja", "Entries": [{"Source": 'Ann "x"', "Target": "安", "Variants": []}, {"Source": "ヨシ", "Target": "吉", "Variants": ["ヨ", "シ"]}]}
    got = sorted(map(tuple, term_store.load(spark, str(out)).collect()))
    assert got == [("a", 0, 'Ann "x"', "安", []), ("a", 1, "ヨシ", "吉", ["ヨ", "シ"]), ("b/c %2F", 0, "b", "B", []), ("d", 0, None, "y", ["q"])]
    term_store.save(spark.createDataFrame([("a", 1, "new", "n", [])], TERMS), str(out), "en")
    (out / "e").mkdir()
    (out / "e" / "term-index.json").write_text("{broken")
    (out / "f").mkdir()
    (out / "f" / "term-index.json").write_text('{"Entries": null}')
    loaded = term_store.load(spark, str(out))
    assert sorted((r.media_id, r.source or "") for r in loaded.collect()) == [("a", "new"), ("b/c %2F", "b"), ("d", "")]
    media = spark.createDataFrame([(m,) for m in ("a", "e", "f", "g")], "media_id string")
    assert sorted(r.media_id for r in term_store.missing(media, loaded).collect()) == ["e", "f", "g"]


# WAV headers and fingerprints


def wav(data: bytes, odd: bytes = b"") -> bytes:
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    extra = b"LIST" + struct.pack("<I", len(odd)) + odd + b"\0" * (len(odd) % 2) if odd else b""
    body = b"WAVE" + head + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body



def test_wav_headers(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(bytes(4000), b"odd"))
    (tmp_path / "b.WAV").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "c.wav").write_bytes(wav(bytes(4000)) + b"data" + struct.pack("<I", 4000))
    (tmp_path / "d.wav").write_bytes(b"")
    (tmp_path / "e.wav").write_bytes(wav(b""))
    (tmp_path / "f.mp3").write_bytes(wav(bytes(8)))
    got = {r.path.rsplit("/", 1)[1]: r.seconds for r in binary.read_wav(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 0.5, "b.WAV": None, "c.wav": 1.0, "d.wav": None, "e.wav": None}


def test_files_beyond_two_gigabytes(spark, tmp_path):
    head = wav(bytes(16))
    with open(tmp_path / "big.wav", "wb") as f:  # a sparse file
        f.write(head[:40] + struct.pack("<I", 3_000_000_000))
        f.seek(3_000_000_044 - 1)
        f.write(b"x")
    assert binary.read_wav(spark, str(tmp_path)).first().seconds == 375_000
    n = 3_000_000_044
    digest = hashlib.sha256(identity.TAG.encode() + n.to_bytes(8, "little"))
    with open(tmp_path / "big.wav", "rb") as f:
        for i in range(9):
            f.seek(o := (n - 262_144) * i // 8)
            digest.update(o.to_bytes(8, "little") + f.read(262_144))
    got = binary.read_fingerprints(spark, str(tmp_path)).first()
    assert (got.size, got.fingerprint) == (n, digest.hexdigest())


def test_fingerprints_equal_those_of_columns(spark, tmp_path, monkeypatch):
    for name, n in (("a", 1), ("b", 10), ("c", 3_000_000)):
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("n"), identity.fingerprint(F.col("content")).alias("f"))
    got = {r.path.rsplit("/", 1)[1]: r.fingerprint for r in binary.read_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {r.n: r.f for r in whole.collect()} and len(got) == 3
