from __future__ import annotations

import math
import struct
import time
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pytest
from test_contracts import removed, similar_by_pairs

from cuelake.llm import _base, bpe, language, license_scan, media, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, toxicity

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# Media


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00;"


def jpeg() -> bytes:
    part = lambda k, b: b"\xff" + bytes([k]) + struct.pack(">H", len(b) + 2) + b
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xC0, bytes(9)) + part(0xDA, bytes(6)) + b"scan" + b"\xff\xd9"


@pytest.mark.parametrize("kind", ["wav", "bmp", "png"])
def test_media_round_trip(kind):
    for text in ("", "x", "é" * 100, "z" * 64):
        _, payload = media.payload_of(text)
        blob = media.WRITERS[kind](payload)
        assert media.type_of(blob, media.media_in(blob)) == kind and media.samples(blob, kind) == payload


def places_by_search(blob: bytes) -> list[tuple[int, int, str, int]]:
    """Every place and format tried."""
    out, around = [], []
    for at in range(len(blob)):
        for kind, magic in media.MAGIC.items():
            if blob.startswith(magic, at) and (n := media.VALIDATORS[kind](blob, at)):
                around = [e for e in around if e > at]
                if not around or at + n <= around[-1]:
                    out.append((at, n, kind, len(around)))
                    around.append(at + n)
    return out


def test_media_are_found_wherever_they_are():
    rng = np.random.default_rng(11)
    parts = [w(bytes(rng.integers(0, 256, 64, dtype=np.uint8))) for w in media.WRITERS.values()] + [gif(), jpeg(), b"BM", b"RIFF", b"GIF8", b"\xff\xd8\xff", b"junk"]
    for _ in range(60):
        inside = b"".join(parts[i] for i in rng.integers(0, len(parts), 4))
        blob = media._write_wav(inside) + b"".join(parts[i] for i in rng.integers(0, len(parts), 3)) + media._write_wav(bytes(3), gif())
        assert media.media_in(blob) == places_by_search(blob)
    assert [(k, d) for _, _, k, d in media.media_in(media.WRITERS["pictured"](bytes(64)))] == [("wav", 0), ("bmp", 1)]


def test_carving_and_broken_media(spark):
    png, wav = media.WRITERS["png"](bytes(64)), media.WRITERS["wav"](bytes(64))
    mixed = b"junk BM RIFF" + png + b"GIF8" + gif() + jpeg() + wav + b"\x89PNG"
    assert [(k, n) for _, n, k, _ in media.media_in(mixed)] == [("png", len(png)), ("gif", len(gif())), ("jpeg", len(jpeg())), ("wav", len(wav))]
    broken = bytearray(png)
    broken[40] ^= 1
    assert media.media_in(bytes(broken)) == [] and media.media_in(None) == [] and media.media_in(wav[:-1]) == []
    around = media._write_wav(gif() + b"x")
    rows = [(1, mixed, "image/png", "a"), (2, png, "image/png", "b"), (3, None, None, "c"), (4, wav, "image/png", "d"), (5, around, "audio/wav", "e"), (6, gif(), None, "f"), (7, jpeg(), None, "g"), (8, b"", None, "h")]
    df = spark.createDataFrame(rows, "id long, media binary, declared_type string, found string")
    sniffed = media.sniff(df)
    kinds = {r.id: (r.media_type, r.type_wrong) for r in sniffed.collect()}
    assert kinds == {1: ("mixed", True), 2: ("png", False), 3: ("unknown", False), 4: ("wav", True), 5: ("wav", False), 6: ("gif", True), 7: ("jpeg", True), 8: ("unknown", False)}
    cut = [(r.id, bytes(r.carved), r.carved_type) for r in media.carve(sniffed).collect()]
    assert cut[0] == (1, png, "png") and len(cut) == 5 and (5, gif(), "gif") in cut
    read = {r.id: (r.payload_bytes, r.media_bytes) for r in media.features(sniffed).collect()}
    assert read[2] == (64, len(png)) and read[3] == (None, None) and read[6] == (None, len(gif())) and read[1][0] == 64 and read[8] == (None, 0)


def test_one_pass_equals_the_steps(spark):
    df = docs(spark, [(i, "word " * i) for i in range(40)] + [(99, None)])
    steps = {r.doc_id: r for r in media.features(media.sniff(media.store(df))).collect()}
    at_once = media.stored_and_read(df).collect()
    for r in at_once:
        assert all(r[c] == steps[r.doc_id][c] for c in r.asDict() if c not in ("n_carved", "carved_crc32"))
    assert {r.media_type for r in at_once} == {"wav", "bmp", "png", "mixed"} and {r.n_carved for r in at_once} == {0, 1}


# Language


def test_language_without_training_and_margin(spark):
    df = docs(spark, [(1, "hello there"), (2, None), (3, "123"), (4, "")])
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    content = {"a": b"the and of with that " * 50, "b": b"der die das und nicht " * 50}
    got = {r.doc_id: r for r in language.identify(docs(spark, [(1, "THE and of WITH that the and of with"), (2, "der die das und nicht der die"), (3, "1 2")]), content).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("a", "b", "und") and not got[1].rejected and got[3].rejected


def test_copies_train_once_and_lose_no_language(spark):
    rows = [("a", f"copied words {k}") for k in range(3) for _ in range(2000)]
    rows += [("b", "one text with many copies")] * 2500 + [("b", f"text of number {k}") for k in range(300)]
    rows += [("c", "Longer " * 200)]
    got = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(got["a"].decode().split("\n")) == [f"copied words {k}" for k in range(3)]
    lines = got["b"].decode().split("\n")
    assert len(lines) == len(set(lines)) == language.TRAIN_ROWS
    assert got["c"].decode() == "longer " * 200


def test_whole_texts_train(spark):
    rng = np.random.default_rng(12)
    same = " ".join(f"s{i}" for i in rng.integers(0, 50, 2000))
    rows = [(x, f"{same} {i} " + " ".join(f"{x}{j}" for j in rng.integers(0, 30, 400))) for x in ("ka", "lo") for i in range(12)]
    content = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert all(len(c) <= 1.1 * language.DICTIONARY_BYTES for c in content.values())
    got = language.identify(docs(spark, [(1, "ka3 ka17 ka9 ka22 ka1 ka25 ka13"), (2, "lo3 lo17 lo9 lo22 lo1 lo25 lo13")]), content)
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in got.collect()} == {1: ("ka", False), 2: ("lo", False)}  # these words come last


# Quality rules


def test_distance_bounds():
    p = np.array([[1.0, 0], [0, 4], [2, 2], [0, 0]])
    got = quality_rules.distance(p, np.array([3.0, 0]))
    assert got[0] == 0 and got[1] == 1 and 0 < got[2] < 1


def test_short_texts_are_not_judged(spark):
    m = quality_rules.measure(docs(spark, [(1, "a b c d e f g h i j k")]).selectExpr("*", "'en' as lang"))
    out = quality_rules.judge(m, quality_rules.references(m)).first()
    assert out.char_distance is None and out.kept


# Toxicity


def model(words):
    return toxicity._model(toxicity._log_probabilities(np.zeros((toxicity.CLASSES,) * 3), words), dict.fromkeys(words, 3.0), (-3.0, 1.0, 1.0, 1.0))


@pytest.mark.parametrize("hidden", ["m0r0n", "M0R0N", "m o r o n", "m.o.r.o.n", "moooron", "m*ron", "mor0n!", "w0r+hle55", "w-o-r-t-h-l-e-s-s"])
def test_hidden_words_are_restored(hidden):
    s = toxicity.Scorer(model(["moron", "worthless"]))
    plain, found = s.score([f"and the {hidden} was", "and the moon was", "", None])
    assert found[0] == 1 and found[1] == 0 and plain[0] > plain[1] == plain[2]
    assert ("moron" in s.restore(f"and the {hidden} was")) or ("worthless" in s.restore(f"and the {hidden} was"))
    assert s.restore("and the moon was") == "and the moon was" and s.restore(None) is None


@pytest.mark.parametrize(
    "hidden",
    ["a$$|ass", "(a$$!)|ass", "idi07|idiot", "idi0+|idiot", "idio+|idiot", "$#!t|shit", "455wipe|asswipe", "i***t|idiot", "as***pe|asswipe", "b1663r|bigger", "i  d  i  o  t|idiot",
     "a i d i o t|idiot", "y o u  i d i o t|idiot", "i d i o t s o|idiot", "i d 1 0 t|idiot", "i. d. i. o. t.|idiot", "i d i o t!|idiot", "iiidiot|idiot", "1diot|idiot", "idiott|idiot", "iddiot|idiot", "i\td\ti\to\tt|idiot", "i\nd\ni\no\nt|idiot",
     "i\r\nd\r\ni\r\no\r\nt|idiot", "i\t d\ni o t|idiot"],
)
def test_families_of_disguise_reach_the_search(hidden):
    hidden, word = hidden.split("|")
    s = toxicity.Scorer(model(["idiot", "ass", "shit", "asswipe", "bigger"]))
    for text in (hidden, f"and\n{hidden}\nwas", f"and all {hidden}"):
        assert s.score([text, "an ass! idiot."])[1].tolist() == [1, 0], text
        assert word in s.restore(text)
    plain = "it is (his) idiot! 'ass' a b c - d e. f* #g 10% x" + "=" * 5000 + "y1"
    assert s.restore(plain) == plain


def test_decoration_and_other_styles():
    s = toxicity.Scorer(model(["idiot", "thingon", "inining"]))
    for text in ("thin*** and inin*** of idio* or *diot **diot", "th** i*", "a**", "idiot", "i d i o *", "* d i o t"):
        assert s.restore(text) == text and s.score([text])[1].tolist() == [0]
    styled = "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    wide = "".join(chr(0xFF41 + ord(c) - 97) for c in "idiot")
    scores, found = s.score([f"an {styled}!", f"an {wide}!", "an idiot!", "an " + chr(0x10330) * 5 + "!", "an abcde!", f"{styled[:2]}1{styled[3:]}"[:2] + "!ot"])
    assert scores[0] == scores[1] == scores[2] > scores[3] == scores[4] and found[:5].tolist() == [0] * 5
    letters = "i\nd\ni".split("\n")
    assert s.score(["\n".join(letters), "o\nt"])[1].tolist() == [0, 0]  # no word reaches from one text into the next


def test_chance_makes_no_lexicon():
    assert toxicity._by_chance(3, 3, 0.12) > math.log(0.05 / 4000) > toxicity._by_chance(15, 15, 0.12)
    assert toxicity._by_chance(1, 10, 0.12) == 0.0
    for a, b, p in ((5, 9, 0.2), (12, 12, 0.4), (7, 30, 0.1)):
        tail = sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(a, b + 1))
        assert math.exp(toxicity._by_chance(a, b, p)) >= tail - 1e-12


@pytest.mark.parametrize(
    "disguise",
    [lambda w: w.replace("o", "0").replace("i", "1").replace("e", "3").replace("s", "5"), " ".join, ".".join, "-".join, "  ".join, "\n".join, "\t".join,
     lambda w: w.replace(w[2], w[2] * 4, 1), lambda w: w[:2] + w[1] + w[2:], lambda w: w[:2] + "." + w[2:], lambda w: w[:1] + w[1:-1].replace(w[2], "*", 1) + w[-1:],
     lambda w: " ".join(w.replace("o", "0").replace("i", "!"))],
)
def test_families_with_a_lexicon_of_words(disguise):
    words = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
    counts = np.zeros((toxicity.CLASSES,) * 3)
    for w in "the and that with from this thing another house street people loose classes moose trust scale cloud".split():
        k = [0, 0, *(toxicity._CLASS[c] for c in w), 0]
        for i in range(len(k) - 2):
            counts[k[i], k[i + 1], k[i + 2]] += 100
    s = toxicity.Scorer(toxicity._model(toxicity._log_probabilities(counts, words), dict.fromkeys(words, 3.0), (-3.0, 1.0, 1.0, 1.0)))
    found = [w in s.restore(f"so the {disguise(w)} was there") for w in words if disguise(w) != w]
    assert sum(found) >= len(found) - 1


def paths(token: str, trigrams) -> dict[str, float]:
    """The least cost of every word that the channel can make a token of, by enumeration."""
    kinds = {c: i + 1 for i, c in enumerate(toxicity.ALPHABET)}
    ends = {"": 0.0}
    for c, long in zip(token, toxicity.drawn_out(token), strict=True):
        moves, drop = toxicity.channel(c)
        step: dict[str, float] = {}
        for word, cost in ends.items():
            told = [(word + x, price) for x, price in moves]
            told += [(word, price + long) for x, price in moves if long and word.endswith(x)]
            told += [(word, drop)] if drop is not None else []
            for w, price in told:
                step[w] = min(step.get(w, 1e9), cost + price)
        ends = step
    out = {}
    for word, cost in ends.items():
        k = [0, 0, *(kinds.get(x, toxicity.OTHER) if x.isalpha() else 0 for x in word), 0]
        out[word] = cost - sum(float(trigrams[k[i], k[i + 1], k[i + 2]]) for i in range(len(k) - 2))
    return out


def test_search_equals_enumeration():
    rng = np.random.default_rng(13)
    trigrams = toxicity._log_probabilities(rng.integers(0, 40, (toxicity.CLASSES,) * 3).astype(float), ["idiot", "moron", "loser"])
    for _ in range(150):
        token = "".join(rng.choice(list("abidot01!|.-$*o"), rng.integers(1, 7)))
        token = token.replace("*", "x", max(token.count("*") - 1, 0)) + ("ooo" if rng.random() < 0.3 else "")
        costs = paths(token, trigrams)
        assert costs[toxicity.restore_word(token, trigrams)] == pytest.approx(min(costs.values()), abs=1e-4), token


def leet(rng, word: str) -> str:
    """A word in one of the usual disguises."""
    swap = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "$5", "t": "7+", "l": "1", "b": "8", "g": "9"}
    way = rng.integers(0, 4)
    if way == 0 and any(c in swap for c in word):
        return "".join(rng.choice(list(swap[c])) if c in swap else c for c in word)
    if way == 1:
        return " ".join(word)
    if way == 2:
        return word[0] * 4 + word[1:]
    return word[0] + "*" + word[2:] if way == 3 else ".".join(word)


def test_disguised_words_of_held_out_rows_are_caught(spark):
    """Toxic words that training shows plainly are disguised in rows that it has not seen."""
    rng = np.random.default_rng(14)
    bad, plain = ["idiot", "moron", "loser", "stupid", "pathetic", "worthless"], [f"{a}{b}{c}" for a in "bcdfg" for b in ("amo", "ile", "unt") for c in "nrs"]
    rows, toxic = [], {}
    for i in range(600):
        words, toxic[i] = list(rng.choice(plain, 30)), int(i % 3 == 0)
        if toxic[i]:
            for word in rng.choice(bad, 2, replace=False):
                words.insert(int(rng.integers(0, 30)), leet(rng, word) if i >= 300 else word)
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), labels)).where("doc_id >= 300").collect()
    caught = [r.score >= toxicity.THRESHOLD for r in out if toxic[r.doc_id]]
    clean = [r.score < toxicity.THRESHOLD for r in out if not toxic[r.doc_id]]
    assert np.mean(caught) >= 0.9 and np.mean(clean) >= 0.99
    assert sum(r.n_restored for r in out if toxic[r.doc_id]) > 150 and not any(r.n_restored for r in out if not toxic[r.doc_id])


def test_rows_of_one_text_teach_once(spark):
    d = docs(spark, [(1, "same"), (2, "same"), (3, "same"), (4, "other"), (5, "other"), (6, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1)], "doc_id long, toxic int")
    curve = {toxicity.fit(d.repartition(n), labels).curve for n in (1, 3, 7)}
    assert len(curve) == 1


def test_more_bad_words_never_lower_the_score():
    x = np.random.default_rng(1).random((200, 3))
    x[:, 1] = x[:, 0] * 2 + 0.01
    c = toxicity._logistic(x, (x[:, 0] - x[:, 2] > 0).astype(float))
    assert all(v >= 0 for v in c[1:]) and c[1] + c[2] > 0


def test_one_kind_of_labels(spark):
    d = docs(spark, [(i, f"text number {i}") for i in range(5)])
    labels = spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, labels)).collect()} == {0.0}


# Quality classifier


def test_no_labels_mean_half(spark):
    d = docs(spark, [(1, "a"), (2, None)])
    m = quality_classifier.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality_classifier.score(d, m).collect()] == [0.5, 0.5]


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    m = quality_classifier.Model(np.eye(quality_classifier.FEATURES, 8, dtype=np.float32), quality_classifier.unit(rng.normal(size=(60, 8)).astype(np.float32)), (rng.random(60) > 0.4).astype(np.float32), 0.5)
    x = np.zeros((20, quality_classifier.FEATURES), np.float32)
    x[:, :8] = rng.normal(size=(20, 8))
    cosine = quality_classifier.unit(x @ m.projection) @ m.vectors.T
    for row, got in zip(cosine, quality_classifier.vote(m, x), strict=True):
        near = np.argsort(-row)[: quality_classifier.NEIGHBOURS]
        w = np.maximum(row[near], 0)
        assert got == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-5)


def test_equal_similarities_go_by_order():
    rng = np.random.default_rng(5)
    for _ in range(20):
        cosine = rng.integers(-3, 4, (7, 30)).astype(np.float32) / 4
        for k in (1, 5, 30):
            want = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            assert (np.sort(quality_classifier.nearest(cosine, k), axis=1) == np.sort(want, axis=1)).all()


def test_repeated_ids_fit_alike(spark):
    rows = [(i % 5, f"text {i} " * (i + 1)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    models = [quality_classifier.fit(docs(spark, rows).repartition(n), labels, rows=12) for n in (1, 4)]
    assert np.allclose(models[0].vectors, models[1].vectors) and (models[0].labels == models[1].labels).all() and len(models[0].labels) == 12


# BPE


def test_every_settled_character_is_split_as_the_library_does():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, v = Tokenizer.from_file(path), bpe.vocabulary(path)
    new = 0
    for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 37)]:
        text = f"a{chr(c)}b {chr(c)}{chr(c)}\u0301"
        settled = not bpe.unsettled().search(text)
        new += not settled
        if settled or c % 16 == 0:
            assert [i for w in v.words(text) for i in v.merge(w)] == library.encode(text, add_special_tokens=False).ids, hex(c)
    assert new > 10_000


def test_transducer_finds_its_words_and_no_other(tmp_path):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abcé"), rng.integers(1, 7))): [int(i) for i in rng.integers(0, 9, rng.integers(1, 4))] for _ in range(400)}
    arrays = bpe.compile_lexicon(words)
    (tmp_path / "x").write_bytes(bpe.pack(arrays))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    others = ["".join(rng.choice(list("abcéd"), rng.integers(1, 8))) for _ in range(400)] + [""]
    for w, found in zip([*words, *others], lexicon.find([*words, *others]), strict=True):
        assert (None if found is None else np.frombuffer(found, np.uint32).tolist()) == words.get(w)
    plain = sum(len(w.encode()) for w in words)
    assert len(arrays["final"]) < plain / 4  # states are shared


def test_long_pretokens_merge_alike():
    v = bpe.vocabulary(bpe.vocabulary_path())
    for w in ("a" * 700, "ab" * 400, "%" * 513, "the" * 200):
        short = bpe.LONG_WORD
        try:
            bpe.LONG_WORD = 10**9
            one_by_one = v.merge(w)
        finally:
            bpe.LONG_WORD = short
        assert v.merge(w) == one_by_one


# Near duplicates and substrings


def words(rng, n, vocabulary=40):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def near_copies(seed=2, bases=6, copies=12):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(bases):
        base = words(rng, int(rng.integers(20, 160)), 400).split()
        for _ in range(copies):
            one = list(base)
            for _ in range(int(rng.integers(0, 5))):
                one[int(rng.integers(0, len(one)))] = f"x{rng.integers(0, 5)}"
            rows.append((len(rows), " ".join(one)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_similar_equals_all_pairs(spark, k, percent):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs(spark, rows).repartition(5), k, percent).collect()}
    assert got == similar_by_pairs(dict(rows), k, percent)


def test_similar_with_common_shingles_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_SETS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    rows = near_copies(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs(spark, rows), 4, 85).collect()}
    assert got == similar_by_pairs(dict(rows), 4, 85)


def test_one_of_each_keeps_all_columns(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words are in here", None), (4, None, "z"), (1, "a b c d e f", "y")]
    out = ngram_join.one_of_each(docs(spark, rows, "doc_id long, text string, label string"), 5, 80)
    assert sorted((r.doc_id, r.label) for r in out.collect()) == [(1, "y"), (2, None), (4, "z")]
    rows = [(1, "a b c d e f", x) for x in ("q", "p", "s")] + [(1, "a b c d e f", None)] * 2
    for n in (1, 4):
        assert [r.label for r in ngram_join.one_of_each(docs(spark, rows[:3], "doc_id long, text string, label string").repartition(n)).collect()] == ["p"]
        assert [r.label for r in ngram_join.one_of_each(docs(spark, rows, "doc_id long, text string, label string").repartition(n)).collect()] == [None]


@pytest.mark.parametrize("block", [2, 3, 256])
def test_similar_with_tiles_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "TILE_BLOCK", block)
    rows = near_copies(6, 5, 16)
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "a b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs(spark, rows), 4, 85).collect()}
    assert got == similar_by_pairs(dict(rows), 4, 85)


def test_scratch_tables_go(spark, tmp_path):
    df = docs(spark, [(1, "a")])
    with _base.scratch(spark):
        inner = _base.staged(df, "inner").inputFiles()[0]
        with _base.scratch(spark):
            late = _base.staged(df, "late", outlives=True)
        kept = _base.staged(df, "kept", outlives=True)
        assert late.count() == 1
    assert not Path(unquote(urlparse(inner).path)).exists() and kept.count() == 1
    _base.discard(kept)
    assert not Path(unquote(urlparse(kept.inputFiles()[0]).path)).exists()


def test_signature_bound_is_safe():
    rng = np.random.default_rng(4)
    for n in (3, 60, 900, 9000):
        x, y = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate((x[: int(n * 0.9)], y[: n // 10])))
        a, b = (np.unpackbits(v) for v in ngram_join.folded([ngram_join.signature(x), ngram_join.signature(y)]))
        assert (a > b).sum() <= len(np.setdiff1d(x, y)) and (b > a).sum() <= len(np.setdiff1d(y, x))


@pytest.mark.parametrize("seed", range(4))
def test_substrings_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 300)  # many segments
    rng = np.random.default_rng(seed)
    passages = [words(rng, int(rng.integers(18, 60)), 30) for _ in range(5)]
    rows = []
    for d in range(50):
        parts = [passages[int(rng.integers(0, 5))] if rng.random() < 0.4 else words(rng, int(rng.integers(0, 40)), 30) for _ in range(4)]
        rows.append((d, " ".join(parts)))
    rows += [(100, "a " * 100), (101, None), (102, ""), (103, rows[3][1])]
    out = {r.doc_id: r for r in substring_dedup.remove(docs(spark, rows).repartition(4)).collect()}
    for d, (w, kept) in removed(dict(rows)).items():
        assert (out[d].n_words, out[d].n_removed) == (len(w), len(w) - len(kept))
        assert out[d].text.split() == kept


def test_lines_and_spaces_stay_around_cuts():
    text = "a  b\n\tc d e\n\nf g \n"
    assert substring_dedup.without(text, [(2, 2, 0, 0)]) == ("a  b\n\te\n\nf g \n", 7, 2)
    assert substring_dedup.without(text, [(0, 2, 0, 0), (1, 2, 9, 0), (5, 2, 0, 0)]) == ("d e\n\n \n", 7, 5)
    assert substring_dedup.without(text, []) == (text, 7, 0) and substring_dedup.without("", []) == ("", 0, 0)


def test_seals_are_checked_against_the_text():
    text = " ".join(f"w{i}" for i in range(30))
    hashes = substring_dedup.sealed(substring_dedup._hashed(pa.record_batch({"text": [text]}))[0])
    seal = substring_dedup.span_hashes(hashes, np.array([2]), np.array([24])).view(np.int64)[0]
    for value, want in ((seal, [(2, 22, 7, 5)]), (seal + 1, [])):
        run = {"pos": 2, "len": 3, "seal": int(value), "ref_id": 7, "ref_tx": 1, "ref_pos": 5}
        batch = pa.record_batch({"text": [text, None], "_runs": pa.array([[run], None])})
        assert substring_dedup.parsed(batch) == [want, []]


@pytest.mark.parametrize("rows", [1, 3, 500])
def test_keys_that_span_batches(spark, rows, monkeypatch):
    """The same results, however the sorted rows are cut into batches."""
    monkeypatch.setattr(substring_dedup, "SEGMENT", 200)
    monkeypatch.setattr(substring_dedup, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)))
    rng = np.random.default_rng(3)
    passage = words(rng, 60, 10_000)
    data = [(d, f"{words(rng, int(rng.integers(0, 12)), 10_000)} {passage} {words(rng, 5, 10_000)}") for d in range(40)]
    out = {r.doc_id: r for r in substring_dedup.remove(docs(spark, data).repartition(3)).collect()}
    for d, (w, kept) in removed(dict(data)).items():
        assert (out[d].n_words, out[d].text.split()) == (len(w), kept)


def test_factors_point_at_equal_words(spark):
    rng = np.random.default_rng(9)
    shared = words(rng, 50, 10_000)
    rows = [(1, f"x y {shared} z"), (2, f"q {shared}"), (3, words(rng, 60, 10_000))]
    text = {d: t.split() for d, t in rows}
    for r in substring_dedup.spans(docs(spark, rows)).collect():
        for f in r.factors:
            assert text[r.doc_id][f.start : f.start + f.words] == text[f.ref_id][f.ref_pos : f.ref_pos + f.words] and f.words >= 20
    assert [(f.start, f.words, f.ref_id, f.ref_pos) for f in substring_dedup.spans(docs(spark, rows)).where("doc_id = 2").first().factors] == [(1, 50, 1, 2)]


# Mixing


def test_targets_are_filled_by_weight():
    t = mixing.targets_of({"a": 100, "b": 10, "c": 10, None: 0}, mixing.weights_of(["a", "b", "c", None]))
    assert t[None] == 0 and t["b"] == 30 and t["a"] + t["b"] + t["c"] == pytest.approx(120) and all(t[s] <= 3 * n + 1e-9 for s, n in (("a", 100), ("b", 10), ("c", 10)))


def test_flow_prefers_first_copies():
    flow = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 12.0, "b": 18.0})
    passed = {p: sum(f for (q, _), f in flow.items() if q == p) for p in [("a",), ("a", "b"), ("b",)]}
    assert passed == {("a",): 10, ("a", "b"): 10, ("b",): 10}


def cheapest(patterns, quotas, most):
    """Words passed and their cost by successive cheapest paths, word by word."""
    copies = {p: 0 for p, _ in patterns}
    size, held = dict(patterns), {(p, s): 0 for p, _ in patterns for s in p}
    room, passed, cost = dict(quotas), 0, 0
    while True:
        for _, p in sorted((copies[p] // size[p], p) for p in copies if size[p] and copies[p] < most * size[p]):
            way, seen = [[(p, s)] for s in p], set(p)
            while way:
                path = way.pop(0)
                s = path[-1][1]
                if room[s]:
                    break
                for q in copies:
                    if s in q and held[q, s]:
                        for t in q:
                            if t not in seen:
                                seen.add(t)
                                way.append([*path, (q, t, s)])
            else:
                continue
            cost += (copies[p] // size[p]) ** 2
            copies[p] += 1
            for q, t, *was in path:
                held[q, t] += 1
                for u in was:
                    held[q, u] -= 1
            room[path[-1][1]] -= 1
            passed += 1
            break
        else:
            return passed, cost


def test_flow_is_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sources = "abcd"[: rng.integers(1, 5)]
        made = {tuple(sorted(set(rng.choice(list(sources), rng.integers(1, 4))))): int(rng.integers(0, 7)) for _ in range(5)}
        patterns, quotas = sorted(made.items()), {s: int(rng.integers(0, 15)) for s in sources}
        flow = mixing.route(patterns, quotas)
        given = {p: sum(f for (q, _), f in flow.items() if q == p) for p, _ in patterns}
        assert all(sum(f for (_, s), f in flow.items() if s == t) <= quotas[t] for t in sources) and all(s in p for p, s in flow)
        assert all(given[p] <= 3 * n for p, n in patterns)
        cost = sum(sum(k * k * min(n, max(0, given[p] - k * n)) for k in range(3)) for p, n in patterns)
        assert (sum(given.values()), cost) == cheapest(patterns, quotas, 3)


def test_flow_of_many_linked_patterns():
    rng = np.random.default_rng(6)
    patterns = sorted({tuple(sorted(set(rng.integers(0, 200, 4).tolist()))): int(rng.integers(1, 10_000)) for _ in range(100_000)}.items())
    quotas = dict.fromkeys(range(200), sum(n for _, n in patterns) / 200)
    began = time.process_time()
    flow = mixing.route(patterns, quotas)
    assert time.process_time() - began < 60
    assert sum(flow.values()) == pytest.approx(sum(n for _, n in patterns), rel=1e-4) and len(patterns) > 99_000


def test_only_staged_tables_are_discarded(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError, match="not staged"):
        _base.discard(spark.read.parquet(str(tmp_path / "mine")))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 5
    table = _base.staged(spark.range(5), "short")
    _base.discard(table)
    assert not Path(urlparse(table.inputFiles()[0]).path).exists()


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 3), [["a"], ["a", "b"], ["b", None]][i % 3]) for i in range(60)]
    df = docs(spark, rows, "doc_id long, text string, tags array<string>")
    out = mixing.mix(mixing.with_size(df), "tags").collect()
    assert len(out) == 60 and sum(r.taken for r in out) == pytest.approx(sum(r["size"] for r in out), rel=0.1)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(mixing.with_size(df), "tags").collect()))


# Licenses


def test_license_with_words_put_in_and_left_out(spark):
    text = license_scan.TEMPLATES[3].text.split()
    changed = [*text[:8], "really", *text[8:14], *text[15:]]
    rows = [(1, " ".join(text)), (2, "x y " + " ".join(changed)), (3, " ".join(text[:6])), (4, "the MIT\nLicense. MIT license"), (5, None)]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base) == ("mit", 1.0, 0)
    assert got[2].labels == "mit" and 0.6 < got[2].score < 1 and got[2].n_spans == 1
    assert got[3].labels == "" and (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 1, 3) and got[5].n_words == 0


def test_short_licenses_must_be_there_as_they_are(spark):
    rows = [(1, "Licensed under CC BY 4.0."), (2, "licensed under CC BY-SA 4.0"), (3, "Licensed under CC BY-NC 4.0"), (4, "licensed under cc by"), (5, "Creative Commons Attribution-ShareAlike"), (6, "licensed under a creative")]
    got = {r.doc_id: r.labels for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {1: "cc-by", 2: "cc-by-sa", 3: "cc-by-nc", 4: "", 5: "cc-by-sa", 6: ""}


def test_verdict_by_brute_force(spark):
    """Distances and verdicts of the quality rules, from counts of characters and words in plain Python."""
    rng = np.random.default_rng(8)
    frequent = {"en": ["the", "and", "of", "was", "with"], "de": ["der", "und", "nicht", "ist", "die"]}
    rows = [(i, lang := ["en", "de"][i % 2], " ".join(rng.choice([*frequent[lang], "Some", "words,", "42"], 60))) for i in range(20)]
    rows += [(50, "en", " ".join(f"x{i}%" for i in range(60))), (51, None, rows[0][2].upper()), (52, "en", "short text")]
    text = {i: t for i, _, t in rows}

    def class_of(c: str) -> int:
        return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c in "0123456789" else 4 if c == " " else 5 if c in ".,;:!?" else 7 if c in quality_rules.SYMBOLS else 6

    chars = {i: Counter(map(class_of, t)) for i, t in text.items()}
    words = {i: Counter(w if (w := x.lower().strip(quality_rules.AROUND)) in quality_rules.COMMON_WORDS else "" for x in t.split()) for i, t in text.items()}

    def apart(a: Counter, b: Counter) -> float:
        p, q = ({k: n / x.total() for k, n in x.items()} for x in (a, b))
        part = sum(v * math.log2(2 * v / (v + q.get(k, 0))) for k, v in p.items() if v) + sum(v * math.log2(2 * v / (v + p.get(k, 0))) for k, v in q.items() if v)
        return math.sqrt(max(part / 2, 0))

    sums = {x: [sum((h[i] for i, lang, _ in rows if lang == x), Counter()) for h in (chars, words)] for x in ("de", "en")}
    measured = quality_rules.measure(docs(spark, rows, "doc_id long, lang string, text string"))
    for r in quality_rules.judge(measured, quality_rules.references(measured)).collect():
        if len(text[r.doc_id].split()) < quality_rules.JUDGED_WORDS or len(text[r.doc_id]) < quality_rules.JUDGED_CHARS:
            assert r.nearest is None and r.char_distance is None
            continue
        near = min(((apart(chars[r.doc_id], c), apart(words[r.doc_id], w), x) for x, (c, w) in sums.items()), key=lambda v: (v[0] + v[1], v[2]))
        assert (r.char_distance, r.word_distance) == pytest.approx(near[:2]) and r.nearest == near[2]
        assert r.kept == (not r.base_failed and near[0] <= quality_rules.MOST_CHAR_DISTANCE and near[1] <= quality_rules.MOST_WORD_DISTANCE)


def test_checksums_of_payload():
    assert zlib.crc32(media.payload_of(None)[1]) == zlib.crc32(bytes(64))


def test_decode_equals_decoding_while_encoding(spark):
    df = docs(spark, [(1, "Hello, the world's 42 <|endoftext|>"), (2, None), (3, "naïve café")])
    name = bpe.build_lexicon(df)
    both = bpe.encode(df, name, made=("ids", "decoded"))
    assert {r.doc_id: r.decoded for r in both.collect()} == {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, name)).collect()}
