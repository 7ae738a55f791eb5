"""BPE encoding and decoding with a transducer lexicon.

The corpus' frequent words are encoded once, and compiled into a minimal acyclic automaton: words share prefixes and
suffixes, and each arc's output adds up to the word's number, which leads to its token ids. The compiled arrays are one
file that every worker maps into memory. Words that it lacks are merged exactly by the vocabulary's ranks.

What is a letter and what its lower case differs between versions of Unicode. Texts whose characters were all there in
version 3.2 are alike to every later one and are split here; others are normalised and split by the vocabulary
file's own rules, as the tokenizers library carries them out.

Defined results: null and empty texts have no ids, and decode to the empty string; strings of added tokens in a text
become those tokens, as the tokenizers library does by default; an empty table makes an empty lexicon; a null list
of ids decodes to the empty string; repeated rows give repeated results; extra columns pass through, but one that has
the name of a result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.files import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, most_frequent, shared_dir, small_batches, staged
from ._words import chunks

#: Words of the lexicon, at most (the most frequent ones), and the occurrences that a word needs.
LEXICON_WORDS = 65_536
LEAST_COUNT = 3
#: Characters of a word of the lexicon, at most, which bounds what comes to the driver; longer words are merged each time.
WORD_CHARS = 64
#: Words whose ids a worker keeps at hand.
KEPT_WORDS = 60_000
#: Pairs of a pre-token from which on equal pairs are merged together.
LONG_WORD = 256


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@cache
def unsettled() -> re.Pattern[str]:
    """Finds a character that Unicode 3.2 had not."""
    old = unicodedata.ucd_3_2_0.category
    runs: list[list[int]] = []
    for c in range(0x10000):
        if old(chr(c)) not in ("Cn", "Cs"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]")


class Vocabulary:
    """A word-level BPE vocabulary file: pre-tokens, exact merges, and token strings by id."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalised, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(self.ids.items(), self.added.items())}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Printable stand-ins of the bytes: those that print stand for themselves, others follow from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in prints]
        self.stand_in = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_of = {c: b for b, c in self.stand_in.items()}

    def words(self, text: str | None) -> list[str]:
        """The text's pre-tokens; an added token is one of its own."""
        if not text:
            return []
        out: list[str] = []
        for part in self.split_added.split(text) if "<|" in text else (text,):
            if part in self.added:
                out.append(part)
            elif part.isascii() or not unsettled().search(part):
                part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                out += self.pieces(part.replace("Σ", "σ").lower())
            else:
                out += (bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in self.split(self.normalised(part)))
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token by exact merging."""
        if word in self.added:
            return [self.added[word]]
        parts = [self.stand_in[b] for b in word.encode()]
        parts[-1] += self.end
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            if len(ranks) > LONG_WORD:  # merge all places of the pair in one go
                i, out = 0, []
                while i < len(parts):
                    if i < len(ranks) and ranks[i] == least:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts, ranks = out, [rank(p, none) for p in zip(out, out[1:], strict=False)]
                continue
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.ids[p] for p in parts]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# The transducer: arrays `key` (state * 256 + byte of each arc, sorted), `to` (its state), `skip` (words that sort before
# through it), `final` (by state), `start` (where a word's ids begin) and `ids`.
PARTS = (("key", np.int64), ("to", np.int32), ("skip", np.int32), ("final", np.uint8), ("start", np.int32), ("ids", np.uint32))


def compile_lexicon(entries: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer from words to their ids. Words are added in byte order; a state that can no longer
    grow is replaced by an equal one that is there already, so suffixes are shared."""
    words = sorted((w.encode(), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        if state not in register:
            register[state] = len(states)
            states.append(state)
        return register[state]

    path: list[list] = [[False, []]]  # open states along the last word: [final, arcs that are settled]
    last = b""
    for word, _ in [*words, (b"", None)]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[i - 1], settle(final, arcs)))
        for _ in word[same:]:
            path.append([False, []])
        if word:
            path[-1][0] = True
        last = word
    settle(*path[0])  # the root, settled last
    below = [0] * len(states)  # states are settled after those that they lead to
    for i, (final, arcs) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in arcs)
    rows = []
    for i, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, t in arcs:
            rows.append(((i + 1) % len(states), byte, t, before))
            before += below[t]
    # The root is numbered 0, all others one up.
    number = np.arange(1, len(states) + 1) % len(states)
    table = np.array([(s * 256 + b, number[t], k) for s, b, t, k in rows], np.int64).reshape(-1, 3)
    table = table[table[:, 0].argsort()]
    final = np.zeros(len(states), np.uint8)
    final[number] = [f for f, _ in states]
    lengths = [len(ids) for _, ids in words]
    arrays = (table[:, 0], table[:, 1], table[:, 2], final, np.cumsum([0, *lengths]), np.array([i for _, ids in words for i in ids]))
    return {name: a.astype(kind) for (name, kind), a in zip(PARTS, arrays, strict=True)}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    head = np.array([len(arrays[name]) for name, _ in PARTS], np.int64).tobytes()
    return head + b"".join(arrays[name].tobytes() + b"\0" * (-arrays[name].nbytes % 8) for name, _ in PARTS)


class Lexicon:
    """A compiled lexicon in memory-mapped form."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        counts, at = raw[: 8 * len(PARTS)].view(np.int64), 8 * len(PARTS)
        for (name, kind), n in zip(PARTS, counts, strict=True):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def find(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit integers, or None: all words walk the automaton together."""
        raw = [w.encode() for w in words]
        if not raw or not len(self.key):
            return [None] * len(raw)
        lengths = np.array([len(r) for r in raw])
        letters = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(lengths) - lengths
        state, number = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        alive = np.arange(len(raw))
        for i in range(int(lengths.max())):
            alive = alive[lengths[alive] > i]
            want = state[alive] * 256 + letters[first[alive] + i]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            state[alive[~hit]] = -1
            lengths[alive[~hit]] = 0  # lost
            alive, at = alive[hit], at[hit]
            number[alive] += self.skip[at]
            state[alive] = self.to[at]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        ids, start = self.ids, self.start
        return [ids[start[k] : start[k + 1]].tobytes() if ok else None for ok, k in zip(known, number, strict=True)]


@cache
def mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def frequent_words(df: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters in all texts, lower-cased; at most `words`."""
    every = df.select(F.explode(F.expr(f"regexp_extract_all(lower(`{text}`), '\\\\p{{L}}+', 0)")).alias("word"))
    counted = every.where(F.length("word") <= WORD_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return [r.word for r in most_frequent(staged(counted, "words"), "n", words).collect()]  # at most `words`


def _put(spark: SparkSession, data: bytes, name: str) -> str:
    """Write data to the shared folder, have Spark hand the file to every worker, and return its name."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(jvm.java.util.Base64.getDecoder().decode(base64.b64encode(data).decode()))
    out.close()
    spark.sparkContext.addFile(place.toString())
    return name


_shipped: dict[tuple[str, str], str] = {}


def shipped(spark: SparkSession, path: str | None) -> str:
    """The vocabulary file, read on the driver, under the name by which workers get it (once an application)."""
    path = path or vocabulary_path()
    key = (spark.sparkContext.applicationId, path)
    if key not in _shipped:
        _shipped[key] = _put(spark, Path(path).read_bytes(), f"vocabulary-{uuid.uuid4().hex}.json")
    return _shipped[key]


def build_lexicon(df: DataFrame, text: str = "text", path: str | None = None) -> str:
    """Compile the frequent words of df, put the file where all nodes can fetch it, and return its name."""
    vocab = vocabulary(path or vocabulary_path())
    data = pack(compile_lexicon({w: vocab.merge(w) for w in frequent_words(df, text)}))
    return _put(df.sparkSession, data, f"lexicon-{uuid.uuid4().hex}.bin")


def _added(df: DataFrame, source: str, added: list[T.StructField], maker) -> DataFrame:
    """df with more columns, made of the source column by maker()'s function from a list of values to a list a column."""
    keep = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*keep, *added])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, fn = to_arrow_schema(schema), maker()
        for b in batches:
            for c in chunks(b, source):
                columns = [c.column(c.schema.get_field_index(f.name)) for f in keep]
                made = fn(c.column(c.schema.get_field_index(source)).to_pylist())
                columns += [pa.array(v, arrow.field(a.name).type) for v, a in zip(made, added, strict=True)]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _decoder(vocab: Vocabulary):
    token = vocab.tokens.__getitem__
    return lambda values: [" ".join(map(token, np.frombuffer(v or b"", np.uint32).tolist())) for v in values]


# What `encode` can make of a text, with the type of each.
MADE = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode(df: DataFrame, lexicon: str, text: str = "text", path: str | None = None, made: tuple[str, ...] = ("ids",)) -> DataFrame:
    """df with the columns `made`: `ids` (the text's token ids as little-endian unsigned 32-bit integers), `n_tokens`, `ids_sha256`,
    `decoded` (the ids decoded again, in the same pass) and `decoded_sha256`. Digests are made by the workers, so that ids
    and texts that nobody needs are not handed on."""
    vocabulary_name = shipped(df.sparkSession, path)

    def maker():
        vocab, known = vocabulary(SparkFiles.get(vocabulary_name)), mapped(lexicon)
        kept: dict[str, bytes] = {}
        decode_all = _decoder(vocab)

        def encoded(texts: list[str | None]) -> list[list]:
            split = [vocab.words(t) for t in texts]
            if len(kept) > KEPT_WORDS:
                kept.clear()
            new = list(set(chain.from_iterable(split)) - kept.keys())
            for word, found in zip(new, known.find(new), strict=True):
                kept[word] = np.array(vocab.merge(word), np.uint32).tobytes() if found is None else found
            ids = [b"".join(map(kept.__getitem__, words)) for words in split]
            decoded = decode_all(ids) if {"decoded", "decoded_sha256"} & set(made) else []
            values = {
                "ids": lambda: ids,
                "n_tokens": lambda: [len(i) // 4 for i in ids],
                "ids_sha256": lambda: [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded": lambda: decoded,
                "decoded_sha256": lambda: [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
            }
            return [values[m]() for m in made]

        return encoded

    return _added(df, text, [T.StructField(m, MADE[m]) for m in made], maker)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with `decoded`: the ids' token strings, joined by a space (the vocabulary names no decoder)."""
    vocabulary_name = shipped(df.sparkSession, path)

    def maker():
        decoded = _decoder(vocabulary(SparkFiles.get(vocabulary_name)))
        return lambda values: [decoded(values)]

    return _added(df, ids, [T.StructField("decoded", T.StringType())], maker)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = encode(docs, build_lexicon(docs), made=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
