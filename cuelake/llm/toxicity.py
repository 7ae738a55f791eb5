"""Toxicity after noisy-channel deobfuscation.

A disguised word ("1d10t", "i d i o t", "idiooot", "id*ot") is a word sent through a noisy channel. Its characters span a
lattice: a character may stand for itself, for a letter that it resembles, be a separator that was put in, or repeat the
letter before. A Viterbi search finds the cheapest path under a character trigram model. The restored words are written
into the text, and the restored text is split into words and scored. The trigram model counts the characters of all
documents, with the words of the lexicon mixed in; the lexicon (words that mark toxic rows) and the final logistic curve
come from a bounded sample of labelled rows. Only words of which chance alone would hardly have made one are restored;
the others of the lexicon add to a score where they stand plainly. Asterisks at the ends of a token are decoration and
stand for no letter. Letters of other styles (mathematical, full width, circled) are read as the plain ones.

Defined results: null and empty texts hold no words and get the curve's value at zero; with labels of one kind only, the
score is the share of toxic rows in the sample (0 with no labels); rows with a null label teach nothing; rows of one text
teach once, as toxic if half of them or more are; among equally cheap paths the first in the order of the channel's tables
is taken; repeated rows get repeated results; extra columns pass through, but one that has the name of a result is
replaced by it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import crc_mod, documents, lean, scratch, small_batches, staged
from ._words import chunks, mix, span_hashes

#: Labelled rows that are fitted, at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Words of the lexicon, at most; a word needs so many toxic rows and so high a log-odds weight.
LEXICON_WORDS = 4096
LEAST_ROWS = 3
LEAST_WEIGHT = 2.0
#: Share of the trigram model's counts that the lexicon's words make up.
LEXICON_SHARE = 0.5
#: Costs (in nats) of the channel's moves.
LOOKALIKE_COST, WILDCARD_COST, SEPARATOR_COST, REPEAT_COST, PAIR_COST = 1.0, 1.5, 0.5, 0.5, 3.8
#: Words that chance may put into those that are restored, expected.
BY_CHANCE = 0.05
THRESHOLD = 0.3

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "#": "h", "€": "e",
}
WILDCARDS = "*"
BLANKS = " \t\n\r\v\f"
SEPARATORS = BLANKS + ".-_*~'"
#: Stands between texts that are looked at together; no word reaches over it.
BETWEEN = "\x1e"

# Ranges of letters and digits in other styles.
STYLED = re.compile("[\U0001d400-\U0001d7ff\uff01-\uff5e\u24b6-\u24e9]")

# Letters with a class of their own in the trigram model; all other letters share the last class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
OTHER = len(ALPHABET) + 1
CLASSES = 64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below 65536: the letter class (0: no letter), whether it may stand for a letter, whether it's space."""
    kind = np.zeros(65536, np.uint8)
    for c in range(128, 65536):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            kind[c] = OTHER
    for i, c in enumerate(ALPHABET):
        kind[ord(c)] = i + 1
    odd = np.zeros(65536, bool)
    odd[[ord(c) for c in {*LOOKALIKES, *WILDCARDS, *SEPARATORS} - {*BLANKS}]] = True
    space = np.array([chr(c).isspace() if not 0xD800 <= c < 0xE000 else False for c in range(65536)])
    return kind, odd, space


_KIND: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _KIND:
        _KIND.extend(_tables())
    return _KIND[0], _KIND[1], _KIND[2]


@lru_cache(maxsize=4096)
def _plain(c: str) -> str:
    low = unicodedata.normalize("NFKC", c).lower()
    return low if len(low) == 1 else c


def lowered(text: str | None) -> str:
    """The text in lower case, with letters and digits of other styles as the plain ones."""
    low = (text or "").lower()
    return low if low.isascii() else STYLED.sub(lambda m: _plain(m[0]), low)


def points_of(text: str) -> np.ndarray:
    """Code points; those above 65535 are 65535 if they are no letters, and else some letter of the last class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() > 65535:
        found, at = np.unique(points, return_inverse=True)
        low = [c if c <= 65535 else 0x4E00 + c % 20_000 if chr(c).isalpha() else 65535 for c in found.tolist()]
        points = np.array(low, np.uint32)[at]
    return points


def code_points(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The lower-cased texts joined by BETWEEN, their code points, and each text's start."""
    low = [lowered(t) for t in texts]
    joined = BETWEEN.join(low) + BETWEEN
    points = points_of(joined)
    starts = np.zeros(len(low), np.int64)
    np.cumsum([len(t) + 1 for t in low[:-1]], out=starts[1:])
    return joined, points, starts


def words_of(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of letters."""
    letter = np.concatenate(([False], kinds > 0, [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)


def hash_word(word: str) -> int:
    _, points, _ = code_points([word])
    return int(words_of(points, tables()[0][points])[2][0])


def disguised(joined: str, points: np.ndarray, kinds: np.ndarray) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """What may hide words: tokens (start and end in the joined text), and chains of tokens of one character each.

    A token is flagged that holds a letter and a lookalike or wildcard anywhere, a separator inside, or a letter twice in a
    row. A chain is three or more tokens with nothing but blanks, tabs or line ends between them and one letter, with
    punctuation, or one symbol of the channel each."""
    _, odd, space = tables()
    letter, blank = kinds > 0, space[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    starts, ends = edges[::2], edges[1::2]
    soft = np.isin(points, [ord(c) for c in SEPARATORS if c not in WILDCARDS + BLANKS])
    hard = odd[points] & ~soft

    def before(mask: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(mask)))

    body, letters, drawn = before(letter | hard), before(letter), np.zeros(len(points), bool)
    drawn[1:] = letter[1:] & (points[1:] == points[:-1])
    at = np.flatnonzero(soft)
    token = np.searchsorted(starts, at, "right") - 1
    inside = np.bincount(token[(body[at] > body[starts[token]]) & (body[ends[token]] > body[at])], minlength=len(starts))
    odds, n_letters = before(hard | drawn), letters[ends] - letters[starts]
    flagged = (n_letters > 0) & ((odds[ends] > odds[starts]) | (inside > 0))
    tokens = [(int(starts[i]), int(ends[i])) for i in np.flatnonzero(flagged)]

    told = before(letter | ((points >= 48) & (points <= 57)))
    single = ((n_letters == 1) & (told[ends] - told[starts] == 1)) | ((ends - starts == 1) & odd[points[starts]])
    breaks = before(blank & ~np.isin(points, [ord(c) for c in BLANKS]))
    linked = single[1:] & single[:-1] & (breaks[starts[1:]] == breaks[ends[:-1]])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False]))))
    chains = []
    for i, j in zip(edges[::2], edges[1::2] + 1, strict=True):
        if j - i >= 3 and letters[ends[j - 1]] > letters[starts[i]]:
            chains.append([(int(starts[k]), int(ends[k])) for k in range(i, j)])
    return tokens, chains


# Usual punctuation before and after a word. A run of one symbol may belong to no word either.
LEADING, TRAILING = ".,;:?\"'()[]{}%&~_-<>=/\\", ".,;:!?\"'()[]{}%&~_-<>=/\\|*#"
#: A longer run of one character is not told from one of this length.
LONGEST_RUN = 32
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(rf"(.)\1{{{LONGEST_RUN},}}")


def _edge(chars: str, usual: str) -> int:
    """How many characters at the beginning are usual punctuation or in runs of one symbol."""
    n = 0
    for c, run in groupby(chars):
        k = sum(1 for _ in run)
        if c not in usual and (k < 2 or c.isalnum()):
            break
        n += k
    return n


def cores(token: str) -> list[str]:
    """The token without what may be mere punctuation at its ends, shortest first; the last keeps all that may be a letter, but
    for wildcards at the ends."""
    bare = [i for i, c in enumerate(token) if c.isalpha() or c in LOOKALIKES]
    if not bare:
        return []
    lefts = {max(bare[0], _edge(token, LEADING)), bare[0]}
    rights = {min(bare[-1] + 1, j) for j in (len(token) - _edge(token[::-1], TRAILING), len(token.rstrip(LEADING + "!")))} | {bare[-1] + 1}
    spans = sorted({(i, j) for i in lefts for j in rights if i < j}, key=lambda x: (x[1] - x[0], x))
    return [token[i:j] for i, j in spans]


@dataclass(frozen=True)
class Model:
    trigrams: np.ndarray  # log probability of each class after each two
    words: np.ndarray  # sorted hashes of the lexicon's words
    weights: np.ndarray
    curve: tuple[float, ...]  # of bias, weight per text, hits, weight per word; only the bias may be negative
    prior: float = 0.0
    names: tuple[str, ...] = field(default=())


def drawn_out(token: str) -> list[float]:
    """What it costs that a character repeats the one before: little in a run of three or more, more in a pair, as many words
    have pairs; 0 where it can't. Wildcards hide a letter each."""
    drawn = [0.0] * len(token)
    for run in re.finditer(r"(.)\1+", token):
        if run[1] not in WILDCARDS:
            drawn[run.start() : run.end()] = [PAIR_COST if len(run[0]) == 2 else REPEAT_COST] * len(run[0])
    return drawn


def channel(c: str) -> tuple[list[tuple[str, float]], float | None]:
    """What a character may stand for, at which costs, and the cost of its being a mere separator (or None)."""
    moves = [(c, 0.0)] if c.isalpha() else []
    moves += [(x, LOOKALIKE_COST) for x in LOOKALIKES.get(c, "")]
    if c in WILDCARDS:
        moves += [(x, WILDCARD_COST) for x in ALPHABET[:26]]
    drop = (4 * WILDCARD_COST if c in WILDCARDS else SEPARATOR_COST) if c in SEPARATORS else None
    return moves if moves or drop is not None else [(c, 0.0)], drop


_CLASS = {c: i + 1 for i, c in enumerate(ALPHABET)}


def restore_word(token: str, trigrams: np.ndarray) -> str:
    """The most likely word behind a token: Viterbi over its character lattice. A state is the classes of the last two letters;
    each layer keeps, by state, its cost, last letter, the state before, and the letter that led here."""
    layers: list[dict[tuple[int, int], tuple]] = [{(0, 0): (0.0, "", None, "")}]
    for c, long in zip(token, drawn_out(token), strict=True):
        moves, drop = channel(c)
        step: dict[tuple[int, int], tuple] = {}

        def offer(state, cost, last, before, letter, step=step):
            if state not in step or cost < step[state][0]:
                step[state] = (cost, last, before, letter)

        for (a, b), (cost, last, _, _) in layers[-1].items():
            for x, price in moves:
                k = _CLASS.get(x, OTHER) if x.isalpha() else 0
                offer((b, k), cost + price - float(trigrams[a, b, k]), x, (a, b), x)
                if long and last == x:
                    offer((a, b), cost + price + long, last, (a, b), "")
            if drop is not None:
                offer((a, b), cost + drop, last, (a, b), "")
        layers.append(step)
    at = min(layers[-1], key=lambda s: layers[-1][s][0] - float(trigrams[s[0], s[1], 0]))
    out = []
    for layer in reversed(layers[1:]):
        _, _, before, letter = layer[at]
        out.append(letter)
        at = before
    return "".join(reversed(out))


class Lexicon:
    """The lexicon's words as a tree, which tells cheaply whether the channel can make one of them of a token at all: all
    other tokens need no search."""

    def __init__(self, words: tuple[str, ...]):
        self.words, self.next = set(words), {}
        for w in words:
            for i in range(len(w)):
                self.next.setdefault(w[:i], set()).add(w[i])

    def ends(self, text: str, start: int = 0, stop: int | None = None) -> list[int]:
        """Where in text[start:stop] may end a word of the lexicon that begins at its start."""
        states, out, stop = {""}, [], len(text) if stop is None else stop
        for i in range(start, stop):
            c = text[i]
            moves = (c if c.isalpha() else "") + LOOKALIKES.get(c, "") + (ALPHABET[:26] if c in WILDCARDS else "")
            step = set(states) if c in SEPARATORS else set()
            long = c not in WILDCARDS and c * 2 in text[max(start, i - 1) : min(stop, i + 2)]
            for s in states:
                if after := self.next.get(s):
                    step.update(s + x for x in moves if x in after)
                if long and s and s[-1] in moves:
                    step.add(s)
            if not step:
                break
            if moves and not step.isdisjoint(self.words):
                out.append(i + 1)
            states = step
        return out


def written(text: str, mended: list[tuple[int, int, str]]) -> str:
    """The text with its mended words written plainly."""
    out, at = [], 0
    for a, b, word in mended:
        out += [text[at:a], word]
        at = b
    return "".join([*out, text[at:]])


class Scorer:
    """Restores and scores lists of texts with a model; keeps what it has restored."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.names)
        self.kept = lru_cache(maxsize=200_000)(self.restored)

    def search(self, token: str) -> str:
        """The word behind the whole token, if it is one of the lexicon."""
        token = _RUN.sub(lambda m: m[1] * LONGEST_RUN, token)
        if self.lexicon.ends(token)[-1:] != [len(token)]:
            return ""
        word = restore_word(token, self.model.trigrams)
        return word if word in self.lexicon.words else ""

    def restored(self, token: str) -> str:
        """The word of the lexicon behind a token, or an empty text. The shortest core that gives one is taken."""
        return next((w for c in cores(token) if (w := self.search(c))), "")

    def mended(self, joined: str, points: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int, str]]:
        """The disguised words of the lexicon: start, end and word, in order."""
        tokens, chains = disguised(joined, points, kinds)
        out: list[tuple[int, int, str]] = []
        for chain in chains:
            k = 0
            while k < len(chain) - 2:
                n, word = self.spaced(joined, chain, k)
                if n:
                    out.append((chain[k][0], chain[k + n - 1][1], word))
                k += max(n, 1)
        firsts = [a for a, _, _ in out]
        for a, b in tokens:
            i = bisect_right(firsts, a)
            if i and a < out[i - 1][1]:
                continue
            word = (self.kept if b - a <= 100 else self.restored)(joined[a:b])
            if word and word not in _LETTERS.findall(joined[a:b]):  # those stand there plainly
                out.append((a, b, word))
        return sorted(out)

    def spaced(self, joined: str, chain: list[tuple[int, int]], k: int) -> tuple[int, str]:
        """The longest word of the lexicon that begins with token k of a chain, and how many of its tokens it takes (or 0)."""
        a, b = chain[k]
        first = next((i for i in range(a, b) if joined[i].isalpha() or b - a == 1), a)
        if joined[first] in SEPARATORS and joined[first] not in WILDCARDS:
            return 0, ""
        for end in reversed(self.lexicon.ends(joined, first, chain[-1][1])):
            if joined[end - 1] in WILDCARDS or joined[first] in WILDCARDS:
                continue
            n = bisect_right(chain, end - 1, key=lambda x: x[0]) - k
            if n >= 3 and any(c.isalpha() for c in joined[first:end]) and (word := self.search(joined[first:end])):
                return n, word
        return 0, ""

    def weights_of(self, hashes: np.ndarray) -> np.ndarray:
        words = self.model.words
        if not len(words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        return np.where(words[at] == hashes, self.model.weights[at], 0.0)

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each restored text (weight, hits, weight per word), and how many words were restored to words of the lexicon."""
        joined, points, begins = code_points(texts)
        kinds, n = tables()[0][points], len(texts)
        mended = self.mended(joined, points, kinds)
        at = np.array([a for a, _, _ in mended], np.int64)
        if mended:
            points = points_of(written(joined, mended))
            kinds = tables()[0][points]
            grown = np.concatenate(([0], np.cumsum([len(w) - (b - a) for a, b, w in mended])))
            places, begins = begins, begins + grown[np.searchsorted(at, begins)]
            n_mended = np.bincount(np.searchsorted(places, at, "right") - 1, minlength=n)
        else:
            n_mended = np.zeros(n, np.int64)
        starts, _, hashes = words_of(points, kinds)
        row, weight = np.searchsorted(begins, starts, "right") - 1, self.weights_of(hashes)
        total, hits = np.bincount(row, weight, n), np.bincount(row, weight > 0, n)
        words = np.bincount(row, minlength=n)
        return np.stack([np.log1p(total), np.minimum(hits, 5), total / np.sqrt(words + 1)], 1), n_mended

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        x, mended = self.features(texts)
        if not self.model.curve:
            return np.full(len(texts), self.model.prior), mended
        c = np.array(self.model.curve)
        return 1 / (1 + np.exp(-np.clip(c[0] + x @ c[1:], -30, 30))), mended

    def restore(self, text: str | None) -> str | None:
        if not text:
            return text
        joined, points, _ = code_points([text])
        if len(joined) != len(text) + 1:  # lower-casing has changed lengths, so places differ
            text = lowered(text)
        return written(text, self.mended(joined, points, tables()[0][points]))


def character_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the character trigrams in the words of all texts; each task adds up its own first."""
    small_batches(docs.sparkSession)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for c in chunks(b):
                _, points, _ = code_points(c.column(0).to_pylist())
                k = tables()[0][points].astype(np.int64)
                k = np.concatenate(([0, 0], k))
                code = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
                inside = (k[2:] > 0) | (k[1:-1] > 0)
                code = np.where(k[1:-1] > 0, code, k[2:])  # the first letter of a word follows two boundaries
                total += np.bincount(code[inside], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long")
    out = np.zeros(CLASSES**3)
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most CLASSES ** 3 rows
        out[r.code] = r.n
    return out.reshape(CLASSES, CLASSES, CLASSES)


def _log_probabilities(counts: np.ndarray, lexicon: list[str]) -> np.ndarray:
    kinds = {c: i + 1 for i, c in enumerate(ALPHABET)}
    extra = np.zeros_like(counts)
    for word in lexicon:
        a = b = 0
        for c in [*(kinds.get(x, OTHER) for x in word), 0]:
            extra[a, b, c] += 1
            a, b = b, c
    if extra.sum():
        counts = counts + extra * (LEXICON_SHARE * max(counts.sum(), 1.0) / extra.sum())
    smooth = counts + 0.05
    return np.log(smooth / smooth.sum(2, keepdims=True)).astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a ridge-regularised logistic curve by Newton's method. More bad words never lower the score: while a
    feature's coefficient is negative (the features overlap), the one with the least is left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.concatenate([np.ones((len(x), 1)), x[:, used]], 1)
        c = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(c))
            c = c - np.linalg.solve(h, z.T @ (p - y) + 0.05 * c)
        if not used or c[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(i + 1 for i in used)]] = c
            return tuple(float(v) for v in out)
        del used[int(c[1:].argmin())]


def _lexicon(counted: list, toxic: int, clean: int) -> dict[str, float]:
    """Log-odds weights of the words that mark toxic rows, from (word, toxic rows, rows)."""
    out = {}
    for word, a, b in counted:
        w = math.log((a + 0.05) / (toxic + 1)) - math.log((b - a + 0.5) / (clean + 1))
        if w >= LEAST_WEIGHT:
            out[word] = w * a / (a + 2)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS])


def _by_chance(a: int, b: int, share: float) -> float:
    """Logarithm of a bound of the chance that `a` or more of b rows are toxic, if a share of all rows is."""
    if a <= share * b:
        return 0.0
    same = lambda k, p: k * math.log(k / b / p) if k else 0.0
    return -same(a, share) - same(b - a, 1 - share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, corpus: DataFrame | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id and a 0/1 label, of which at most `rows` are used. The trigram model counts
    all of `corpus` (default: docs). The sample is dealt into two halves by a hash of the text: the curve is fitted on
    the second half with the lexicon of the first, and the model's lexicon comes from both."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded: `rows` pairs of numbers
    by_text = found.where("text is not null").groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    with scratch(spark):
        sample = staged(by_text.select("label", "text", (F.xxhash64("text") % 2 != 0).alias("second")), "labelled")
        n = {(r.second, r.label): r.n for r in sample.groupBy("second", "label").agg(F.count("*").alias("n")).collect()}
        toxic, clean = (sum(v for (_, x), v in n.items() if x == k) for k in (1, 0))
        if not toxic or not clean:
            prior = toxic / (toxic + clean) if toxic + clean else 0.0
            return Model(_log_probabilities(character_trigrams(corpus or docs), []), np.zeros(0, np.uint64), np.zeros(0), (), prior)
        words = sample.select("second", "label", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))).alias("word"))
        marked = (F.col("label") == 1).cast("long")
        first = ~F.col("second")
        counted = (
            words.groupBy("word")
            .agg(F.sum(marked).alias("a"), F.count("*").alias("b"), F.sum(F.when(first, marked).otherwise(0)).alias("a1"), F.sum(first.cast("long")).alias("b1"))
            .where(f"a >= {LEAST_ROWS} and a / b > 0.5")
            .orderBy(F.desc("a"), "word")
            .limit(20 * LEXICON_WORDS)
            .collect()
        )
        tried = max(1, words.groupBy("word").agg(F.count("*").alias("b")).where(f"b >= {LEAST_ROWS}").count())
        sure = {r.word for r in counted if _by_chance(r.a, r.b, toxic / (toxic + clean)) + math.log(tried) < math.log(BY_CHANCE)}
        both = _lexicon([(r.word, r.a, r.b) for r in counted], toxic, clean)
        half = _lexicon([(r.word, r.a1, r.b1) for r in counted if r.a1 >= max(1, LEAST_ROWS // 2)], n.get((False, 1), 0), n.get((False, 0), 0))
        trigrams = _log_probabilities(character_trigrams(corpus or docs), sorted(sure & both.keys()))
        trial = spark.sparkContext.broadcast(_model(trigrams, half or both, (), sure))

        @lean
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(trial.value)
            for b in batches:
                for c in chunks(b):
                    x, _ = scorer.features(c.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([c.column("label"), *(pa.array(v.astype(float)) for v in x.T)], ["label", "a", "b", "c"])

        second = sample.where("second") if half and n.get((True, 1)) and n.get((True, 0)) else sample
        got = second.select("label", "text").mapInArrow(measure, "label int, a double, b double, c double").collect()
        got.sort()  # sums of floats depend on their order
        curve = _logistic(np.array([r[1:] for r in got]), np.array([r[0] for r in got], float))
        return _model(trigrams, both, curve, sure)


def _model(trigrams: np.ndarray, lexicon: dict[str, float], curve: tuple[float, ...], restorable: Collection[str] | None = None) -> Model:
    """A model that restores the words of the lexicon that are restorable (default: all)."""
    by_hash = sorted((hash_word(w), v, w) for w, v in lexicon.items())
    return Model(
        trigrams, np.array([h for h, _, _ in by_hash], np.uint64), np.array([v for _, v, _ in by_hash]), curve, 0.0, tuple(w for _, _, w in by_hash if restorable is None or w in restorable)
    )


def _added(df: DataFrame, model: Model, text: str, added: str, fn) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: CLASSES ** 3 floats and LEXICON_WORDS words
    new = T.StructType.fromDDL(added)
    keep = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType(keep + new.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scorer, arrow = Scorer(shared.value), to_arrow_schema(schema)
        for b in batches:
            for c in chunks(b, text):
                columns = [c.column(c.schema.get_field_index(f.name)) for f in keep]
                columns += [pa.array(v) for v in fn(scorer, c.column(c.schema.get_field_index(text)).to_pylist())]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def score(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "n_restored")) -> DataFrame:
    """df with the score (0 to 1) and the number of disguised words of the lexicon, in columns of these names."""
    return _added(df, model, text, f"`{names[0]}` double, `{names[1]}` long", lambda s, texts: s.score(texts))


def restore(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with `restored_text`: the text with its disguised words of the lexicon written plainly."""
    return _added(df, model, text, "restored_text string", lambda s, texts: [[s.restore(t) for t in texts]])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, fit(docs, labels.where(crc_mod(4) != 2)))
    return out.select(
        "doc_id", (crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored"
    )
