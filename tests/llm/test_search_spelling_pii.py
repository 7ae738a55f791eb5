"""Lexical search, spelling variants and personal data against brute force."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cuelake.llm import lexical_search, personal_data, spelling

# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def searched(items, docs, k=20):
    """All rows by plain loops."""
    counts = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_words = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * v + 1))) for t, v in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for d, c, n in counts:
            m = 75 + (25 * n * n_docs) // n_words if n_words else 0
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d, s))
        out += [(item, r + 1, d, s) for r, (*_, d, s) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat. the CAT!"), (2, "cat"), (3, "cat"), (4, ""), (5, None), (None, "cat"), (6, "Äpfel, ÄPFEL äpfel 42"), (7, "... --- ..."), (8, "dog " * 3000 + "cat"),
    (2, "cat"), (9, "a_b-c a@b[c]d`e{f}"), (10, "sat sat sat mat"),
]
ITEMS = [(0, "cat cat sat"), (0, "cat cat sat"), (0, "dog"), (1, ""), (2, None), (None, "äpfel 42 mat"), (3, "a b c d e f"), (4, "nowhere"), (5, "--")]


def asked(spark, items, docs, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, n int").repartition(5)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    return lexical_search.search(i, d, **more)


@pytest.mark.parametrize("entries", [4, 500])
@pytest.mark.parametrize("k", [2, 20])
def test_search_by_brute_force(spark, entries, k):
    got = asked(spark, ITEMS, DOCS, k=k, entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == searched(ITEMS, DOCS, k)


def test_search_of_random_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", 7)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.choice([1, 2]) for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(150)] + [(1000 + i, "a bb c") for i in range(40)]
    items = [(i, text(6)) for i in range(8)]
    assert sorted(map(tuple, asked(spark, items, docs).collect()), key=str) == searched(items, docs)


def test_search_of_empty_tables(spark):
    assert asked(spark, ITEMS, []).count() == 0
    assert asked(spark, [], DOCS).count() == 0


def test_best_of_ties():
    score, ids, missing = np.array([5, 7, 5, 5, 7]), np.array([9, 4, 1, 0, 3]), np.array([False, False, False, True, False])
    assert lexical_search.best_of(score, ids, missing, 4).tolist() == [4, 1, 2, 0]


# Spelling variants


def one_edit(x: str, y: str) -> bool:
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return x in less(y) or y in less(x)


def grouped(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, mine in near.items():
        best = min(mine, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def answered(spark, counts, **more):
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = spelling.variants(table, **more).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_spelling_by_all_pairs(spark, limit):
    rng = random.Random(limit)
    made = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(220)}
    made |= {"aaaaaaa", "aaaaaa", "aaaaaaaa", "x" * 70, "x" * 69 + "y", "x" * 71, "international", "internationale"}
    counts = {w: rng.choice([3, 4, 6, 8, 16, 40, 200]) for w in sorted(made)}
    assert answered(spark, counts, limit=limit) == grouped(counts)


def test_spelling_chains_lead_to_their_root(spark):
    words = ["plane", "plank", "flank", "flask", "flasks"]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    got = answered(spark, counts)
    assert got == grouped(counts) and {v[1] for v in got.values()} == {"flasks"}


def test_a_pair_is_found_in_one_block_only():
    for words in (["abcdefgh", "abcdefgx", "xbcdefgh", "abcdefghi", "abcdxefgh", "abcdefg"], ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa"]):
        for x in words:
            for y in words:
                if x < y and one_edit(x, y):
                    s, long = sorted((x, y), key=lambda w: (len(w), w))
                    m, found = len(s), 0
                    level = [(m, m // 2, 0, m + 1), (m, 0, m // 2, m // 2)]
                    while level:
                        m, a, b, cap = level.pop()
                        if s[:a] == long[:a] and s[len(s) - b :] == long[len(long) - b :]:
                            if m - a - b > 1:
                                level += [k[:4] for k in spelling.divided(m, a, b, cap, s)]
                            else:
                                found += len(spelling.verified(m, a, cap, [(s, 1), (long, 1)])) // 2
                    assert found == 1, (x, y)


def counted(docs):
    out = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 5
    return {w: n for w, n in out.items() if n >= 3}


def test_words_and_their_noise(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["Straße", "fenêtre", "WINDOWS", "naïve×÷", "ÉTÉété", "a", "I'll", "日本windows語"]) for _ in range(200))) for i in range(60)]
    docs += [(None, "windows " * 500), (3, None), (4, ""), (5, "fenêtre " * 20_000), (5, "fenêtre " * 20)]
    table = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.words(table).collect()}
    assert got == counted(docs) and len(got) > 6


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(empty)).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for i, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            luhn = sum(x if j % 2 == 0 else x * 2 - 9 * (x > 4) for j, x in enumerate(d[::-1])) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), i, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


PARTS = [
    "a", "b@c.d", "@", ".", "..", "-", "--", " ", "  ", "1", "255", "256", "0007", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "49927398716", "+", "+1 (743) 555-3824",
    "+12", "10.0.0.1", "1.2.3.4.5.6.7.8", "é", "x@y", "x@y.z@w.v", "_%+-@a-b.c-d.", "\n", "(555) 123-4567", "call ", "Phone: ", "hotel 555-123-4567", "SSN 123-45-6789", "123-45-6789",
    "part 123-45-6789 ssn", "666-12-3456 ssn", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "FR1420041010050500013M02606", "IBAN ", "version 1.2.3.4",
    "0000000000000000", "😀", " ", "٣٤٥", "tel", "A", "",
]


def random_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = random_text(rng)
        assert [s[:3] for s in personal_data.spans_of(text) if s[0] in BASE] == base_spans(text), text


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in personal_data.spans_of(text)]


def test_checksums_and_words_nearby():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("XDE89370400440532013000") == kinds("DE893704004405320130001") == []
    assert kinds("FR1420041010050500013M02606 AND MORE") == [("iban", "FR1420041010050500013M02606")]
    assert kinds("number 555-123-4567") == [] and kinds("at the hotel 555-123-4567") == []
    assert kinds("Call 555-123-4567") == [("tel", "555-123-4567")]
    assert kinds("Teléfono (555) 123-4567") == [("tel", "(555) 123-4567")]
    assert kinds("order 555-123-4567 by phone") == []
    assert kinds("her social security number is 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("ssn 000-45-6789, 123-00-6789, 123-45-0000, 900-45-6789") == []
    assert kinds("call +1 555-123-4567") == [("phone", "+1 555-123-4567")]
    scores = [personal_data.spans_of(t)[0][3] for t in ("host 10.0.0.1", "10.0.0.1", "version 10.0.0.1")]
    assert scores == [90, 60, 30]


@pytest.mark.parametrize("part", ["a", "1", "1.", "1 ", "a.", "a@", "+1", "+1 ", "1-", "AB12 ", "@a.", "1.2.3.", "12-", "123-45-", "DE89 1", "(", "."])
def test_searches_are_linear(part):
    text = part * (400_000 // len(part))
    began = time.process_time()
    personal_data.spans_of(text)
    assert time.process_time() - began < 20


def test_redacted():
    text = "é mail a@b.co or call (555) 123-4567!"
    assert personal_data.redacted(text, personal_data.spans_of(text)) == "é mail [EMAIL] or call [TEL]!"
    assert personal_data.redacted("abcdef", [("ip", 1, 4, 0), ("card", 2, 5, 0)]) == "a[IP]f"


def test_find_keeps_other_columns(spark):
    rows = [(1, "a@b.co", 5, "y"), (2, None, None, None), (None, "", 1, "x"), (1, "a@b.co", 5, "y"), (3, "z" * 300_000 + " 10.0.0.1", 2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii int, kind string")
    got = personal_data.find(df, clean="bare").collect()
    assert [[(s.kind, s.start, s.end) for s in r.pii] for r in got] == [[("email", 0, 6)], [], [], [("email", 0, 6)], [("ip", 300_001, 300_009)]]
    assert [r.bare for r in got[:3]] == ["[EMAIL]", "", ""] and [r.kind for r in got[:2]] == ["y", None]
    assert personal_data.find(df.limit(0)).count() == 0


def test_query_equals_its_sql_on_planted_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, random_text(rng)) for i in range(3000)] + [(9001, None), (9002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mine = defaultdict(list)
    for r in personal_data.op13_pii(spark, str(tmp_path)).collect():
        mine[r.doc_id].append(tuple(r))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(personal_data.OP13_SQL)
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"]
    for row in found.fetchall():
        got = mine.pop(row[0])
        want = tuple(row[found.columns.index(c)] for c in columns)
        assert got == [want], rows[row[0]] if row[0] < 9000 else row
    assert not mine
