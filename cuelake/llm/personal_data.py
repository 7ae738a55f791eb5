"""Personal data: regular expressions propose spans, checksums and other validators confirm them, words nearby settle the score.

Each kind has a pattern, a validator and the score (0 to 100) of what passes it; a word of the kind within BEFORE characters
before a span or AFTER characters after it adds NEARBY to the score, a word against it takes as much away. Spans of the base
kinds (email, ip, card by Luhn's checksum, phone) always stay. Of the other kinds (iban by its remainder modulo 97, ssn, tel:
a number without a country's code) those stay that score ENOUGH; an ssn or tel does so only with such a word, and not where
it overlaps a span of a kind that is listed before it. Spans are code points, the end exclusive, leftmost and without
overlaps within a kind; what fails its validator is dropped and not tried again from a later start.

All searches are linear in the length of a text, whatever it holds: patterns with nested repetitions are searched as longest
runs of their characters, which are then cut.

Defined results: null and empty texts have no spans; repeated rows get repeated results; extra columns pass through `find`,
but one that has the name of a result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import documents, lean, small_batches
from ._words import chunks

BEFORE, AFTER = 40, 20
NEARBY, ENOUGH = 30, 60

#: Characters of the account numbers of countries, after the country's letters and two digits.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI NL", 15: "SI", 16: "AT BA EE LT LU XK", 17: "CH CR HR LI LV", 18: "BG BH DE GB GE IE ME RS",
    19: "AE GI IL TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "PT", 22: "IS TR", 23: "FR GR IT MC SM", 24: "AL AZ CY DO GT HU LB PL",
    25: "BR PS QA", 26: "JO KW MU", 27: "MT SC", 28: "LC",
}
IBAN = "|".join(f"(?:{'|'.join(of.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, of in IBAN_LENGTHS.items())
SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
TEL = "\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}"

_EMAIL_AT = re.compile("@")
_EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL_DOMAIN = re.compile("[A-Za-z0-9.-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile("[0-9][0-9 -]*")
_APART = re.compile("[ -]{2,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_UPPER = {c: c + 32 for c in range(65, 91)}

Spans = Iterator[tuple[int, int]]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the digits pass Luhn's checksum."""
    total = sum(map(int, number[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def mod97(number: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Spans:
    done = 0
    for at in _EMAIL_AT.finditer(text):
        local = text[done : at.start()]
        start = done + len(local.rstrip(_EMAIL_LOCAL))
        domain = _EMAIL_DOMAIN.match(text, at.end())[0].partition("..")[0].rstrip(".")
        done = at.end()
        if start < at.start() and domain[:1] not in ("", ".") and "." in domain:
            done += len(domain)
            yield start, done


def ips(text: str) -> Spans:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Spans:
    for run in _DIGITS.finditer(text):
        at = run.start()
        for end, after in [*(m.span() for m in _APART.finditer(text, *run.span())), (run.end(), run.end())]:
            number = text[at:end].rstrip(" -")
            if 12 <= len(number) <= 37 and 12 <= len(d := digits(number)) <= 19 and luhn(d):
                yield at, at + len(number)
            at = after


def phones(text: str) -> Spans:
    for m in _PHONE.finditer(text):
        if 9 <= len(digits(m[0])) <= 15:
            yield m.span()


def alone(text: str, start: int, end: int) -> bool:
    """Whether neither a letter nor a digit of ASCII stands beside a span."""
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return not re.search("[0-9A-Za-z]", beside)


def matches(pattern: str, valid: Callable[[str], bool]) -> Callable[[str], Spans]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text) if alone(text, *m.span()) and valid(m[0]))


def ssn(number: str) -> bool:
    return number[:3] not in ("000", "666") and number[0] != "9" and number[4:6] != "00" and number[7:] != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Spans]
    needs: str  # a character class without which there is no span
    score: int
    words: str
    against: str = ""
    base: bool = False
    checked: bool = True  # by more than its pattern


_PHONE_WORDS = "phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|t[eé]l[eé]phone|tel[eé]fono|m[oó]vil|portable|handy"
KINDS = (
    Kind("email", emails, "@", 90, "mail|email|e-mail|contact|correo|courriel|kontakt", base=True),
    Kind("ip", ips, "[0-9]", 60, "ip|ipv4|host|server|servidor|serveur|gateway|client", "version|release|chapter|section|kapitel|chapitre|cap[ií]tulo", base=True),
    Kind("card", cards, "[0-9]", 80, "card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|cvv", "isbn|order|invoice|tracking|serial", base=True),
    Kind("phone", phones, "[+]", 70, _PHONE_WORDS, base=True),
    Kind("iban", matches(IBAN, mod97), "[A-Z][0-9]", 90, "iban|account|konto|compte|cuenta|bank|banco|banque"),
    Kind("ssn", matches(SSN, ssn), "[0-9]-", 40, "ssn|social security", "part|model|order", checked=False),
    Kind("tel", matches(TEL, lambda _: True), "[0-9]", 40, _PHONE_WORDS, "isbn|order|invoice|tracking|serial", checked=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
_NEEDS = {k.name: re.compile(k.needs) for k in KINDS}
_WORDS = {k.name: re.compile(f"[^a-z](?:{k.words})[^a-z]") for k in KINDS}
_AGAINST = {k.name: re.compile(f"[^a-z](?:{k.against})[^a-z]") for k in KINDS if k.against}


def nearby(text: str, start: int, end: int) -> str:
    """What stands before and after a span, A-Z in lower case; words that its ends cut are not whole there."""
    before = " " * (start < BEFORE) + text[max(0, start - BEFORE) : start] + " "
    after = " " + text[end : end + AFTER] + " " * (end + AFTER >= len(text))
    return f"{before}\n{after}".translate(_UPPER)


def covers(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps one of these."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return lambda start, end: (i := bisect_left(starts, end)) > 0 and ends[i - 1] > start


def spans_of(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of a text, by start and then in the order of KINDS."""
    found: list[tuple[int, int, int, int]] = []
    for i, kind in enumerate(KINDS):
        if not _NEEDS[kind.name].search(text):
            continue
        taken = covers([(start, end) for start, _, end, _ in found]) if not kind.checked else lambda *_: False
        for start, end in [*kind.find(text)]:
            around = nearby(text, start, end)
            score = kind.score + NEARBY * bool(_WORDS[kind.name].search(around))
            score -= NEARBY * bool(kind.against and _AGAINST[kind.name].search(around))
            if kind.base or score >= ENOUGH and not taken(start, end):
                found.append((start, i, end, min(100, score)))
    return [(KINDS[i].name, start, end, score) for start, i, end, score in sorted(found)]


def redacted(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with `[KIND]` in place of each span; of overlapping spans the first one names them all."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind: string, start: int, end: int, score: int>>"


def find(df: DataFrame, text: str = "text", keep_text: bool = True, clean: str | None = None) -> DataFrame:
    """df with `pii`, the spans of each text, and if `clean` names a column, with the text without them there; without the text
    itself if it is not kept."""
    small_batches(df.sparkSession)
    result = T.StructType.fromDDL(f"pii {_SPAN}" + (f", {clean} string" if clean else ""))
    keep = [f for f in df.schema.fields if f.name not in result.names and (keep_text or f.name != text)]
    schema = T.StructType([*keep, *result.fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        names = ("kind", "start", "end", "score")
        for b in batches:
            for c in chunks(b, text):
                texts = [t or "" for t in c.column(text).to_pylist()]
                spans = [spans_of(t) for t in texts]
                columns = [c.column(f.name).cast(arrow.field(f.name).type) for f in keep]
                columns.append(pa.array([[dict(zip(names, s, strict=True)) for s in mine] for mine in spans], arrow.field("pii").type))
                if clean:
                    columns.append(pa.array([redacted(t, mine) for t, mine in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(of(kind) for kind in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0)).alias("top_score"),
    )


def _proposed(kind: Kind, pattern: str, valid: str, alone: str) -> str:
    """SQL for (r, kind, start, stop, score) of a kind's spans in the texts of t: matches are put between marks, and the lengths of
    the pieces between marks give their places. Texts are met again by what is valid only."""
    score = f"{kind.score}" + (f" - CASE WHEN regexp_matches(around, '[^a-z](?:{kind.against})[^a-z]') THEN {NEARBY} ELSE 0 END" if kind.against else "")
    score += f" + CASE WHEN regexp_matches(around, '[^a-z](?:{kind.words})[^a-z]') THEN {NEARBY} ELSE 0 END"
    return f"""
  {kind.name}_pieces AS (
    SELECT r, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i
    FROM (SELECT r, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p FROM t)),
  {kind.name}_found AS (
    SELECT r, start, piece AS found, start + length(piece) AS stop
    FROM (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {kind.name}_pieces)
    WHERE i % 2 = 0 AND {valid}),
  {kind.name}_seen AS (
    SELECT f.r, start, stop,
           translate(CASE WHEN start < {BEFORE} THEN ' ' ELSE '' END || substr(text, greatest(start - {BEFORE}, 0) + 1, least(start, {BEFORE})) || ' ' || chr(10) || ' '
                     || substr(text, stop + 1, {AFTER}) || CASE WHEN stop + {AFTER} >= length(text) THEN ' ' ELSE '' END,
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS around
    FROM {kind.name}_found f JOIN t ON f.r = t.r WHERE {alone}),
  {kind.name} AS (
    SELECT * FROM (SELECT r, {[k.name for k in KINDS].index(kind.name)} AS kind, start, stop, least(100, {score}) AS score FROM {kind.name}_seen){"" if kind.base else f" WHERE score >= {ENOUGH}"})"""


_ALONE = "NOT regexp_matches(substr(text, start, CASE WHEN start > 0 THEN 1 ELSE 0 END) || substr(text, stop + 1, 1), '[0-9A-Za-z]')"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": "[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": IBAN, "ssn": SSN, "tel": TEL,
}
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(found, '.'), lambda q: length(ltrim(q, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(q, '0') AS INT), 0) <= 255))",
    "card": """length(regexp_replace(found, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(regexp_replace(found, '[^0-9]', '', 'g'))),
               lambda j: CASE WHEN j % 2 = 0 THEN CAST(reverse(regexp_replace(found, '[^0-9]', '', 'g'))[j + 1] AS INT)
                              ELSE (2 * CAST(reverse(regexp_replace(found, '[^0-9]', '', 'g'))[j + 1] AS INT)) // 10
                                   + (2 * CAST(reverse(regexp_replace(found, '[^0-9]', '', 'g'))[j + 1] AS INT)) % 10 END)) % 10 = 0""",
    "phone": "length(regexp_replace(found, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "iban": """list_reduce(string_split(replace(found, ' ', '')[5:] || replace(found, ' ', '')[:4], ''),
                lambda v, x: CASE WHEN ascii(x) < 65 THEN v * 10 + ascii(x) - 48 ELSE v * 100 + ascii(x) - 55 END % 97, 0) = 1""",
    "ssn": "NOT regexp_matches(found, '^(?:000|666|9)|-00-|-0000$')",
    "tel": "true",
}
_TABLES = ",".join(_proposed(k, _PATTERNS[k.name], _VALID[k.name], "true" if k.base else _ALONE) for k in KINDS)
_FREE = "NOT EXISTS (SELECT 1 FROM {taken} o WHERE o.r = x.r AND o.start < x.stop AND o.stop > x.start)"
OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents),
{_TABLES},
checked AS ({" UNION ALL ".join(f"SELECT * FROM {k.name}" for k in KINDS if k.checked)}),
more AS (SELECT * FROM checked UNION ALL SELECT * FROM ssn x WHERE {_FREE.format(taken="checked")}),
every AS (SELECT * FROM more UNION ALL SELECT * FROM tel x WHERE {_FREE.format(taken="more")}),
named AS (SELECT *, [{", ".join(f"'{k.name}'" for k in KINDS)}][kind + 1] AS name FROM every),
s AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE name = '{b}') AS n_{b}" for b in BASE)}, max(score) AS top_score,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}) AS base FROM named GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(top_score, 0) AS INT) AS top_score
FROM t LEFT JOIN s ON t.r = s.r
"""
