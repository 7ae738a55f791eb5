"""Text functions as Column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D\x20\x{85}\p{Z}]"
NOISE = r"[\x09-\x0D\x20\x{85}\p{Z}\p{P}\p{S}]"
MARKS = r"[^\p{P}\p{S}]"
# Ranges of kana, kanji and hangul.
JAPANESE = r"[^\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"
LEAK = r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
WORD = r"[[\p{L}\p{N}_]&&[\x{0}-\x{ffff}]]"
KANA = r"[\x{30a1}-\x{30f6}]"

# Utterances without words.
VOCALIZATIONS = (
    "あ い う え お ん っ あっ いっ うっ えっ おっ んっ ああ いい うう ええ おお んん うん あん はあ ふう へえ "
    "あー いー うー えー おー んー はぁ ふぅ えぇ うぅ"
).split()


def meaningful(text: Column) -> Column:
    """The text without white space, punctuation and symbols."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, "")


def for_comparison(text: Column) -> Column:
    return F.lower(meaningful(text))


def clean_spaces(text: Column) -> Column:
    """Line ends as spaces, runs of spaces and tabs as one, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), r"[ \t]+", " ")
    return F.regexp_replace(flat, rf"^{SPACE}+|{SPACE}+$", "")


def chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_distinct(chars(text)))


def low_diversity(clean: Column) -> Column:
    """Whether a meaningful text of 16 characters or more uses very few different ones."""
    unique = distinct_chars(clean)
    return (F.length(clean) >= 16) & ((unique <= 3) | (unique * 100 <= F.length(clean) * 18))


def vocalization(normalized: Column) -> Column:
    same = (F.length(normalized) > 0) & (F.length(normalized) <= 12) & (distinct_chars(normalized) == 1)
    return normalized.isin(*VOCALIZATIONS) | same


def compact_repetition(text: Column, clean: Column | None = None) -> Column:
    """A text of low diversity shortened to its repeated unit, thrice, or to its first three characters. clean: its
    meaningful text, where that is a column already."""
    clean = meaningful(text) if clean is None else clean
    n = F.length(clean)

    def matches(unit: Column) -> Column:
        at = F.sequence(F.lit(0), n - 1)
        return F.size(F.filter(at, lambda i: F.substring(clean, i + 1, F.lit(1)) == F.substring(clean, i % unit + 1, F.lit(1))))

    longest = F.least(F.lit(6), F.floor(n / 4).cast("int"))
    units = F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda u: (u <= longest) & (matches(u) * 100 >= n * 85))
    unit = F.substring(clean, F.lit(1), units[0])
    short = F.when(F.size(units) > 0, F.concat(unit, F.lit("、"), unit, F.lit("、"), unit, F.lit("……"))).otherwise(F.concat(F.substring(clean, 1, 3), F.lit("……")))
    return F.when(low_diversity(clean), short).otherwise(text)


def excessive_repetition(text: Column) -> Column:
    """Whether runs of the first meaningful character, or punctuation, dominate a text of 16 characters or more."""
    clean = meaningful(text)
    first = F.substring(clean, 1, 1)
    runs = F.regexp_extract_all(clean, F.concat(F.lit(r"(?:\Q"), first, F.lit(r"\E)+")), F.lit(0))
    best = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    marks = F.length(F.regexp_replace(text, MARKS, ""))
    run = (F.length(clean) > 0) & (best >= 20) & (best * 100 >= F.length(clean) * 85)
    return (F.length(text) >= 16) & (run | ((marks >= 24) & (marks * 100 >= F.length(text) * 85)))


def looks_japanese(text: Column) -> Column:
    """Whether five characters or more, and a quarter of all letters and symbols, are kana or kanji."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20\x{85}\p{Z}\p{P}\p{Nd}]", "")
    japanese = F.regexp_replace(F.coalesce(text, F.lit("")), JAPANESE, "")
    return (F.length(japanese) >= 5) & (F.length(japanese) * 4 >= F.length(letters))


def compact_cue(text: Column) -> Column:
    """A text for a request: as it is up to 80 characters, a sample where it repeats few characters, else its first 500."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    clean = meaningful(trimmed)
    sample = F.when(F.length(clean) > 0, F.substring(clean, 1, 6)).otherwise(F.lit("拟声"))
    return (
        F.when(F.length(trimmed) <= 80, trimmed)
        .when(distinct_chars(clean) <= 6, F.concat(sample, F.lit("（原文为大量重复拟声）")))
        .when(F.length(trimmed) <= 500, trimmed)
        .otherwise(F.concat(F.substring(trimmed, 1, 500), F.lit("…")))
    )


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, trimmed; other texts as they are."""
    inside = F.regexp_extract(text, r"(?s)\A```[^\n]*\n(.*)```", 1)
    fenced = text.rlike(r"(?s)\A```[^\n]*\n.*```")
    return F.when(fenced, F.regexp_replace(inside, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def json_object(text: Column) -> Column:
    """What from_json is to read of an answer: the text without a fence, from its first brace on. What follows the object that
    begins there, such as more prose, is not read by from_json; there is no object without a brace."""
    bare = strip_fence(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", ""))
    at = F.instr(bare, "{")
    return F.when(at > 0, F.substring(bare, at, F.length(bare)))


def file_size(n: Column) -> Column:
    """A number of bytes in GB (two decimals), MB (one) or KB."""
    shown = lambda form, k: F.format_string(f"{form} {'KMG'[k - 1]}B", n / 1024**k)
    return F.when(n >= 1024**3, shown("%.2f", 3)).when(n >= 1024**2, shown("%.1f", 2)).otherwise(shown("%.0f", 1))


def preview(text: Column) -> Column:
    flat = clean_spaces(text)
    return F.when(F.length(flat) <= 160, flat).otherwise(F.concat(F.substring(flat, 1, 160), F.lit("…")))


def contains_term(text: Column, term: Column) -> Column:
    """Terms with an ASCII letter match whole words in any case, others as substrings. Letters beyond 16 bits bound words."""
    blank = (F.length(F.trim(F.coalesce(term, F.lit("")))) == 0) | (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0)
    pattern = F.concat(F.lit(rf"(?iu)(?<!{WORD})\Q"), term, F.lit(rf"\E(?!{WORD})"))
    found = F.when(term.rlike("[A-Za-z]"), F.regexp_like(text, pattern)).otherwise(F.contains(text, term))
    return F.when(blank, F.lit(False)).otherwise(found)


def clock(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours may pass 24."""
    two = lambda v: F.when(v < 10, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    whole = lambda n: F.floor(ms / n).cast("long")
    return F.concat(
        two(whole(3_600_000)), F.lit(":"), two(whole(60_000) % 60), F.lit(":"), two(whole(1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0")
    )


def safe_file_name(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', "_"))
    clean = F.regexp_replace(clean, r"\.+$", "")
    return F.when(F.length(F.trim(clean)) > 0, clean).otherwise(F.lit("video"))


def media_extension(path: Column) -> Column:
    """Whether a path names a video file."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*(f".{e}" for e in MEDIA_EXTENSIONS))


# Extensions of video files.
MEDIA_EXTENSIONS = "3g2 3gp asf avi divx flv m2ts m4v mkv mov mp4 mpeg mpg mts ogm rm rmvb ts vob webm wmv".split()
