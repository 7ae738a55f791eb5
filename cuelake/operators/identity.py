"""Content identity: fingerprints, keys, and whether stored results still hold."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.functions.fold import fold

TAG = "cue-content-v1"
SEGMENT, SEGMENTS, SMALL = 256 * 1024, 9, 16 * 1024 * 1024


def fingerprint(content: Column, tag: str = TAG) -> Column:
    """SHA-256 over a tag, the length and the bytes; above SMALL bytes over nine evenly spaced segments, each after its
    offset."""
    n = F.octet_length(content)
    raw = content.cast("binary")
    le = lambda v: F.unhex(F.regexp_replace(F.reverse(F.lpad(F.hex(v), 16, "0")), "(.)(.)", "$2$1"))
    head = F.concat(F.lit(tag).cast("binary"), le(n.cast("long")))
    offsets = [((n - SEGMENT) * i / (SEGMENTS - 1)).cast("long") for i in range(SEGMENTS)]
    parts = [F.concat(le(o), F.substring(raw, (o + 1).cast("int"), F.lit(SEGMENT))) for o in offsets]
    return F.when(n <= SMALL, F.sha2(F.concat(head, raw), 256)).otherwise(F.sha2(F.concat(head, *parts), 256))


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ordered_digest(rows: DataFrame, order: list[str], value: str, head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """(media_id, digest): SHA-256 over the values of a medium in order, with texts around and between them. Rows are dealt by
    medium, sorted and read as a stream, of which a task holds the state of one hash."""

    def step(state: tuple, row: tuple) -> tuple:
        digest, begun = state
        digest.update((between if begun else head).encode())
        digest.update((row[1] or "").encode())
        return (digest, True), []

    def finish(state: tuple, media_id: object) -> list[tuple]:
        state[0].update(tail.encode())
        return [(media_id, state[0].hexdigest())]

    of = rows.schema["media_id"].dataType.simpleString()
    columns = rows.select("media_id", F.col(value).alias("_value"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    return fold(columns, "media_id", [f"_o{i}" for i in range(len(order))], lambda: (hashlib.sha256(), False), step, finish, f"media_id {of}, digest string")


def cue_digest(cues: DataFrame) -> DataFrame:
    """(media_id, digest) over all cues in order, from one canonical line a cue."""
    line = F.concat_ws("|", F.col("cue_id"), F.col("start_ms"), F.col("end_ms"), "text")
    return ordered_digest(cues.select("media_id", "cue_id", line.alias("line")), ["cue_id", "line"], "line", between="\n")


def variant_keys(digests: DataFrame, policy: str, model: str, language: str, tier: str, context: int) -> DataFrame:
    """digests with base_key (what the base translation depends on) and variant_key (and its tier)."""
    base = F.sha2(F.concat_ws("|", F.lit(policy), F.lit(model), F.lit(language), F.lit(str(context)), "digest"), 256)
    keyed = digests.withColumn("base_key", base)
    return keyed.withColumn("variant_key", F.sha2(F.concat_ws("|", "base_key", F.lit(tier)), 256)).withColumn("folder", F.substring("variant_key", 1, 24))


def is_cache_key(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{24}$")


def probe(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """hit, miss or error for each wanted (media_id, signature) with its current hashes. A state or report that differs
    from its receipt is an error; missing or changed outputs only miss."""
    r = receipts.select("media_id", *(F.col(c).alias(f"r_{c}") for c in ("signature", "state_hash", "report_hash", "output_hash", "resumable")))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"r_{c}"))
    result = (
        F.when(F.col("r_signature").isNull() | ~same("signature"), "miss")
        .when(~same("state_hash") | ~same("report_hash"), "error")
        .when(F.col("output_hash").isNull() | ~same("output_hash") | F.coalesce("r_resumable", F.lit(False)), "miss")
        .otherwise("hit")
    )
    return current.join(r, "media_id", "left").select("media_id", result.alias("result"))


def source_choice(candidates: DataFrame) -> DataFrame:
    """The first source of each medium by rank: external file, embedded track, recognition. candidates: media_id, rank,
    source, path."""
    first = F.row_number().over(Window.partitionBy("media_id").orderBy("rank", "path"))
    return candidates.withColumn("r", first).where("r = 1").drop("r")


# Languages and the tags that name them in file names.
LANGUAGES = {
    "ja": ("jpn", "ja", "jp"), "en": ("eng", "en"), "ko": ("kor", "ko"), "zh": ("zho", "chi", "zh"), "fr": ("fra", "fre", "fr"), "de": ("deu", "ger", "de"),
    "es": ("spa", "es"), "it": ("ita", "it"), "pt": ("por", "pt"), "ru": ("rus", "ru"), "th": ("tha", "th"), "vi": ("vie", "vi"),
}


def language(code: Column) -> Column:
    """A known language code, trimmed and in lower case, or the first one."""
    clean = F.lower(F.trim(code))
    return F.when(clean.isin(*LANGUAGES), clean).otherwise(F.lit(next(iter(LANGUAGES))))


#: Characters at the beginning of an untagged file that tell whether it is Japanese.
SAMPLE_CHARS = 16_000


def sidecar_source(files: DataFrame, wanted: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The subtitle beside each medium: `<stem>.<tag>.srt` by the language's tags in order; for Japanese also `<stem>.srt`, if it
    looks Japanese and is not among our own outputs. files: stem, name, content (optional: without it no untagged file is
    taken); wanted: media_id, stem, language; own: media_id and hash of all texts that we made for a medium."""
    spark = files.sparkSession
    tags = [(c, t, i) for c, named in LANGUAGES.items() for i, t in enumerate(dict.fromkeys((c, *named)))]
    ranked = wanted.join(F.broadcast(spark.createDataFrame(tags, "language string, tag string, rank int")), "language")  # fixed size
    ranked = ranked.withColumn("name", F.concat("stem", F.lit("."), "tag", F.lit(".srt"))).select("media_id", "stem", "name", "rank")
    found = ranked.join(files.select("stem", "name"), ["stem", "name"]).select("media_id", "name", "rank")
    if "content" in files.columns:
        last = max(r for _, _, r in tags) + 1
        plain = wanted.where("language = 'ja'").select("media_id", "stem", F.concat("stem", F.lit(".srt")).alias("name"))
        untagged = plain.join(files.select("stem", "name", "content"), ["stem", "name"]).where(X.looks_japanese(F.substring("content", 1, SAMPLE_CHARS)))
        if own is not None:
            untagged = untagged.withColumn("hash", text_hash(F.col("content"))).join(own.select("media_id", "hash"), ["media_id", "hash"], "left_anti")
        found = found.unionByName(untagged.select("media_id", "name", F.lit(last).alias("rank")))
    return found.groupBy("media_id").agg(F.min_by("name", "rank").alias("name"))


def state_hash(translations: DataFrame) -> DataFrame:
    """(media_id, hash) of all translations of a medium, as JSON pairs in the order of their ids as texts."""
    id_ = F.col("cue_id").cast("string")
    pairs = translations.select("media_id", id_.alias("id"), F.to_json(F.array(id_, "target")).alias("pair"))
    return ordered_digest(pairs, ["id", "pair"], "pair", "[", ",", "]").withColumnRenamed("digest", "hash")


def begin(receipts: DataFrame, work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts still in force, receipts set aside) as work on media begins: a commit marker goes before its outputs change."""
    media = work.select("media_id").distinct()
    return receipts.join(media, "media_id", "left_anti"), receipts.join(media, "media_id", "left_semi")


def complete(receipts: DataFrame, done: DataFrame) -> DataFrame:
    """receipts with those of finished media (same columns) in the place of older ones."""
    return receipts.join(done.select("media_id").distinct(), "media_id", "left_anti").unionByName(done)


def segment_signature(version: str, segment_ms: int, overlap_ms: int, language: str, *inputs: Column) -> Column:
    """What recognised segments depend on: its settings and a description of each input file."""
    return F.concat_ws("|", F.lit(version), F.lit(str(segment_ms)), F.lit(str(overlap_ms)), F.lit(language), *inputs)


def describe_file(name: Column, size: Column, modified: Column) -> Column:
    """A file by name, size and time; one without a size is missing."""
    return F.when(size.isNull(), F.concat(F.lit("missing:"), name)).otherwise(F.concat_ws(":", name, size.cast("string"), modified.cast("string")))


def reusable(stored: DataFrame, current: DataFrame, cues: DataFrame) -> DataFrame:
    """The stored cues that can be used again: their medium's stored signature is exactly the current one. stored, current:
    media_id, signature; cues: media_id and more. A medium without cues has nothing to use."""
    same = current.select("media_id", "signature").join(stored.select("media_id", F.trim("signature").alias("signature")), ["media_id", "signature"], "left_semi")
    return cues.join(same.select("media_id").distinct(), "media_id", "left_semi")
