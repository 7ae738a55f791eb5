"""The queries of the library: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import text as X
from cuelake import providers
from cuelake.operators import clean, identity, intervals, playback, quality, review, scenes, sinks, targets, terms
from cuelake.plans import recognition, translation
from cuelake.sources import files
from cuelake.sources import fixtures as fx
from cuelake.sources import srt
from cuelake.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _durations(cues: DataFrame) -> DataFrame:
    return cues.groupBy("media_id").agg(F.max("end_ms").alias("audio_ms"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most frequent capitalised words of all conversations: (term, rendering, rank)."""
    found = terms.candidates(fx.conversation_lines(spark, d), (fx.TERM_PATTERN,))
    return found.select("term", F.col("term").alias("rendering"), "n", "rank")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    events = fx.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("run_id"), seq.alias("seq"), "event_type", "value", "event_id", F.floor(fx.micros() / 1000).cast("long").alias("at_ms"), (F.col("event_type") == "error").alias("failed"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    version = lambda n: F.concat(F.lit("v"), n.cast("string"))
    return _ledger(spark, d).select(
        F.col("run_id").alias("media_id"), (F.col("seq") % 7).cast("int").alias("cue_id"), "seq",
        F.when(F.col("seq") % 5 != 0, version(F.col("seq") - 7)).alias("before"), version(F.col("seq")).alias("after"), (~F.col("failed")).alias("accepted"),
    )


@query
def srt_parse(spark: SparkSession, d: str) -> DataFrame:
    return srt.parse(sinks.render(fx.event_cues(spark, d)))


@query
def srt_render(spark: SparkSession, d: str) -> DataFrame:
    return sinks.render(fx.event_cues(spark, d))


@query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.line_cues(spark, d).select("media_id", "pos", X.meaningful(t).alias("clean"), X.for_comparison(t).alias("norm"), X.clean_spaces(t).alias("spaced"), X.looks_japanese(t).alias("japanese"))


@query
def text_compact_repetition(spark: SparkSession, d: str) -> DataFrame:
    return fx.event_cues(spark, d).select("media_id", "cue_id", X.compact_repetition(F.col("text")).alias("short"), X.low_diversity(X.meaningful(F.col("text"))).alias("low"))


@query
def vocalization_flag(spark: SparkSession, d: str) -> DataFrame:
    return fx.event_cues(spark, d).select("media_id", "cue_id", X.vocalization(X.for_comparison(F.col("text"))).alias("vocal"))


@query
def cue_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.cue_issues(fx.event_cues(spark, d))


@query
def cue_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.overlaps(fx.event_cues(spark, d))


@query
def repeat_clusters(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeat_clusters(fx.event_cues(spark, d)).withColumn("cue_ids", F.array_join("cue_ids", ","))


@query
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(fx.event_cues(spark, d))


@query
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(quality.report(fx.event_cues(spark, d))).select("media_id", "reason", "disposition")


@query
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    return clean.sanitize(fx.event_cues(spark, d)).select("media_id", "cue_id", "start_ms", "end_ms", "text", "compacted")


@query
def clean_and_gate(spark: SparkSession, d: str) -> DataFrame:
    out = recognition.clean_and_gate(fx.event_cues(spark, d))
    return out.select("media_id", "cue_count", "removed", "compacted", "n_overlaps", "suspicious", "passed", "reason", "disposition")


@query
def renumber(spark: SparkSession, d: str) -> DataFrame:
    return clean.renumber(fx.event_cues(spark, d)).select("media_id", "cue_id", "start_ms", "end_ms")


@query
def retry_ranges(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    return intervals.retry_ranges(quality.all_issues(cues), _durations(cues)).select("media_id", "piece", "start_ms", "end_ms")


@query
def replace_range(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    ranges = intervals.retry_ranges(quality.all_issues(cues), _durations(cues))
    new = ranges.select("media_id", F.lit(0).alias("cue_id"), (-F.col("piece")).alias("pos"), "start_ms", "end_ms", F.lit("again").alias("text"))
    return intervals.replace_ranges(cues, ranges, new).select("media_id", "cue_id", "start_ms", "end_ms", "text")


@query
def segment_ownership(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    return intervals.owning_segment(cues, _durations(cues)).select("media_id", "cue_id", "segment")


@query
def segments(spark: SparkSession, d: str) -> DataFrame:
    return intervals.segments(_durations(fx.event_cues(spark, d)))


@query
def scenes_of_lines(spark: SparkSession, d: str) -> DataFrame:
    return scenes.build(fx.line_cues(spark, d))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return scenes.build(fx.event_cues(spark, d))


QUERIES["scenes"] = _scenes


@query
def scene_context(spark: SparkSession, d: str) -> DataFrame:
    rows = scenes.context(fx.line_cues(spark, d), 4, 4)
    return rows.select("media_id", "pos", F.array_join("ctx_before", "\n").alias("ctx_before"), F.array_join("ctx_after", "\n").alias("ctx_after"))


@query
def sample_context(spark: SparkSession, d: str) -> DataFrame:
    return scenes.sample(fx.line_cues(spark, d))


@query
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "n", "rank")


@query
def term_context(spark: SparkSession, d: str) -> DataFrame:
    return terms.context_lines(fx.conversation_lines(spark, d), _terms(spark, d), ("conv_id", "turn"))


@query
def term_matches(spark: SparkSession, d: str) -> DataFrame:
    return terms.matches(fx.conversation_lines(spark, d), _terms(spark, d).select("term"), ("conv_id", "turn"))


@query
def glossary_defects(spark: SparkSession, d: str) -> DataFrame:
    return terms.glossary_defects(fx.targets(spark, d), _terms(spark, d).select("term", "rendering"))


@query
def glossary_seed(spark: SparkSession, d: str) -> DataFrame:
    variants = F.array(F.lower("term"), F.substring("term", 1, 3))
    return terms.seed_glossary(_terms(spark, d).select(F.col("rank").alias("ord"), F.col("term").alias("source"), F.upper("term").alias("target"), variants.alias("variants")))


@query
def spell_correct(spark: SparkSession, d: str) -> DataFrame:
    forms = _terms(spark, d).select(F.col("term").alias("variant"), F.upper("term").alias("canonical"), F.col("rank").alias("ord"))
    return terms.correct_spelling(fx.conversation_lines(spark, d), forms, "[A-Za-z]").select("conv_id", "turn", "text")


@query
def term_prompt(spark: SparkSession, d: str) -> DataFrame:
    return terms.prompt(_terms(spark, d).select(F.col("rank").alias("ord"), F.col("term").alias("source")))


@query
def target_defects(spark: SparkSession, d: str) -> DataFrame:
    return targets.defects(fx.targets(spark, d))


@query
def accept_repair(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("media_id") % 3
    proposed = F.when(part == 0, F.col("target")).when(part == 1, F.substring("source", 1, 60)).otherwise(F.substring("source", 1, 200))
    proposals = fx.targets(spark, d).select("media_id", "cue_id", "source", F.col("target").alias("original"), proposed.alias("proposed"))
    conflicts = targets.new_conflicts(proposals, _terms(spark, d).select("term", "rendering"))
    return targets.accept_repairs(proposals, conflicts).select("media_id", "cue_id", "reason", "accepted")


@query
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return targets.completeness(fx.targets(spark, d))


@query
def scene_risk(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    bad = quality.cue_issues(cues).where("severity = 'error'")
    hits = cues.where(F.col("text") == "They bought it")
    return scenes.risk(cues, scenes.build(cues), bad, hits)


@query
def risk_selection(spark: SparkSession, d: str) -> DataFrame:
    return scenes.select_risky(scene_risk(spark, d))


@query
def repair_batches(spark: SparkSession, d: str) -> DataFrame:
    return targets.repair_batches(targets.defects(fx.targets(spark, d)))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """A review response a turn, with missing, empty and uncertain parts, a flag that is no boolean and prose around the object
    by its number. Both columns make its key, as from 100 turns on numbers meet."""
    turns = fx.table(spark, d, "conversations")
    number = F.col("conv_id") * 100 + F.col("turn")
    kind = number % 6
    issue = F.struct(
        F.col("turn").cast("string").alias("id"), F.when(kind == 1, "misheard").otherwise("style").alias("kind"),
        F.when(kind == 0, "").otherwise(F.substring("text", 1, 40)).alias("suggestion"), F.when(kind == 2, F.lit(None)).when(kind == 3, True).otherwise(False).alias("needs_source_check"),
    )
    body = F.to_json(F.struct(F.array(issue).alias("issues")))
    body = F.when(kind == 5, F.replace(body, F.lit('"needs_source_check":false'), F.lit('"needs_source_check":"false"'))).otherwise(body)
    fenced, prose = F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("I looked at it: "), body, F.lit(" That is all {so far}."))
    key = F.when(number.isNotNull(), F.struct("conv_id", "turn"))
    return turns.select(key.alias("response_id"), F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("cue_id"), F.when(number % 2 == 0, fenced).otherwise(prose).alias("content"))


@query
def review_parse(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    rows = review.review_rows(r.select("response_id", "content"), r.select("response_id", "cue_id")).drop("ord")
    return rows.withColumn("response_id", F.col("response_id.conv_id") * 100 + F.col("response_id.turn"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A translation response a conversation, and the cues of its window. By its number it lacks a cue, has a foreign one, or
    gives cues twice."""
    turns = fx.table(spark, d, "conversations")
    row = lambda n, to: F.struct(F.col("turn").cast("string").alias("id"), F.substring("text", 1, to).alias("zh"), F.lit(n).alias("n"))
    once, twice = F.array(row(0, 20)), F.array(row(0, 20), row(1, 10))
    rows = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.array().cast("array<struct<id:string,zh:string,n:int>>")).when(F.col("turn") % 2 == 0, twice).otherwise(once)
    given = turns.select("conv_id", "turn", F.explode(rows).alias("r")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r.n", "turn", "r.id", "r.zh"))).alias("rows"))
    pairs = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["zh"].alias("zh")))
    foreign = F.array(F.struct(F.lit("9999").alias("id"), F.lit("foreign").alias("zh")))
    listed = F.when(F.col("conv_id") % 4 == 1, F.concat(pairs, foreign)).otherwise(pairs)
    glossary = F.create_map(F.concat(F.lit("term"), F.col("conv_id").cast("string")), F.lit(" kept "), F.lit("none"), F.lit(" "))
    body = F.to_json(F.struct(listed.alias("translations"), glossary.alias("glossary_updates")))
    return given.select(F.col("conv_id").alias("response_id"), F.concat(F.lit("Done. "), body).alias("content")), turns.select(F.col("conv_id").alias("response_id"), F.col("turn").cast("int").alias("cue_id"))


@query
def translation_parse(spark: SparkSession, d: str) -> DataFrame:
    return review.translation_rows(*_answers(spark, d))


@query
def glossary_updates(spark: SparkSession, d: str) -> DataFrame:
    return review.glossary_updates(*_answers(spark, d))


@query
def repair_parse(spark: SparkSession, d: str) -> DataFrame:
    answers, window = _answers(spark, d)
    return review.repair_rows(answers, window.where("cue_id % 3 <> 1"))


@query
def suggestion_first(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    rows = review.review_rows(r.select("response_id", "content"), r.select("response_id", "cue_id"))
    issues = rows.join(r.select("response_id", "media_id"), "response_id").withColumn("ord", F.col("response_id"))
    return review.suggestions(issues)


@query
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    long = lambda k: F.round(F.col("value") * k).cast("long")
    requests = _ledger(spark, d).select("run_id", "seq", long(100).alias("tokens"), long(700).alias("chars"), F.floor(F.col("at_ms") / 100000).alias("at_ms"))
    return review.admit(requests).select("run_id", "seq", "admitted")


@query
def budget_thinking(spark: SparkSession, d: str) -> DataFrame:
    """The same requests under the wider limits of thinking."""
    long = lambda k: F.round(F.col("value") * k).cast("long")
    requests = _ledger(spark, d).select("run_id", "seq", long(100).alias("tokens"), long(700).alias("chars"), F.floor(F.col("at_ms") / 100000).alias("at_ms"))
    return review.admit(requests, thinking=True).select("run_id", "seq", "admitted")


@query
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return review.circuit_breaker(_ledger(spark, d).select("run_id", "seq", "failed"))


@query
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    return review.replay(_changes(spark, d))


@query
def journal_undo(spark: SparkSession, d: str) -> DataFrame:
    return review.undo(_changes(spark, d))


@query
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d)
    seq, kind = F.col("seq"), F.col("event_type")
    status = F.when(F.col("failed"), "failed").when(kind.isin("view", "click"), "succeeded").otherwise("skipped")
    windows = rows.select("run_id", seq.alias("scene_idx"), status.alias("status"))
    issues = rows.where(seq % 4 == 0).select("run_id", seq.alias("scene_idx"), (seq % 7).alias("cue_id"), (seq % 8 == 0).alias("needs_source_check"))
    unchanged = seq % 3 == 0
    changes = rows.select("run_id", (seq % 5).alias("cue_id"), (~F.col("failed") & ~unchanged).alias("accepted"), F.when(unchanged, "unchanged").when(F.col("failed"), "deterministic-defect").alias("reason"))
    repairs = rows.where(seq % 10 == 0).select("run_id", F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"))
    remaining = rows.groupBy("run_id").agg(F.count_if(F.col("failed") & (seq % 11 == 0)).alias("defects"), F.count_if((kind == "purchase") & (seq % 13 == 0)).alias("conflicts"))
    return review.summary(windows, issues, changes, repairs, remaining, rows.where("run_id % 3 = 0").select("run_id"))


@query
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.round(F.col("value") * 100).cast("long")
    details = F.when(F.col("seq") % 3 == 0, F.struct((tokens - 50).alias("reasoning_tokens")))
    usage = F.struct(tokens.alias("prompt_tokens"), F.when(F.col("event_type") != "error", tokens + 1).alias("completion_tokens"), details.alias("completion_tokens_details"))
    body = F.when(F.col("event_type") == "purchase", "{}").otherwise(F.to_json(F.struct(usage.alias("usage"))))
    return review.usage(_ledger(spark, d).select("run_id", body.alias("body")))


@query
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", identity.text_hash(F.col("text")).alias("hash"))


@query
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", identity.fingerprint(F.col("text")).alias("fingerprint"))


@query
def variant_keys(spark: SparkSession, d: str) -> DataFrame:
    return identity.variant_keys(identity.cue_digest(fx.event_cues(spark, d)), "p1", "model", "ja", "quality", 4)


@query
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    mine, own, part = identity.text_hash(F.col("text")), identity.text_hash(F.concat("text", F.lit("|ja"))), F.col("doc_id") % 4
    existing = F.when(part == 0, F.lit(None)).when(part == 1, mine).when(part == 2, own).otherwise(F.sha2(F.lit("foreign"), 256))
    files = docs.select(F.col("doc_id").alias("media_id"), existing.alias("existing"), mine.alias("bilingual"))
    return sinks.publish_plan(files, docs.select(F.col("doc_id").alias("media_id"), own.alias("hash")))


@query
def queue_upsert(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("run_id") % 2 == 0, "ja").otherwise("en")
    return live.upsert_queue(_ledger(spark, d).select(F.concat(F.lit("C:/v/"), "event_type").alias("path"), language.alias("language"), F.col("event_id").alias("seq")))


@query
def library_topk(spark: SparkSession, d: str) -> DataFrame:
    folders = fx.table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.max("doc_id").alias("modified"), F.count("*").alias("files"))
    return folders.orderBy(F.desc("modified"), "folder").limit(101)


@query
def language_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", identity.language(F.col("lang")).alias("language"))


@query
def tier_compare(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    return recognition.compare(cues, clean.sanitize(cues))


@query
def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    return recognition.summary(cues, clean.sanitize(cues), cues)


@query
def media_changes(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("seq") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(".mkv"))
    return live.media_changes(_ledger(spark, d).select(F.col("run_id").alias("session"), "seq", path.alias("path")))


@query
def played_media(spark: SparkSession, d: str) -> DataFrame:
    """Paths of an event's type in either case, none for errors; quiet for an hour and more ends a session."""
    kind = F.col("event_type")
    path = F.when(kind != "error", F.concat(F.when(F.col("seq") % 2 == 0, F.upper(kind)).otherwise(kind), F.lit(".mkv")))
    rows = _ledger(spark, d).select(F.col("run_id").alias("session"), F.floor(F.col("at_ms") / 60_000).alias("at_ms"), "seq", path.alias("path"))
    return live.played(rows, 720)


@query
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    return live.sessions(_ledger(spark, d).select(F.col("run_id").alias("key"), F.floor(F.col("at_ms") / 3600).alias("at_ms")))


@query
def mru_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("v"), (F.round(F.col("value") * 10).cast("long") % 97).cast("string"))
    return live.recent(_ledger(spark, d).select((F.col("run_id") % 3).alias("key"), F.col("event_id").alias("seq"), path.alias("path")))


@query
def launch_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d)
    players = F.when(F.col("event_type") == "view", F.array(F.col("event_type"))).when(F.col("event_type") == "click", F.array(F.col("event_type"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    snapshots = rows.select(F.col("run_id").alias("key"), F.floor(F.col("at_ms") / 3600).alias("at_ms"), "seq", players.alias("players"), (F.col("event_type") == "purchase").alias("running"), (F.col("seq") % 4 == 0).alias("starts"))
    return live.launches(snapshots)


def _proposals(pairs: DataFrame) -> DataFrame:
    """A table of proposals: the source between brackets, none for sources with `fail`."""
    return pairs.where(~F.contains("source", F.lit("fail"))).select("media_id", "cue_id", F.concat(F.lit("["), "source", F.lit("]")).alias("proposed"))


@query
def repair_ledger(spark: SparkSession, d: str) -> DataFrame:
    pairs = fx.targets(spark, d)
    return translation.repair(pairs, _proposals(pairs)).select("media_id", "cue_id", "seq", "after", "accepted", "reason")


@query
def repaired_targets(spark: SparkSession, d: str) -> DataFrame:
    pairs = fx.targets(spark, d)
    return translation.apply(pairs, translation.repair(pairs, _proposals(pairs))).select("media_id", "cue_id", "target")


@query
def pending_scenes(spark: SparkSession, d: str) -> DataFrame:
    work = _scenes(spark, d)
    return providers.unfinished(work, work.where("scene_idx % 3 = 0"), "media_id", "scene_idx").select("media_id", "scene_idx")


def _played(spark: SparkSession, d: str) -> DataFrame:
    """The ledger with the path of a file that an event is about: four folders, three names an event type, one of them no video."""
    e = F.col("event_id")
    ending = F.when(e % 5 == 0, ".txt").when(e % 2 == 0, ".MKV").otherwise(".mp4")
    path = F.concat(F.lit("C:/v"), (e % 4).cast("string"), F.lit("/"), "event_type", (e % 3).cast("string"), ending)
    return _ledger(spark, d).withColumn("path", path)


def _present(spark: SparkSession, d: str) -> DataFrame:
    return _played(spark, d).where("event_id % 7 > 0").select("path").distinct()


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Window titles: files, stems, files with more behind, in other case, the player alone, and names of nothing."""
    e, name = F.col("event_id"), playback.file_name(F.col("path"))
    shown = (
        F.when(e % 6 == 0, name).when(e % 6 == 1, playback.stem(F.col("path"))).when(e % 6 == 2, F.concat(name, F.lit(" 1080p")))
        .when(e % 6 == 3, F.upper(name)).when(e % 6 == 4, F.lit("PLAYER")).otherwise(F.concat(F.lit("no "), name))
    )
    title = F.concat(shown, F.when(e % 11 > 0, " - Player").otherwise(""))
    return _played(spark, d).select(F.col("run_id").alias("key"), playback.display_name(title, "Player").alias("shown"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = _played(spark, d).where("event_type <> 'view'")
    return rows.select(F.col("run_id").alias("key"), "path", F.floor(F.col("at_ms") / 3_600_000).alias("at_s"))


@query
def title_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = _played(spark, d)
    known = rows.where("event_type in ('view', 'click') and seq % 3 = 0").groupBy(F.col("run_id").alias("key"), "path").agg(F.max("seq").alias("last_seq"))
    current = rows.where("seq > 4").groupBy(F.col("run_id").alias("key")).agg(F.min_by("path", "seq").alias("path"))
    return playback.resolve(_titles(spark, d), known, current, _links(spark, d), _present(spark, d), 700)


@query
def command_line_media(spark: SparkSession, d: str) -> DataFrame:
    rows = _played(spark, d)
    name = playback.file_name(F.col("path"))
    line = F.concat(
        F.lit('player.exe /new "'), "path", F.lit('" -x file:///D:/a%20b+'), name, F.lit(" "), name, F.lit(' "\\\\host\\v\\'), name, F.lit('" /C:/x.mkv --in=C:/x.mkv "'),
        F.replace("path", F.lit("/v"), F.lit("/V")), F.lit('" file://host/v/'), name, F.lit(" ../"), name,
    )
    there = _present(spark, d).select("path").unionByName(rows.where("event_id % 3 > 0").select(F.explode(F.array(F.concat(F.lit("d:/A b+"), name), F.concat(F.lit("\\\\HOST\\v\\"), name))).alias("path")))
    return playback.command_line_media(rows.select(F.col("run_id").alias("pid"), "seq", line.alias("line")), there)


@query
def next_request(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("seq") % 3 == 1, "  ").otherwise(F.concat(F.lit("C:/v/"), "event_type"))
    rows = _ledger(spark, d).select(F.col("run_id").alias("key"), F.col("event_id").cast("string").alias("name"), F.col("at_ms").alias("modified_ms"), path.alias("path"))
    return files.next_request(rows)


@query
def inbox(spark: SparkSession, d: str) -> DataFrame:
    slots = _ledger(spark, d).groupBy("run_id").agg(F.max("at_ms").alias("at_ms")).withColumn("at_ms", F.floor(F.col("at_ms") / 1000))
    return live.take_inbox(slots, 2_500_000)


@query
def source_choice(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), "source")
    options = F.array(
        F.when(F.col("media_id") % 3 == 0, F.struct(F.lit(0).alias("rank"), F.lit("file").alias("kind"))),
        F.when(F.col("media_id") % 2 == 0, F.struct(F.lit(1).alias("rank"), F.lit("track").alias("kind"))),
        F.struct(F.lit(2).alias("rank"), F.lit("recognised").alias("kind")),
    )
    rows = docs.select("media_id", F.explode(F.array_compact(options)).alias("o"), F.col("source").alias("path"))
    return identity.source_choice(rows.select("media_id", "o.rank", F.col("o.kind").alias("kind"), "path"))


@query
def clip_cues(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    ranges = intervals.retry_ranges(quality.all_issues(cues), _durations(cues))
    found = ranges.select("media_id", "piece", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    found = found.select("media_id", "piece", (F.col("i").cast("long") * 9000 - 2000).alias("start_ms"), (F.col("i").cast("long") * 9000 + 3000).alias("end_ms"))
    return intervals.recognized_in(ranges, found)


@query
def japanese_lines(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("cue_id") % 4
    text = F.concat("text", F.when(part == 0, "漢字仮名文").when(part == 1, " 12, 漢字!").when(part == 2, "東京の空は青い and more words").otherwise(""))
    return fx.event_cues(spark, d).select("media_id", "cue_id", X.looks_japanese(text).alias("japanese"))


@query
def glossary_variants(spark: SparkSession, d: str) -> DataFrame:
    listed = _terms(spark, d).select("term", F.upper("term").alias("rendering"), F.array(F.lower(F.substring("term", 1, 3)), F.lit("and"), F.lit(" ")).alias("variants"))
    return terms.glossary_defects(fx.targets(spark, d), listed)


@query
def term_pass(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.conversation_lines(spark, d).withColumn("media_id", F.col("conv_id"))
    media = lines.where("conv_id % 2 = 0").select("media_id").distinct()
    entries = media.join(_terms(spark, d).select(F.upper("term").alias("source"), F.array("term").alias("variants"), F.col("rank").alias("ord")))
    return recognition.term_pass(lines, entries, "[A-Za-z]").select("conv_id", "turn", "text")


@query
def scene_frames(spark: SparkSession, d: str) -> DataFrame:
    return scenes.frames(fx.event_cues(spark, d), _scenes(spark, d), 4)


@query
def review_frames(spark: SparkSession, d: str) -> DataFrame:
    """Windows over every fourth scene, one of them twice, and one of no scene."""
    built = _scenes(spark, d)
    windows = built.where("scene_idx % 4 = 1").select("media_id", "scene_idx")
    more = windows.where("scene_idx = 1").unionByName(windows.select("media_id", F.lit(9999).alias("scene_idx")))
    return scenes.review_frames(windows.unionByName(more), built, fx.event_cues(spark, d), C.Config.review_context_cues)


@query
def repair_frames(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.line_cues(spark, d)
    rows = scenes.repair_frames(cues, cues.where("cue_id % 9 = 0"), 4)
    return rows.select("media_id", "cue_id", F.array_join("ctx_before", "\n").alias("ctx_before"), F.array_join("ctx_after", "\n").alias("ctx_after"))


def _previous(cues: DataFrame) -> DataFrame:
    """Earlier reports: gated for even media, with nothing counted at first for a third of them."""
    counted = cues.groupBy("media_id").agg(F.count("*").alias("n"))
    m = F.col("media_id")
    return counted.select("media_id", (m % 2 == 0).alias("gated"), F.when(m % 3 == 0, F.lit(0)).otherwise(F.col("n") + 9).alias("initial_count"), (m % 5).alias("removed"), (m % 4).alias("compacted"))


@query
def recovered(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    return recognition.recovered(cues, _previous(cues)).select("media_id", "initial_count", "cue_count", "removed", "compacted", "disposition")


@query
def source_preparation(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    new = recognition.clean_and_gate(cues).select("media_id", "disposition", (F.col("media_id") % 3 > 0).alias("gated"))
    return recognition.prepared(cues.where("media_id % 7 = 0").select("media_id").distinct(), recognition.recovered(cues, _previous(cues)), new)


@query
def pass_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d)
    n = F.round("value").cast("long")
    return recognition.passes(rows.select(F.col("run_id").alias("media_id"), (F.col("seq") % 2).alias("pass"), n.alias("removed"), (n % 7).alias("compacted"), (n % 5).alias("retried"), (n % 3).alias("regions")))


@query
def publish_files(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    part = F.col("doc_id") % 5
    hashed = lambda tail: identity.text_hash(F.concat("text", F.lit(tail)))
    existing = F.when(part == 0, F.lit(None)).when(part == 1, hashed("|b")).when(part == 2, hashed("|s")).when(part == 3, hashed("|old")).otherwise(F.sha2(F.lit("foreign"), 256))
    media = docs.select(
        F.col("doc_id").alias("media_id"), F.concat(F.lit("a:b "), "doc_id").alias("stem"), (F.col("doc_id") % 11 > 0).alias("present"), (F.col("doc_id") % 3 > 0).alias("beside"),
        existing.alias("existing"), F.when(F.col("doc_id") % 2 == 0, hashed("|t")).alias("legacy_target"), F.sha2(F.lit("foreign"), 256).alias("legacy_bilingual"),
        hashed("|s").alias("source"), hashed("|t").alias("target"), hashed("|b").alias("bilingual"), F.array(hashed("|old")).alias("own"),
    )
    return sinks.publish_files(media)


@query
def sidecar_choice(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.concat(F.lit("v"), "doc_id").alias("stem"), "text")
    part = F.col("media_id") % 6
    names = F.when(part == 0, F.array(F.lit(".jp.srt"), F.lit(".jpn.srt"))).when(part == 1, F.array(F.lit(".en.srt"), F.lit(".srt"))).otherwise(F.array(F.lit(".srt")))
    content = F.when(part >= 3, F.concat(F.lit("漢字仮名交じりの文"), F.substring("text", 1, 9))).otherwise(F.substring("text", 1, 50))
    files_ = docs.select("stem", F.explode(names).alias("end"), content.alias("content")).select("stem", F.concat("stem", "end").alias("name"), "content")
    wanted = docs.select("media_id", "stem", F.when(F.col("media_id") % 4 == 1, "en").otherwise("ja").alias("language"))
    own = docs.where(part == 4).select("media_id", identity.text_hash(content).alias("hash"))
    return identity.sidecar_source(files_, wanted, own)


@query
def state_hashes(spark: SparkSession, d: str) -> DataFrame:
    return identity.state_hash(fx.targets(spark, d).where("target is not null").select("media_id", "cue_id", "target"))


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), identity.text_hash(F.col("text")).alias("signature"))


@query
def receipts(spark: SparkSession, d: str) -> DataFrame:
    """A third of all media begin work and half of these complete it."""
    old = _receipts(spark, d)
    force, aside = identity.begin(old, old.where("media_id % 3 = 0").select("media_id"))
    done = aside.where("media_id % 2 = 0").withColumn("signature", F.concat(F.lit("new-"), "signature"))
    return identity.complete(force, done)


@query
def segment_reuse(spark: SparkSession, d: str) -> DataFrame:
    cues = fx.event_cues(spark, d)
    media = cues.select("media_id").distinct()
    file = identity.describe_file(F.lit("a.wav"), F.when(F.col("media_id") % 5 > 0, F.col("media_id")), F.lit(7))
    signed = lambda version: media.select("media_id", identity.segment_signature(version, C.SEGMENT_MS, C.SEGMENT_OVERLAP_MS, "ja", file).alias("signature"))
    stored = signed("v2").where("media_id % 2 = 0").unionByName(signed("v1").where("media_id % 2 = 1"))
    return identity.reusable(stored, signed("v2"), cues).groupBy("media_id").agg(F.max(file).alias("file"), F.count("*").alias("n"))


@query
def queue_complete(spark: SparkSession, d: str) -> DataFrame:
    queued = queue_upsert(spark, d)
    return live.complete(queued, queued.where("seq % 2 = 0").select("key"))


@query
def players_active(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d)
    seen = lambda r: r.groupBy(F.col("run_id").alias("key")).agg(F.array_sort(F.collect_set("event_type")).alias("players"))
    left = live.still_active(seen(rows.where("seq <= 9")), seen(rows.where("seq > 9 and run_id % 2 = 0")))
    return left.select("key", F.array_join("players", ",").alias("players"))


@query
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", X.file_size(F.col("n_chars") * (F.col("doc_id") + 1) * 64).alias("size"))


@query
def library(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    folder = F.concat("source", F.lit("-"), (F.col("doc_id") % 9).cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".SRT").otherwise(".srt"))
    return files.library(docs.select(folder.alias("folder"), name.alias("name"), F.col("doc_id").alias("modified"), (F.col("doc_id") % 9 == 4).alias("linked")))


@query
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """Responses that are cut, empty, blank or not finished, by their number."""
    turns = fx.table(spark, d, "conversations")
    kind = (F.col("conv_id") * 100 + F.col("turn")) % 6
    finish = F.when(kind == 1, "length").when(kind == 3, "tool").when(kind < 5, "stop")
    choice = F.struct(finish.alias("finish_reason"), F.struct(F.when(kind == 4, " ").otherwise(F.col("text")).alias("content")).alias("message"))
    body = F.when(kind == 2, '{"choices":[]}').otherwise(F.to_json(F.struct(F.array(choice).alias("choices"))))
    status, content = review.envelope(F.col("body"))
    return turns.select("conv_id", "turn", body.alias("body")).select("conv_id", "turn", status.alias("status"), content.alias("content"))


@query
def term_parse(spark: SparkSession, d: str) -> DataFrame:
    """A term response a conversation; sources come again, some targets are blank, some variants are missing or double."""
    head = F.substring("text", 1, 3)
    target = F.when(F.col("turn") % 4 == 1, " ").otherwise(F.substring("text", 1, 10))
    variants = F.when(F.col("turn") % 2 == 0, F.array(head, head, F.lit("other")))
    term = F.struct("turn", F.struct(F.concat(F.lit("term"), (F.col("turn") % 3).cast("string")).alias("source"), target.alias("target"), variants.alias("variants")).alias("t"))
    listed = fx.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("response_id")).agg(F.array_sort(F.collect_list(term)).alias("rows"))
    answers = listed.select("response_id", F.concat(F.lit("Terms: "), F.to_json(F.struct(F.col("rows.t").alias("terms"))), F.lit(" Done.")).alias("content"))
    return review.term_rows(answers).withColumn("variants", F.array_join("variants", ","))


@query
def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of some documents, of which signatures, states, reports or outputs have changed since."""
    docs, m = _receipts(spark, d), F.col("media_id")
    kept = docs.where(m % 5 > 0).select("*", F.lit("state").alias("state_hash"), F.lit("report").alias("report_hash"), F.lit("output").alias("output_hash"), (m % 6 == 0).alias("resumable"))
    now = docs.select(
        "media_id", F.when(m % 11 == 0, "new").otherwise(F.col("signature")).alias("signature"), F.when(m % 7 > 0, "state").alias("state_hash"),
        F.when(m % 13 == 0, "other").otherwise("report").alias("report_hash"), F.when(m % 4 == 1, "other").when(m % 4 > 1, "output").alias("output_hash"),
    )
    return identity.probe(kept, now)


@query
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    m, hash_ = F.col("media_id"), F.col("signature")
    key = F.when(m % 3 == 0, F.substring(hash_, 1, 24)).when(m % 3 == 1, F.upper(F.substring(hash_, 1, 24))).otherwise(F.substring(hash_, 1, 23))
    return _receipts(spark, d).select("media_id", identity.is_cache_key(key).alias("valid"))


@query
def resumable(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    status = F.when(F.col("failed"), "failed").when(F.col("event_type") == "purchase", "skipped").otherwise("succeeded")
    window = F.struct(status.alias("status"), (seq % 3).cast("int").alias("attempts"), F.when(seq % 4 == 0, "circuit-open").otherwise("other").alias("reason"))
    runs = _ledger(spark, d).where(seq <= 5).groupBy("run_id").agg(F.collect_list(window).alias("windows"))
    return review.can_resume(runs.withColumn("within_budget", F.col("run_id") % 3 > 0)).select("run_id", "can_resume")


@query
def recent_links(spark: SparkSession, d: str) -> DataFrame:
    return playback.recent_link(_links(spark, d), _titles(spark, d).where("shown is not null"), 700, _present(spark, d))


@query
def current_jobs(spark: SparkSession, d: str) -> DataFrame:
    docs = _receipts(spark, d).groupBy(F.col("signature").alias("fingerprint")).agg(F.min("media_id").alias("n"))
    named = lambda place: F.concat(F.lit(place), F.col("n").cast("string"))
    return playback.current_job(docs.where("n % 3 = 0").select("fingerprint", named("new/").alias("path")), docs.select("fingerprint", named("old/").alias("fallback")))


@query
def retried_cues(spark: SparkSession, d: str) -> DataFrame:
    """Every other range of a medium is recognised anew."""
    cues = fx.event_cues(spark, d)
    ranges = intervals.retry_ranges(quality.all_issues(cues), _durations(cues))
    found = ranges.where("piece % 2 = 0").select("media_id", "piece", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    at = F.col("i").cast("long") * 9000
    new = found.select("media_id", "piece", F.lit(0).alias("cue_id"), (-10 * F.col("piece") - F.col("i") - 1).alias("pos"), (at - 2000).alias("start_ms"), (at + 3000).alias("end_ms"), F.lit("anew").alias("text"))
    return intervals.retry(cues, ranges, new).select("media_id", "cue_id", "start_ms", "end_ms", "text")


def _second(spark: SparkSession, d: str) -> DataFrame:
    return fx.event_cues(spark, d).where("cue_id % 2 = 0").select("media_id", "cue_id", F.concat(F.lit("T"), F.col("cue_id").cast("string")).alias("target"))


@query
def bilingual_render(spark: SparkSession, d: str) -> DataFrame:
    return sinks.render(sinks.bilingual(fx.event_cues(spark, d), _second(spark, d)), "body")


@query
def target_render(spark: SparkSession, d: str) -> DataFrame:
    return sinks.render(sinks.translated(fx.event_cues(spark, d), _second(spark, d)))


@query
def publish_warnings(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("media_id")
    media = _receipts(spark, d).select("media_id", (m % 11 > 0).alias("present"))
    files_ = media.where("present and media_id % 3 > 0").select("media_id", F.when(m % 5 == 4, "foreign").otherwise("write").alias("action"))
    return sinks.publish_warnings(media, files_)


@query
def reverted_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets after a repair that was applied and then undone."""
    pairs = fx.targets(spark, d)
    ledger = translation.repair(pairs, _proposals(pairs))
    return translation.revert(translation.apply(pairs, ledger), ledger).select("media_id", "cue_id", "target")


@query
def trusted_report(spark: SparkSession, d: str) -> DataFrame:
    return recognition.trusted(fx.event_cues(spark, d))


@query
def player_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.when(F.col("seq") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.when(F.col("seq") % 2 == 0, ".EXE").otherwise(""))
    return _ledger(spark, d).select("event_id", playback.is_player(name, ("View", "click")).alias("player"))
