"""Review of translations: responses, ledgers, budgets and breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import text as X
from cuelake.functions.tree import entries, field, is_false, items, text_of, tree

# Wording that calls for a look at the source.
UNCERTAIN = "疑为|疑似|误听|核对原文|核对音频|语义不明|意思不完整|可能为|识别错误|transcription|misheard|uncertain"

ENVELOPE = "struct<choices:array<struct<finish_reason:string,message:struct<content:string>>>>"


def envelope(body: Column) -> tuple[Column, Column]:
    """(status, content) of a chat response."""
    parsed = F.from_json(body, ENVELOPE)
    first = F.get(parsed["choices"], 0)
    finish, content = first["finish_reason"], first["message"]["content"]
    status = (
        F.when(parsed.isNull() | (F.coalesce(F.size(parsed["choices"]), F.lit(0)) < 1), "no-choices")
        .when(finish == "length", "output-limit")
        .when((F.length(F.coalesce(finish, F.lit(""))) > 0) & (finish != "stop"), "not-finished")
        .when(F.length(F.trim(F.coalesce(content, F.lit("")))) == 0, "blank")
        .otherwise("ok")
    )
    return status, F.when(status == "ok", content)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{X.SPACE}+|{X.SPACE}+$", "")


def _rows(responses: DataFrame, name: str) -> DataFrame:
    """(response_id, ord, row) of the array `name` of each answer's JSON object, also with prose around the object. Rows are of any
    type."""
    parsed = responses.select("response_id", tree(X.json_object(F.col("content"))).alias("p"))
    return parsed.select("response_id", F.posexplode(items(field(F.col("p"), name))).alias("ord", "row"))


def _int(text: Column) -> Column:
    """A text as a whole number, with white space around it, or null."""
    return F.regexp_extract(_trim(text), r"^[+-]?\d+$", 0).try_cast("int")


def review_rows(responses: DataFrame, windows: DataFrame) -> DataFrame:
    """Issues of review responses: (response_id, cue_id, kind, suggestion, needs_source_check). One bad row (no object, no id, a
    foreign id, no suggestion) fails its whole response. Only a flag that is the JSON value false says that the source needs no
    check. responses: response_id, content; windows: response_id, cue_id."""
    row = F.col("row")
    kind, suggestion = text_of(field(row, "kind")), _trim(text_of(field(row, "suggestion")))
    doubt = F.concat_ws(" ", kind, suggestion).rlike(f"(?i){UNCERTAIN}")
    told = _rows(responses, "issues").select("response_id", "ord", _int(text_of(field(row, "id"))).alias("cue_id"), kind.alias("kind"), suggestion.alias("suggestion"), (~is_false(field(row, "needs_source_check")) | doubt).alias("needs_source_check"))
    inside = windows.select("response_id", "cue_id").distinct().withColumn("inside", F.lit(True))
    joined = told.join(inside, ["response_id", "cue_id"], "left")
    good = F.col("cue_id").isNotNull() & F.coalesce("inside", F.lit(False)) & (F.length("suggestion") > 0)
    all_good = F.bool_and(good).over(Window.partitionBy("response_id"))
    return joined.withColumn("all_good", all_good).where("all_good").select("response_id", "ord", "cue_id", "kind", "suggestion", "needs_source_check")


def _pairs(responses: DataFrame) -> DataFrame:
    """(response_id, ord, id, target) of the translations that have an id and a text; other rows are skipped."""
    rows = _rows(responses, "translations")
    told = rows.select("response_id", "ord", text_of(field(F.col("row"), "id")).alias("id"), _trim(text_of(field(F.col("row"), "zh"))).alias("target"))
    return told.where((F.length("id") > 0) & (F.length("target") > 0))


def _complete(responses: DataFrame, windows: DataFrame) -> DataFrame:
    """(response_id, rows): the responses that give each cue of their window and no other; rows: cue_id and target, the last one
    of a cue."""
    want = windows.select("response_id", "cue_id", F.col("cue_id").cast("string").alias("id")).distinct()
    last = _pairs(responses).groupBy("response_id", "id").agg(F.max_by("target", "ord").alias("target"))
    got = last.join(want, ["response_id", "id"], "left").groupBy("response_id").agg(
        F.count("*").alias("n"), F.count("cue_id").alias("hits"), F.collect_list(F.struct("cue_id", "target")).alias("rows")
    )  # one answer's
    full = want.groupBy("response_id").agg(F.count("*").alias("want")).join(got, "response_id").where("n = want and hits = want")
    return full.select("response_id", "rows")


def translation_rows(responses: DataFrame, windows: DataFrame) -> DataFrame:
    """(response_id, cue_id, target) of the responses that give each cue of their window and no other; the last target of an id
    counts. responses: response_id, content; windows: response_id, cue_id."""
    return _complete(responses, windows).select("response_id", F.inline("rows"))


def glossary_updates(responses: DataFrame, windows: DataFrame) -> DataFrame:
    """(response_id, source, target): what complete translation responses add to the glossary."""
    added = entries(field(tree(X.json_object(F.col("content"))), "glossary_updates"))
    found = responses.select("response_id", F.explode(added).alias("source", "value")).select("response_id", "source", _trim(text_of(F.col("value"))).alias("target"))
    return found.where((F.length(_trim(F.col("source"))) > 0) & (F.length("target") > 0)).join(_complete(responses, windows).select("response_id"), "response_id", "left_semi")


def repair_rows(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(response_id, cue_id, target) of repair responses: a part of the wanted cues is enough, other cues are ignored, and the
    last target of a cue counts. wanted: response_id, cue_id."""
    rows = _pairs(responses).withColumn("cue_id", _int(F.col("id"))).where("cue_id is not null")
    last = rows.groupBy("response_id", "cue_id").agg(F.max_by("target", "ord").alias("target"))
    return last.join(wanted.select("response_id", "cue_id").distinct(), ["response_id", "cue_id"], "left_semi")


def term_rows(responses: DataFrame) -> DataFrame:
    """(response_id, source, target, variants) of term responses: incomplete rows are skipped, the first of a source wins."""
    row = F.col("row")
    said = lambda name: _trim(text_of(field(row, name))).alias(name)
    variants = F.filter(F.transform(F.coalesce(items(field(row, "variants")), F.array().cast("array<variant>")), lambda v: _trim(text_of(v))), lambda v: F.length(v) > 0)
    full = _rows(responses, "terms").select("response_id", "ord", said("source"), said("target"), F.array_distinct(variants).alias("variants"))
    full = full.where((F.length("source") > 0) & (F.length("target") > 0))
    first = F.row_number().over(Window.partitionBy("response_id", "source").orderBy("ord"))
    return full.withColumn("r", first).where("r = 1").select("response_id", "source", "target", "variants")


def suggestions(issues: DataFrame) -> DataFrame:
    """(media_id, cue_id, suggestion): the first suggestion of each cue that no issue marks as uncertain."""
    sure = issues.groupBy("media_id", "cue_id").agg(F.bool_or("needs_source_check").alias("unsure"), F.min_by("suggestion", "ord").alias("suggestion"))
    return sure.where(~F.col("unsure")).drop("unsure")


def admit(requests: DataFrame, thinking: bool = False) -> DataFrame:
    """requests (run_id, seq, tokens, chars, at_ms) with `admitted`: the longest prefix of each run within its limits. Time is up
    when the limit is reached."""
    tokens, time_ms = (C.THINKING_TOKEN_LIMIT, C.THINKING_TIME_LIMIT_MS) if thinking else (C.TOKEN_LIMIT, C.TIME_LIMIT_MS)
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (
        (F.count("*").over(w) > C.REQUEST_LIMIT)
        | (F.sum("tokens").over(w) > tokens)
        | (F.col("chars") > C.REQUEST_CHARS)
        | (F.sum("chars").over(w) > C.TOTAL_CHARS)
        | (F.col("at_ms") - F.min("at_ms").over(w) >= time_ms)
    )
    return requests.withColumn("over", over).withColumn("admitted", ~F.max("over").over(w)).drop("over")


def circuit_breaker(windows: DataFrame) -> DataFrame:
    """windows (run_id, seq, failed) with `skipped`: those after the first two failures in a row."""
    w = Window.partitionBy("run_id").orderBy("seq")
    trip = F.coalesce(F.col("failed") & F.lag("failed").over(w), F.lit(False))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("trip", trip).withColumn("skipped", F.coalesce(F.max("trip").over(before), F.lit(False))).drop("trip")


def replay(changes: DataFrame) -> DataFrame:
    """The state after all accepted changes: (media_id, cue_id, value); the last one counts. changes: seq, before, after."""
    return changes.where("accepted").groupBy("media_id", "cue_id").agg(F.max_by("after", "seq").alias("value"))


def undo(changes: DataFrame) -> DataFrame:
    """The state before all accepted changes: the first one's `before` (null: no entry)."""
    return changes.where("accepted").groupBy("media_id", "cue_id").agg(F.min_by(F.struct("before"), "seq")["before"].alias("value"))


USAGE = "struct<usage:struct<prompt_tokens:string,completion_tokens:string,completion_tokens_details:struct<reasoning_tokens:string>>>"


def usage(responses: DataFrame) -> DataFrame:
    """Token totals by run: prompt, completion and reasoning tokens, how many responses told the last, and how many told no
    prompt or no completion tokens, whose tokens are unknown. responses: run_id, body (JSON)."""
    told = F.from_json("body", USAGE)["usage"]
    number = lambda c: c.try_cast("bigint")
    rows = responses.select("run_id", number(told["prompt_tokens"]).alias("p"), number(told["completion_tokens"]).alias("c"), number(told["completion_tokens_details"]["reasoning_tokens"]).alias("r"))
    known = F.col("p").isNotNull() & F.col("c").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(known, F.greatest(F.col(c), F.lit(0)))), F.lit(0))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("responses"), F.count_if(~known).alias("unknown"), total("p").alias("prompt_tokens"), total("c").alias("completion_tokens"),
        total("r").alias("reasoning_tokens"), F.count_if(known & F.col("r").isNotNull()).alias("with_reasoning"),
    )


def summary(windows: DataFrame, issues: DataFrame, changes: DataFrame, repairs: DataFrame, remaining: DataFrame, exhausted: DataFrame) -> DataFrame:
    """One row a run, with its counts, status and warnings. windows: run_id, scene_idx, status; issues: run_id, scene_idx, cue_id,
    needs_source_check; changes: run_id, cue_id, accepted, reason; repairs: run_id, status; remaining: run_id, defects,
    conflicts (what rules and glossary still find); exhausted: run_id of the runs that reached a limit."""
    w = windows.groupBy("run_id").agg(
        F.count("*").alias("selected"), F.count_if(F.col("status") == "succeeded").alias("reviewed"), F.count_if(F.col("status").isin("failed", "interrupted")).alias("failed")
    )
    c = changes.groupBy("run_id").agg(
        F.count_if("accepted").alias("fixed"), F.count_if(F.col("reason") == "unchanged").alias("unchanged"),
        F.count_if(~F.col("accepted") & (F.coalesce("reason", F.lit("")) != "unchanged")).alias("rejected"),
    )
    repaired = changes.where("accepted").select("run_id", "cue_id").distinct().withColumn("repaired", F.lit(True))
    done = windows.where("status = 'succeeded'").select("run_id", "scene_idx").distinct().withColumn("done", F.lit(True))
    by_cue = issues.join(done, ["run_id", "scene_idx"], "left").groupBy("run_id", "cue_id").agg(F.bool_or("needs_source_check").alias("unsure"), F.bool_or(F.coalesce("done", F.lit(False))).alias("suggested"))
    i = by_cue.join(repaired, ["run_id", "cue_id"], "left").groupBy("run_id").agg(
        F.count_if("suggested").alias("issues"), F.count_if("unsure").alias("source_checks"),
        F.count_if(F.col("suggested") & F.col("repaired").isNull()).alias("unresolved"),
    )
    r = repairs.groupBy("run_id").agg(F.count_if(F.col("status") != "succeeded").alias("open_repairs"))
    out = w
    for part in (c, i, r, remaining, exhausted.select("run_id").distinct().withColumn("over", F.lit(1))):
        out = out.join(part, "run_id", "left")
    out = out.na.fill(0).withColumn("skipped", F.expr("selected - reviewed - failed"))
    partial = F.expr("reviewed <> selected or open_repairs > 0 or defects > 0 or unresolved > 0")
    warnings = (
        ("reviewed <> selected", "concat('reviewed ', reviewed, '/', selected)"), ("over > 0", "'limit reached'"), ("open_repairs > 0", "'repairs not finished'"),
        ("defects > 0", "concat('defects ', defects)"), ("source_checks > 0", "concat('source checks ', source_checks)"),
        ("unresolved > 0", "concat('unresolved ', unresolved)"), ("conflicts > 0", "concat('term conflicts ', conflicts)"),
    )
    warning = F.concat_ws("; ", *(F.when(F.expr(when), F.expr(text)) for when, text in warnings))
    return out.select(
        "run_id", "selected", "reviewed", "failed", "skipped", "issues", "source_checks", "fixed", "unchanged", "rejected", "unresolved", "open_repairs", "defects", "conflicts",
        (F.col("defects") == 0).alias("readable"), F.when(partial, "partial").otherwise("limited-review-complete").alias("status"), warning.alias("warning"),
    )


def can_resume(runs: DataFrame) -> DataFrame:
    """runs (run_id, within_budget, windows: array<struct<status, attempts, reason>>) with `can_resume`."""
    def open_(x: Column) -> Column:
        return ((x["status"] == "failed") & (x["attempts"] < 2)) | ((x["status"] == "skipped") & x["reason"].isin("missing-api-key", "circuit-open"))

    return runs.withColumn("can_resume", F.col("within_budget") & F.exists("windows", open_))
