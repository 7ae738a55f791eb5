"""Terms: candidates by frequency, their context lines, matches, canonical forms and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import config as C
from cuelake.functions import automaton

# The patterns of katakana names and of names with an honorific.
KATAKANA_NAME = r"[\x{30a1}-\x{30f6}]{2,}"
HONORIFIC = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]{1,8}(?:さん|ちゃん|くん|さま|様|先生|先輩|お姉ちゃん)"
#: Spellings that go to every row as a map, which is searched entry by entry; longer lists are joined by run.
FORMS_IN_A_ROW = 200


def candidates(cues: DataFrame, patterns: tuple[str, ...] = (KATAKANA_NAME, HONORIFIC), limit: int = C.TERM_LIMIT, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """The most frequent matches of all patterns: (keys, term, n, rank), ties by byte order."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns))
    counted = cues.select(*keys, F.explode(found).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def _not_blank(text: str) -> bool:
    return bool(text.strip(" "))


def hits(rows: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """rows, less their text, joined with each term that the text contains (`text.contains_term`). A row meets the terms that one pass over its
    text has found, so nothing is tried term by term; a term that stands in a third of all rows is a hot key of a join that
    Spark can split."""
    found = automaton.found_terms(rows.where(F.col(text).isNotNull()), text, terms, term, usable=_not_blank)
    return found.join(terms.withColumn("_term", F.col(term)), "_term").drop("_term")


def context_lines(cues: DataFrame, terms: DataFrame, order: tuple[str, ...], lines: int = C.CONTEXT_LINES) -> DataFrame:
    """Lines that are among the first three of some term, in order, at most `lines`, cut to 120 characters. The counters of
    the terms are independent, so a rank by term is enough. A line holds a term wherever its characters stand."""
    lines_ = cues.where("text is not null").select(*order, "text", F.substring("text", 1, C.LINE_CHARS).alias("line"))
    met = automaton.found_terms(lines_, "text", terms, "term", words=False).withColumnRenamed("_term", "term")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(*order))
    first = met.withColumn("r", rank).where(F.col("r") <= C.LINES_PER_TERM).select(*order, "line").distinct()
    return first.orderBy(*order).limit(lines)


def build_context(cues: DataFrame, terms: DataFrame, sampled: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The context lines of the terms, or the sampled lines (same columns) where there are no terms."""
    none = terms.agg((F.count("*") == 0).alias("none"))
    fallback = sampled.join(F.broadcast(none), F.col("none")).drop("none")  # one row
    return context_lines(cues, terms, order).unionByName(fallback)


def matches(cues: DataFrame, terms: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, term) for each term that a text contains."""
    return hits(cues.select(*key, "text"), "text", terms.select("term")).select(*key, "term")


def with_variants(terms: DataFrame) -> DataFrame:
    """(form, rendering): each term and its variants (array `variants`, if there is one), blank ones left out."""
    none = F.array().cast("array<string>")
    variants = F.coalesce("variants", none) if "variants" in terms.columns else none
    forms = terms.where(F.length(F.trim("rendering")) > 0).select(F.explode(F.concat(F.array("term"), variants)).alias("form"), "term", "rendering")
    return forms.where((F.length(F.trim("form")) > 0) & (F.length(F.trim("term")) > 0))


def glossary_defects(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs whose source holds a term (or a variant of it) while the target lacks its rendering: (media_id, cue_id).
    pairs: media_id, cue_id, source, target; terms: term, rendering, variants (optional)."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    usable = pairs.where(~blank("source") & ~blank("target")).select("media_id", "cue_id", "source", "target")
    wrong = hits(usable, "source", with_variants(terms), "form").where(~F.contains("target", "rendering"))
    return wrong.select("media_id", "cue_id").distinct()


def seed_glossary(entries: DataFrame) -> DataFrame:
    """(source, target): canonical sources overwrite, variants only fill gaps; the first entry wins. entries: ord, source,
    target, variants."""
    canonical = entries.select(F.lit(0).alias("rank"), (-F.col("ord")).alias("o"), "source", "target")
    variants = entries.select(F.lit(1).alias("rank"), F.col("ord").alias("o"), F.explode("variants").alias("source"), "target")
    rows = canonical.unionByName(variants).where(F.length(F.trim("source")) > 0)
    return rows.groupBy("source").agg(F.min_by("target", F.struct("rank", "o")).alias("target"))


def correct_spelling(cues: DataFrame, forms: DataFrame, pattern: str) -> DataFrame:
    """cues with whole runs of `pattern` replaced by their canonical form; other text stays. forms: variant, canonical, ord
    (the first entry wins). Few forms, as counted, go to every row as a map; of many, each run of a text is joined."""
    first = forms.groupBy("variant").agg(F.min_by("canonical", "ord").alias("canonical"))
    runs = F.regexp_extract_all("text", F.lit(f"(?:{pattern})+|(?:(?!{pattern})(?s:.))+"), F.lit(0))
    if first.limit(FORMS_IN_A_ROW + 1).count() <= FORMS_IN_A_ROW:
        table = first.agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("forms"))
        fixed = F.array_join(F.transform(runs, lambda r: F.coalesce(F.try_element_at("forms", r), r)), "")
        return cues.crossJoin(F.broadcast(table)).withColumn("text", fixed).drop("forms")
    pieces = cues.select("text").distinct().select("text", F.posexplode(runs).alias("i", "variant")).join(first, "variant", "left")
    row = F.struct("i", F.coalesce("canonical", "variant").alias("run"))
    fixed = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["run"]), "")
    mended = pieces.groupBy("text").agg(fixed.alias("_fixed"))  # one text's runs
    return cues.join(mended, "text", "left").withColumn("text", F.coalesce("_fixed", "text")).select(*cues.columns)


def prompt(terms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sources of a term list in order, joined and cut to 120 characters. terms: ord, source."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "source")))
    text = F.array_join(listed["source"], "、")
    return terms.where(F.length(F.trim("source")) > 0).groupBy(*keys).agg(F.substring(text, 1, C.PROMPT_CHARS).alias("prompt"))
