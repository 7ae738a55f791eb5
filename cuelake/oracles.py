"""DuckDB SQL for the queries of the catalog, over the same parquet tables."""

from __future__ import annotations

from cuelake import config as C
from cuelake.functions.text import MEDIA_EXTENSIONS, VOCALIZATIONS
from cuelake.operators.identity import LANGUAGES
from cuelake.operators.review import UNCERTAIN

SP = r"[\x09-\x0D\x20\x{85}\p{Z}]"


def clean(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\x09-\x0D\x20\x{{85}}\p{{Z}}\p{{P}}\p{{S}}]', '', 'g')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def spaces(x: str) -> str:
    return trimmed(rf"regexp_replace(regexp_replace({x}, '[\r\n]', ' ', 'g'), '[ \t]+', ' ', 'g')")


def unique(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(list_distinct(string_split({x}, ''))) END)"


def low(x: str) -> str:
    return f"(length({x}) >= 16 AND ({unique(x)} <= 3 OR {unique(x)} * 100 <= length({x}) * 18))"


def vocal(x: str) -> str:
    listed = ", ".join(f"'{v}'" for v in VOCALIZATIONS)
    return f"({x} IN ({listed}) OR (length({x}) BETWEEN 1 AND 12 AND {unique(x)} = 1))"


def compact(text: str, m: str) -> str:
    units = f"list_filter(range(1, least(6, length({m}) // 4) + 1), lambda u: len(list_filter(range(length({m})), lambda i: {m}[i + 1] = {m}[i % u + 1])) * 100 >= length({m}) * 85)"
    unit = f"left({m}, CAST({units}[1] AS BIGINT))"
    return f"CASE WHEN NOT {low(m)} THEN {text} WHEN len({units}) > 0 THEN {unit} || '、' || {unit} || '、' || {unit} || '……' ELSE left({m}, 3) || '……' END"


def repetition(x: str) -> str:
    m = clean(x)
    runs = rf"list_max(list_transform(regexp_extract_all({m}, '(?:\Q' || left({m}, 1) || '\E)+'), lambda r: length(r)))"
    marks = rf"length(regexp_replace({x}, '[^\p{{P}}\p{{S}}]', '', 'g'))"
    return (
        f"(length({x}) >= 16 AND ((length({m}) > 0 AND coalesce({runs}, 0) >= 20 AND coalesce({runs}, 0) * 100 >= length({m}) * 85)"
        f" OR ({marks} >= 24 AND {marks} * 100 >= length({x}) * 85)))"
    )


def defect(x: str) -> str:
    t = trimmed(f"coalesce({x}, '')")
    return rf"CASE WHEN {t} = '' THEN 'missing' WHEN regexp_matches({t}, '[\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]') THEN 'source-leak' WHEN length({t}) > 96 THEN 'too-long' WHEN {repetition(t)} THEN 'repetition' END"


def has_term(text: str, term: str) -> str:
    """For terms of one word: a word of the text in any case."""
    words = rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w))"
    return (
        f"(CASE WHEN trim(coalesce({text}, '')) = '' OR trim({term}) = '' THEN false WHEN regexp_matches({term}, '[A-Za-z]') "
        f"THEN contains(lower({text}), lower({term})) AND list_contains({words}, lower({term})) ELSE contains({text}, {term}) END)"
    )


def japanese(x: str) -> str:
    ours = rf"length(regexp_replace({x}, '[^\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]', '', 'g'))"
    letters = rf"length(regexp_replace({x}, '[\x09-\x0D\x20\x{{85}}\p{{Z}}\p{{P}}\p{{Nd}}]', '', 'g'))"
    return f"({ours} >= 5 AND {ours} * 4 >= {letters})"


def clock(ms: str) -> str:
    two = lambda v: f"CASE WHEN {v} < 10 THEN lpad(CAST({v} AS VARCHAR), 2, '0') ELSE CAST({v} AS VARCHAR) END"
    return f"({two(f'({ms} // 3600000)')}) || ':' || ({two(f'({ms} // 60000 % 60)')}) || ':' || ({two(f'({ms} // 1000 % 60)')}) || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


MS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000)"

CUES = f"""cues AS (
  SELECT user_id AS media_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS cue_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, {MS} // 3600 AS start_ms,
         {MS} // 3600 + CAST(round(value * 100) AS BIGINT) AS end_ms,
         CASE event_type WHEN 'view' THEN 'ああ' WHEN 'click' THEN 'A' WHEN 'error' THEN repeat('ん', 17) WHEN 'purchase' THEN 'They bought it'
              ELSE 'We signed the new people in today.' END AS text
  FROM events)"""

LINES = """lines AS (
  SELECT doc_id AS media_id, CAST(i AS INT) AS pos, CAST(i + 1 AS INT) AS cue_id, i * 5000 AS start_ms, i * 5000 + 2000 AS end_ms, l[i + 1] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(len(l))) AS r(i))"""

PAIRS = """pairs AS (
  SELECT conv_id AS media_id, CAST(turn AS INT) AS cue_id, text AS source,
         CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN 'こんにちは' || left(next_text, 20) WHEN conv_id % 5 = 0 THEN repeat('哈', 24)
              ELSE left(next_text, 40 + 20 * turn) END AS target
  FROM (SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

TERMS = f"""terms AS (
  SELECT term, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM (
    SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS term, count(*) AS n FROM conversations GROUP BY 1)) WHERE rank <= {C.TERM_LIMIT})"""

ISSUES = f"""measured AS (SELECT *, end_ms - start_ms AS d, {clean("text")} AS m FROM cues),
flagged AS (SELECT *, length(m) AS n, {low("m")} AS low FROM measured),
single AS (
  SELECT media_id, cue_id, start_ms, end_ms, text, 'invalid-duration' AS kind, 'error' AS severity FROM flagged WHERE d <= 0
  UNION ALL SELECT media_id, cue_id, start_ms, end_ms, text, 'over-30-seconds', 'error' FROM flagged WHERE d > 30000
  UNION ALL SELECT media_id, cue_id, start_ms, end_ms, text, 'low-information-long', 'error' FROM flagged WHERE n <= 3 AND d > 8000
  UNION ALL SELECT media_id, cue_id, start_ms, end_ms, text, 'short-text-long', 'warning' FROM flagged WHERE NOT (n <= 3 AND d > 8000) AND n <= 15 AND d > 15000
  UNION ALL SELECT media_id, cue_id, start_ms, end_ms, text, 'low-character-diversity', 'error' FROM flagged WHERE low),
over_ AS (
  SELECT media_id, b_id AS first_id, cue_id AS second_id, start_ms, greatest(b_end, end_ms) AS end_ms
  FROM (SELECT *, lag(end_ms) OVER w AS b_end, lag(cue_id) OVER w AS b_id FROM cues WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, pos))
  WHERE b_end - start_ms > {C.OVERLAP_MS})"""


def islands(source: str, out: str) -> str:
    return f"""{out}_1 AS (SELECT *, lower({clean("text")}) AS norm FROM {source}),
{out}_2 AS (SELECT *, CASE WHEN norm <> '' AND norm = lag(norm) OVER w AND start_ms - lag(end_ms) OVER w <= {C.REPEAT_GAP_MS} THEN 0 ELSE 1 END AS fresh
  FROM {out}_1 WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, pos)),
{out} AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos ROWS UNBOUNDED PRECEDING) AS island FROM {out}_2)"""


SEVERE = f"(n >= {C.CLUSTER_CUES} AND (n >= {C.SEVERE_CUES} OR span > CASE WHEN vocal THEN {C.SEVERE_VOCAL_MS} ELSE {C.SEVERE_TEXT_MS} END))"

CLUSTERS = f"""{islands("cues", "isl")},
grouped AS (SELECT media_id, island, count(*) AS n, first(norm) AS norm, min(start_ms) AS start_ms, arg_max(end_ms, struct_pack(a := start_ms, b := end_ms, c := pos)) AS end_ms,
  arg_min(cue_id, struct_pack(a := start_ms, b := end_ms, c := pos)) AS first_id, list_sort(list(cue_id)) AS cue_ids FROM isl GROUP BY media_id, island HAVING count(*) >= 3),
clusters AS (SELECT media_id, first_id, n, start_ms, end_ms, CASE WHEN vocal THEN 'repeated-vocalization-cluster' ELSE 'repeated-text-cluster' END AS kind,
  CASE WHEN {SEVERE} THEN 'error' ELSE 'warning' END AS severity, cue_ids FROM (SELECT *, {vocal("norm")} AS vocal, end_ms - start_ms AS span FROM grouped))"""

ALL_ISSUES = """issues AS (
  SELECT media_id, kind, severity, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, [cue_id] AS cue_ids FROM single
  UNION ALL SELECT media_id, 'timeline-overlap', 'error', start_ms, end_ms, [first_id, second_id] FROM over_
  UNION ALL SELECT media_id, kind, severity, start_ms, end_ms, cue_ids FROM clusters)"""

REPORT = f"""{ISSUES}, {CLUSTERS}, {ALL_ISSUES},
counts AS (SELECT media_id, count(*) AS cue_count, greatest(max(d), 0) AS longest_ms, CASE WHEN max(d) > 0 THEN arg_max(cue_id, {{'a': d, 'b': -start_ms, 'c': -end_ms, 'e': -pos}}) ELSE 0 END AS longest_id,
  count(*) FILTER (d > 10000) AS over_10, count(*) FILTER (d > 20000) AS over_20, count(*) FILTER (d > 30000) AS over_30, count(*) FILTER (d > 60000) AS over_60,
  count(*) FILTER (d <= 0) AS invalid_duration, count(*) FILTER (n <= 3 AND d > 8000) AS low_information_long, count(*) FILTER (low) AS low_diversity FROM flagged GROUP BY media_id),
kinds AS (SELECT media_id, count(*) FILTER (kind = 'timeline-overlap') AS n_overlaps, count(*) FILTER (kind LIKE 'repeated-%') AS repeated_clusters,
  count(*) FILTER (kind = 'repeated-vocalization-cluster') AS repeated_vocalizations, count(*) FILTER (severity = 'error') AS errors FROM issues GROUP BY media_id),
susp AS (SELECT media_id, count(DISTINCT id) AS suspicious FROM (SELECT media_id, unnest(cue_ids) AS id FROM issues) GROUP BY media_id),
report AS (SELECT c.*, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(repeated_clusters, 0) AS repeated_clusters, coalesce(repeated_vocalizations, 0) AS repeated_vocalizations,
  coalesce(suspicious, 0) AS suspicious, coalesce(errors, 0) = 0 AS passed FROM counts c LEFT JOIN kinds USING (media_id) LEFT JOIN susp USING (media_id))"""


def gate(removed: str = "0", compacted: str = "0", initial: str = "0") -> str:
    return f"""gated AS (SELECT *, concat_ws(',', CASE WHEN cue_count = 0 THEN 'no-cues' END, CASE WHEN invalid_duration > 0 THEN 'invalid-duration' END,
  CASE WHEN over_60 > 0 THEN 'over-60-seconds' END, CASE WHEN over_30 > greatest(2, ceil(cue_count * 0.01::DOUBLE)) THEN 'too-many-over-30-seconds' END,
  CASE WHEN n_overlaps > greatest(5, ceil(cue_count * 0.02::DOUBLE)) THEN 'too-many-overlaps' END,
  CASE WHEN base >= 20 AND cue_count * 100 < base * 50 THEN 'under-half-kept' END, CASE WHEN base >= 20 AND removed * 100 > base * 40 THEN 'too-much-removed' END,
  CASE WHEN cue_count > 0 AND suspicious * 100 > cue_count * 30 THEN 'too-many-suspicious' END) AS reason
  FROM (SELECT *, {removed} AS removed, {compacted} AS compacted, CASE WHEN {initial} > 0 THEN {initial} ELSE cue_count + {removed} END AS base FROM report)),
decided AS (SELECT *, CASE WHEN reason <> '' THEN 'blocked' WHEN NOT passed OR suspicious >= greatest(5, ceil(cue_count * 0.03::DOUBLE))
  OR removed >= greatest(5, ceil(greatest(base, 1) * 0.03::DOUBLE)) OR compacted >= greatest(5, ceil(greatest(cue_count, 1) * 0.01::DOUBLE)) THEN 'accepted-with-warning' ELSE 'accepted' END AS disposition FROM gated)"""


SANITIZED = f"""c1 AS (SELECT media_id, cue_id, pos, start_ms, end_ms, {spaces("text")} AS text FROM cues),
c2 AS (SELECT *, {clean("text")} AS m FROM c1 WHERE length(text) > 0 AND end_ms - start_ms > 100 AND end_ms - start_ms <= 30000 AND NOT (length({clean("text")}) <= 3 AND end_ms - start_ms > 8000)),
c3 AS (SELECT *, {compact("text", "m")} AS short FROM c2),
c4 AS (SELECT media_id, cue_id, pos, start_ms, CASE WHEN short <> text THEN least(end_ms, start_ms + 4000) ELSE end_ms END AS end_ms, short AS text, short <> text AS compacted FROM c3),
{islands("c4", "i4")},
c5 AS (SELECT *, count(*) OVER g AS n, row_number() OVER o - 1 AS i, min(start_ms) OVER g AS from_ms, last(end_ms) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_ms
  FROM i4 WINDOW g AS (PARTITION BY media_id, island), o AS (PARTITION BY media_id, island ORDER BY start_ms, end_ms, pos)),
c6 AS (SELECT *, {SEVERE} AS bad, CASE WHEN n >= {C.SEVERE_CUES} THEN 3 ELSE 2 END AS keep FROM (SELECT *, to_ms - from_ms AS span, {vocal("norm")} AS vocal FROM c5)),
c7 AS (SELECT media_id, cue_id, pos, start_ms, CASE WHEN bad THEN least(end_ms, start_ms + CASE WHEN vocal THEN 3000 ELSE 8000 END) ELSE end_ms END AS end_ms, text, compacted
  FROM c6 WHERE NOT bad OR list_contains(list_transform(range(keep), lambda s: CAST(round_even(s * (n - 1.0::DOUBLE) / (keep - 1), 0) AS BIGINT)), i)),
c8 AS (SELECT *, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos), end_ms)) AS cut FROM c7),
c9 AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cut, pos) AS INT) AS cue_id, start_ms, cut AS end_ms, text, compacted FROM c8 WHERE cut - start_ms >= {C.SHORTEST_MS})"""

RANGES = f"""dur AS (SELECT media_id, max(end_ms) AS audio_ms FROM cues GROUP BY media_id),
r1 AS (SELECT media_id, greatest(start_ms - {C.PAD_MS}, 0) AS s, least(end_ms + {C.PAD_MS}, audio_ms) AS e FROM issues JOIN dur USING (media_id) WHERE severity = 'error'),
r2 AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r1 WHERE e > s),
r3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {C.MERGE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r2),
r4 AS (SELECT media_id, min(s) AS s, max(e) AS e FROM r3 GROUP BY media_id, g),
r5 AS (SELECT media_id, s + i * {C.PIECE_MS} AS start_ms, least(s + (i + 1) * {C.PIECE_MS}, e) AS end_ms FROM r4, unnest(range((e - s - 1) // {C.PIECE_MS} + 1)) AS u(i)),
ranges AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms) AS INT) AS piece FROM r5) WHERE piece <= {C.RETRY_REGIONS})"""


def scenes(source: str) -> str:
    return f"""src AS (SELECT media_id, pos, start_ms AS s, end_ms AS e, count(*) OVER (PARTITION BY media_id) AS n FROM {source}),
f AS (
  SELECT media_id, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS frm, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS pe, CAST(NULL AS BIGINT) AS ef, CAST(NULL AS BIGINT) AS et, any_value(n) AS n FROM src GROUP BY media_id
  UNION ALL
  SELECT media_id, pos, CASE WHEN pause THEN pos WHEN filled THEN pos + 1 ELSE frm END, CASE WHEN pause THEN s WHEN filled THEN NULL ELSE bb END, e,
         CASE WHEN pause OR filled THEN frm END, CASE WHEN pause THEN pos - 1 WHEN filled THEN pos END, n
  FROM (SELECT src.media_id, CAST(src.pos AS BIGINT) AS pos, f.frm, src.s, src.e, coalesce(f.b, src.s) AS bb, src.n,
               coalesce(src.pos - f.frm >= {C.PAUSE_CUES} AND f.b IS NOT NULL AND src.s - f.pe >= {C.PAUSE_MS}, false) AS pause,
               (src.pos - f.frm + 1 >= 35 OR src.e - coalesce(f.b, src.s) >= 150000) AS filled
        FROM f JOIN src ON src.media_id = f.media_id AND src.pos = f.pos + 1)),
sc AS (SELECT media_id, ef AS a, et AS z FROM f WHERE et IS NOT NULL UNION ALL SELECT media_id, frm, n - 1 FROM f WHERE pos = n - 1 AND frm < n),
scenes AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY a) - 1 AS INT) AS scene_idx, CAST(a AS INT) AS start_pos, CAST(z AS INT) AS end_pos FROM sc)"""


RISK = f"""bad AS (SELECT DISTINCT media_id, cue_id FROM single WHERE severity = 'error'),
hit AS (SELECT media_id, cue_id FROM cues WHERE text = 'They bought it'),
scored AS (SELECT c.media_id, scene_idx, CAST(1 + sum(CASE WHEN b.cue_id IS NULL THEN 0 ELSE 12 END + CASE WHEN h.cue_id IS NULL THEN 0 ELSE 3 END + CASE WHEN end_ms - start_ms > 15000 THEN 2 ELSE 0 END) AS BIGINT) AS score,
  arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms
  FROM cues c JOIN scenes s ON c.media_id = s.media_id AND pos BETWEEN start_pos AND end_pos LEFT JOIN bad b ON b.media_id = c.media_id AND b.cue_id = c.cue_id
  LEFT JOIN hit h ON h.media_id = c.media_id AND h.cue_id = c.cue_id GROUP BY c.media_id, scene_idx)"""


def _selection() -> str:
    out = """p0 AS (SELECT *, first(start_ms) OVER q AS f0, last(end_ms) OVER q AS l0, count(*) OVER (PARTITION BY media_id) AS scenes_n FROM scored
  WINDOW q AS (PARTITION BY media_id ORDER BY scene_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p1 AS (SELECT *, CAST(least(2, (start_ms - f0) * 3 // greatest(1000, l0 - f0)) AS INT) AS third FROM p0),
k0 AS (SELECT *, row_number() OVER (PARTITION BY media_id, third ORDER BY score DESC, scene_idx) = 1 AS chosen FROM p1)"""
    for i in range(C.REVIEW_SCENES - 1):
        out += f""",
w{i} AS (SELECT *, CASE WHEN NOT chosen THEN score / (CASE WHEN coalesce(lag(chosen) OVER o, false) OR coalesce(lead(chosen) OVER o, false) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) END AS worth,
  sum(chosen::INT) OVER (PARTITION BY media_id) AS taken FROM k{i} WINDOW o AS (PARTITION BY media_id ORDER BY scene_idx)),
k{i + 1} AS (SELECT * EXCLUDE (worth, taken, chosen), chosen OR (worth IS NOT NULL AND taken < least({C.REVIEW_SCENES}, scenes_n)
  AND row_number() OVER (PARTITION BY media_id ORDER BY worth DESC NULLS LAST, scene_idx) = 1) AS chosen FROM w{i})"""
    return out


LEDGER = """ledger AS (
  SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_type, value, event_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS at_ms, event_type = 'error' AS failed FROM events)"""

CHANGES = """changes AS (
  SELECT run_id AS media_id, CAST(seq % 7 AS INT) AS cue_id, seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE 'v' || CAST(seq - 7 AS VARCHAR) END AS before,
         'v' || CAST(seq AS VARCHAR) AS after, NOT failed AS accepted FROM ledger)"""

REVIEWS = f"""raw AS (
  SELECT conv_id * 100 + turn AS response_id, conv_id AS media_id, CAST(turn AS INT) AS cue_id, role, text FROM conversations),
reviewed AS (SELECT *, CASE WHEN turn_kind = 0 THEN '' ELSE left(text, 40) END AS suggestion, CASE WHEN turn_kind = 1 THEN 'misheard' ELSE 'style' END AS kind,
  CASE WHEN turn_kind = 2 THEN NULL WHEN turn_kind IN (3, 5) THEN 'no JSON false' ELSE 'false' END AS flag FROM (SELECT *, response_id % 6 AS turn_kind FROM raw)),
parsed AS (SELECT response_id, media_id, cue_id, kind, {trimmed('suggestion')} AS suggestion,
  coalesce(flag, 'missing') <> 'false' OR regexp_matches(kind || ' ' || {trimmed('suggestion')}, '(?i){UNCERTAIN}') AS needs_source_check
  FROM reviewed WHERE length({trimmed('suggestion')}) > 0)"""

TAGS = ", ".join(f"'{x}'" for x in LANGUAGES)

SQL: dict[str, str] = {
    "srt_parse": f"WITH {CUES} SELECT media_id, cue_id, start_ms, end_ms, text FROM cues",
    "text_normalize": f"WITH {LINES} SELECT media_id, pos, {clean('text')} AS clean, lower({clean('text')}) AS norm, {spaces('text')} AS spaced, {japanese('text')} AS japanese FROM lines",
    "text_compact_repetition": f"WITH {CUES}, m AS (SELECT *, {clean('text')} AS m FROM cues) SELECT media_id, cue_id, {compact('text', 'm')} AS short, {low('m')} AS low FROM m",
    "vocalization_flag": f"WITH {CUES}, m AS (SELECT *, lower({clean('text')}) AS norm FROM cues) SELECT media_id, cue_id, {vocal('norm')} AS vocal FROM m",
    "cue_issues": f"WITH {CUES}, {ISSUES} SELECT media_id, cue_id, kind, severity, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, text AS preview FROM single",
    "cue_overlaps": f"WITH {CUES}, {ISSUES} SELECT * FROM over_",
    "repeat_clusters": f"WITH {CUES}, {CLUSTERS} SELECT * EXCLUDE (cue_ids), array_to_string(cue_ids, ',') AS cue_ids FROM clusters",
    "quality_report": f"WITH {CUES}, {REPORT} SELECT * FROM report",
    "gate_decision": f"WITH {CUES}, {REPORT}, {gate()} SELECT media_id, reason, disposition FROM decided",
    "sanitize": f"WITH {CUES}, {SANITIZED} SELECT media_id, cue_id, start_ms, end_ms, text, compacted FROM c9",
    "clean_and_gate": f"""WITH {CUES.replace("cues AS", "all_cues AS")}, {SANITIZED.replace("FROM cues", "FROM all_cues")},
      cues AS (SELECT media_id, cue_id, cue_id - 1 AS pos, start_ms, end_ms, text FROM c9), {REPORT},
      tally AS (SELECT a.media_id, a.n AS initial_n, a.n - coalesce(b.n, 0) AS removed_n, coalesce(b.k, 0) AS compacted_n FROM (SELECT media_id, count(*) AS n FROM all_cues GROUP BY 1) a
        LEFT JOIN (SELECT media_id, count(*) AS n, count(*) FILTER (compacted) AS k FROM c9 GROUP BY 1) b USING (media_id)),
      {gate("(SELECT removed_n FROM tally t WHERE t.media_id = report.media_id)", "(SELECT compacted_n FROM tally t WHERE t.media_id = report.media_id)", "(SELECT initial_n FROM tally t WHERE t.media_id = report.media_id)")}
      SELECT media_id, cue_count, removed, compacted, n_overlaps, suspicious, passed, reason, disposition FROM decided""",
    "renumber": f"WITH {CUES} SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos) AS INT) AS cue_id, start_ms, end_ms FROM cues",
    "retry_ranges": f"WITH {CUES}, {ISSUES}, {CLUSTERS}, {ALL_ISSUES}, {RANGES} SELECT media_id, piece, start_ms, end_ms FROM ranges",
    "replace_range": f"""WITH {CUES}, {ISSUES}, {CLUSTERS}, {ALL_ISSUES}, {RANGES},
      kept AS (SELECT media_id, start_ms, end_ms, pos, text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.media_id = c.media_id AND c.start_ms + c.end_ms >= 2 * r.start_ms AND c.start_ms + c.end_ms < 2 * r.end_ms)
        UNION ALL SELECT media_id, start_ms, end_ms, -piece, 'again' FROM ranges)
      SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos) AS INT) AS cue_id, start_ms, end_ms, text FROM kept""",
    "segment_ownership": f"""WITH {CUES}, dur AS (SELECT media_id, max(end_ms) AS audio_ms FROM cues GROUP BY media_id)
      SELECT media_id, cue_id, CAST(least((start_ms + end_ms) // {2 * C.SEGMENT_MS}, greatest(CAST(ceil(audio_ms / {C.SEGMENT_MS}) AS BIGINT) - 1, 0)) AS INT) AS segment FROM cues JOIN dur USING (media_id)""",
    "segments": f"""WITH {CUES}, dur AS (SELECT media_id, max(end_ms) AS audio_ms FROM cues GROUP BY media_id)
      SELECT media_id, CAST(i AS INT) AS segment, i * {C.SEGMENT_MS} AS core_start, least((i + 1) * {C.SEGMENT_MS}, audio_ms) AS core_end, greatest(i * {C.SEGMENT_MS} - {C.SEGMENT_OVERLAP_MS}, 0) AS clip_start,
        least(least((i + 1) * {C.SEGMENT_MS}, audio_ms) + {C.SEGMENT_OVERLAP_MS}, audio_ms) AS clip_end FROM dur, unnest(range(greatest(CAST(ceil(audio_ms / {C.SEGMENT_MS}) AS BIGINT), 1))) AS u(i)""",
    "scenes": f"WITH RECURSIVE {CUES}, {scenes('cues')} SELECT * FROM scenes",
    "scenes_of_lines": f"WITH RECURSIVE {LINES}, {scenes('lines')} SELECT * FROM scenes",
    "scene_context": f"""WITH {LINES} SELECT media_id, pos, coalesce(array_to_string(list(text) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), chr(10)), '') AS ctx_before,
      coalesce(array_to_string(list(text) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), chr(10)), '') AS ctx_after FROM lines""",
    "sample_context": f"""WITH {LINES}, s AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY media_id) // {C.CONTEXT_LINES}) AS step FROM lines),
      t AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS r FROM s WHERE pos % step = 0 AND trim(text) <> '') SELECT media_id, pos, left(text, {C.LINE_CHARS}) AS line FROM t WHERE r <= {C.CONTEXT_LINES}""",
    "term_candidates": f"WITH {TERMS} SELECT term, n, CAST(rank AS INT) AS rank FROM terms",
    "term_context": f"""WITH {TERMS}, m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY term ORDER BY conv_id, turn) AS r FROM conversations JOIN terms ON contains(text, term)),
      d AS (SELECT DISTINCT conv_id, turn, text FROM m WHERE r <= {C.LINES_PER_TERM}) SELECT conv_id, turn, left(text, {C.LINE_CHARS}) AS line FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS p FROM d) WHERE p <= {C.CONTEXT_LINES}""",
    "term_matches": f"WITH {TERMS} SELECT conv_id, turn, term FROM conversations JOIN terms ON {has_term('text', 'term')}",
    "glossary_defects": f"""WITH {TERMS}, {PAIRS} SELECT media_id, cue_id FROM pairs p WHERE trim(source) <> '' AND trim(coalesce(target, '')) <> ''
      AND EXISTS (SELECT 1 FROM terms WHERE {has_term('p.source', 'term')} AND NOT contains(p.target, term))""",
    "glossary_seed": f"""WITH {TERMS}, e AS (SELECT rank AS ord, term AS source, upper(term) AS target, [lower(term), left(term, 3)] AS variants FROM terms),
      r AS (SELECT 0 AS k, -ord AS o, source, target FROM e UNION ALL SELECT 1, ord, unnest(variants), target FROM e)
      SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, o) AS n FROM r WHERE trim(source) <> '') WHERE n = 1""",
    "spell_correct": f"""WITH {TERMS}, m AS (SELECT map(list(term), list(upper(term))) AS forms FROM terms)
      SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda r: coalesce(forms[r], r)), '') AS text FROM conversations, m""",
    "term_prompt": f"WITH {TERMS} SELECT left(string_agg(term, '、' ORDER BY rank), {C.PROMPT_CHARS}) AS prompt FROM terms",
    "target_defects": f"WITH {PAIRS} SELECT * FROM (SELECT media_id, cue_id, {defect('target')} AS defect FROM pairs) WHERE defect IS NOT NULL",
    "accept_repair": f"""WITH {TERMS}, {PAIRS}, p AS (SELECT *, CASE WHEN media_id % 3 = 0 THEN target WHEN media_id % 3 = 1 THEN left(source, 60) ELSE left(source, 200) END AS proposed FROM pairs),
      j AS (SELECT *, CASE WHEN target IS NOT DISTINCT FROM proposed THEN 'unchanged' WHEN ({defect('proposed')}) IS NOT NULL THEN 'deterministic-defect'
        WHEN EXISTS (SELECT 1 FROM terms WHERE {has_term('p.source', 'term')} AND NOT contains(p.proposed, term) AND (contains(coalesce(p.target, ''), term) OR trim(coalesce(p.target, '')) = '')) THEN 'new-terminology-conflict' END AS reason FROM p)
      SELECT media_id, cue_id, reason, reason IS NULL AS accepted FROM j""",
    "completeness": f"WITH {PAIRS} SELECT media_id, count(*) AS cues, bool_and(trim(coalesce(target, '')) <> '') AS complete FROM pairs GROUP BY media_id",
    "scene_risk": f"WITH RECURSIVE {CUES}, {ISSUES}, {scenes('cues')}, {RISK} SELECT * FROM scored",
    "risk_selection": f"WITH RECURSIVE {CUES}, {ISSUES}, {scenes('cues')}, {RISK}, {_selection()} SELECT media_id, scene_idx, score, third FROM k{C.REVIEW_SCENES - 1} WHERE chosen",
    "repair_batches": f"""WITH {PAIRS}, d AS (SELECT media_id, cue_id FROM (SELECT media_id, cue_id, {defect('target')} AS defect FROM pairs) WHERE defect IS NOT NULL)
      SELECT media_id, cue_id, CAST((row_number() OVER (PARTITION BY media_id ORDER BY cue_id) - 1) // {C.REPAIR_BATCH} AS INT) AS batch FROM d""",
    "review_parse": f"WITH {REVIEWS} SELECT response_id, cue_id, kind, suggestion, needs_source_check FROM parsed",
    "suggestion_first": f"WITH {REVIEWS}, s AS (SELECT media_id, cue_id, bool_or(needs_source_check) AS unsure, arg_min(suggestion, response_id) AS suggestion FROM parsed GROUP BY 1, 2) SELECT media_id, cue_id, suggestion FROM s WHERE NOT unsure",
    "budget_admission": f"""WITH {LEDGER}, r AS (SELECT run_id, seq, CAST(round(value * 100) AS BIGINT) AS tokens, CAST(round(value * 700) AS BIGINT) AS chars, at_ms // 100000 AS at_ms FROM ledger),
      o AS (SELECT *, count(*) OVER w > {C.REQUEST_LIMIT} OR sum(tokens) OVER w > {C.TOKEN_LIMIT} OR chars > {C.REQUEST_CHARS} OR sum(chars) OVER w > {C.TOTAL_CHARS} OR at_ms - min(at_ms) OVER w >= {C.TIME_LIMIT_MS} AS over_
        FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT run_id, seq, NOT max(over_) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS admitted FROM o""",
    "circuit_breaker": f"""WITH {LEDGER}, t AS (SELECT *, coalesce(failed AND lag(failed) OVER (PARTITION BY run_id ORDER BY seq), false) AS trip FROM ledger)
      SELECT run_id, seq, failed, coalesce(max(trip) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM t""",
    "journal_replay": f"WITH {LEDGER}, {CHANGES} SELECT media_id, cue_id, arg_max(after, seq) AS value FROM changes WHERE accepted GROUP BY media_id, cue_id",
    "journal_undo": f"WITH {LEDGER}, {CHANGES} SELECT media_id, cue_id, before AS value FROM (SELECT *, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY seq) AS r FROM changes WHERE accepted) WHERE r = 1",
    "review_summary": f"""WITH {LEDGER}, w AS (SELECT run_id, count(*) AS selected, count(*) FILTER (event_type IN ('view', 'click')) AS reviewed, count(*) FILTER (failed) AS failed,
        count(*) FILTER (failed AND seq % 11 = 0) AS defects, count(*) FILTER (event_type = 'purchase' AND seq % 13 = 0) AS conflicts, count(*) FILTER (failed AND seq % 10 = 0) AS open_repairs FROM ledger GROUP BY 1),
      c AS (SELECT run_id, count(*) FILTER (NOT failed AND seq % 3 > 0) AS fixed, count(*) FILTER (NOT (NOT failed AND seq % 3 > 0) AND seq % 3 = 0) AS unchanged, count(*) FILTER (failed AND seq % 3 > 0) AS rejected FROM ledger GROUP BY 1),
      r AS (SELECT DISTINCT run_id, seq % 5 AS cue_id FROM ledger WHERE NOT failed AND seq % 3 > 0),
      k AS (SELECT run_id, seq % 7 AS cue_id, bool_or(seq % 8 = 0) AS unsure, bool_or(event_type IN ('view', 'click')) AS suggested FROM ledger WHERE seq % 4 = 0 GROUP BY 1, 2),
      i AS (SELECT k.run_id, count(*) FILTER (suggested) AS issues, count(*) FILTER (unsure) AS source_checks, count(*) FILTER (suggested AND r.run_id IS NULL) AS unresolved FROM k LEFT JOIN r ON r.run_id = k.run_id AND r.cue_id = k.cue_id GROUP BY 1),
      a AS (SELECT w.*, c.* EXCLUDE (run_id), coalesce(issues, 0) AS issues, coalesce(source_checks, 0) AS source_checks, coalesce(unresolved, 0) AS unresolved FROM w JOIN c USING (run_id) LEFT JOIN i USING (run_id))
      SELECT *, selected - reviewed - failed AS skipped, defects = 0 AS readable, CASE WHEN reviewed <> selected OR open_repairs > 0 OR defects > 0 OR unresolved > 0 THEN 'partial' ELSE 'limited-review-complete' END AS status,
        concat_ws('; ', CASE WHEN reviewed <> selected THEN 'reviewed ' || reviewed || '/' || selected END, CASE WHEN run_id % 3 = 0 THEN 'limit reached' END, CASE WHEN open_repairs > 0 THEN 'repairs not finished' END,
          CASE WHEN defects > 0 THEN 'defects ' || defects END, CASE WHEN source_checks > 0 THEN 'source checks ' || source_checks END, CASE WHEN unresolved > 0 THEN 'unresolved ' || unresolved END,
          CASE WHEN conflicts > 0 THEN 'term conflicts ' || conflicts END) AS warning FROM a""",
    "text_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "variant_keys": f"""WITH {CUES}, d AS (SELECT media_id, sha256(string_agg(concat_ws('|', cue_id, start_ms, end_ms, text), chr(10) ORDER BY cue_id)) AS digest FROM cues GROUP BY media_id),
      b AS (SELECT *, sha256('p1|model|ja|4|' || digest) AS base_key FROM d) SELECT *, sha256(base_key || '|quality') AS variant_key, left(sha256(base_key || '|quality'), 24) AS folder FROM b""",
    "publish_plan": """WITH f AS (SELECT doc_id AS media_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN sha256(text) WHEN doc_id % 4 = 2 THEN sha256(text || '|ja') ELSE sha256('foreign') END AS existing, sha256(text) AS bilingual, sha256(text || '|ja') AS own FROM documents)
      SELECT media_id, existing, bilingual, CASE WHEN existing IS NULL THEN 'write' WHEN existing = bilingual THEN 'keep' WHEN existing = own THEN 'replace' ELSE 'archive-only' END AS action FROM f""",
    "queue_upsert": f"""WITH {LEDGER}, q AS (SELECT sha1(upper('C:/v/' || event_type || '|' || (CASE WHEN run_id % 2 = 0 THEN 'ja' ELSE 'en' END))) AS key, 'C:/v/' || event_type AS path, CASE WHEN run_id % 2 = 0 THEN 'ja' ELSE 'en' END AS language, event_id AS seq FROM ledger)
      SELECT key, arg_max(path, seq) AS path, arg_max(language, seq) AS language, max(seq) AS seq FROM q GROUP BY key""",
    "library_topk": f"SELECT source AS folder, max(doc_id) AS modified, count(*) AS files FROM documents GROUP BY source ORDER BY modified DESC, folder LIMIT {C.LIBRARY_ROWS + 1}",
    "language_normalize": f"SELECT doc_id, CASE WHEN lower(trim(lang)) IN ({TAGS}) THEN lower(trim(lang)) ELSE 'ja' END AS language FROM documents",
    "tier_compare": f"""WITH {CUES.replace("cues AS", "all_cues AS")}, {SANITIZED.replace("FROM cues", "FROM all_cues")},
      b AS (SELECT count(*) AS cues, sum(end_ms - start_ms) AS speech_ms, max(end_ms - start_ms) AS longest_ms FROM all_cues), a AS (SELECT count(*) AS cues, sum(end_ms - start_ms) AS speech_ms, max(end_ms - start_ms) AS longest_ms FROM c9)
      SELECT 'cues' AS measure, CAST(b.cues AS BIGINT) AS fast, CAST(a.cues AS BIGINT) AS quality FROM a, b UNION ALL SELECT 'speech_ms', CAST(b.speech_ms AS BIGINT), CAST(a.speech_ms AS BIGINT) FROM a, b UNION ALL SELECT 'longest_ms', b.longest_ms, a.longest_ms FROM a, b""",
    "media_changes": f"""WITH {LEDGER}, p AS (SELECT run_id AS session, seq, CASE WHEN seq % 2 = 0 THEN upper(event_type) ELSE event_type END || '.mkv' AS path FROM ledger)
      SELECT * FROM (SELECT *, lag(lower(path)) OVER (PARTITION BY session ORDER BY seq) AS b FROM p) WHERE b IS NULL OR b <> lower(path)""",
    "activity_sessions": f"""WITH {LEDGER}, s AS (SELECT run_id AS key, at_ms // 3600 AS at_ms FROM ledger), i AS (SELECT *, sum(CASE WHEN at_ms - p < {C.INACTIVE_MS} THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY at_ms, p ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT *, lag(at_ms) OVER (PARTITION BY key ORDER BY at_ms) AS p FROM s)) SELECT key, CAST(session AS BIGINT) AS session, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS n FROM i GROUP BY key, session""",
    "mru_paths": f"""WITH {LEDGER}, p AS (SELECT run_id % 3 AS key, event_id AS seq, 'v' || CAST(CAST(round(value * 10) AS BIGINT) % 97 AS VARCHAR) AS path FROM ledger),
      l AS (SELECT key, lower(path) AS f, max(seq) AS last_seq, arg_max(path, seq) AS path FROM p GROUP BY 1, 2) SELECT key, path, last_seq, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY last_seq DESC) AS rank FROM l) WHERE rank <= {C.RECENT_PATHS}""",
}
SQL["media_changes"] = SQL["media_changes"].replace("SELECT * FROM (SELECT *, lag", "SELECT session, seq, path FROM (SELECT *, lag")

REPAIRS = f"""asked AS (SELECT *, CASE WHEN contains(source, 'fail') THEN NULL ELSE '[' || source || ']' END AS after FROM pairs WHERE ({defect("target")}) IS NOT NULL),
judged AS (SELECT *, CASE WHEN after IS NULL THEN 'missing-candidate' WHEN target IS NOT DISTINCT FROM after THEN 'unchanged' WHEN ({defect("after")}) IS NOT NULL THEN 'deterministic-defect' END AS why FROM asked)"""

SQL |= {
    "repair_ledger": f"""WITH {PAIRS}, {REPAIRS} SELECT media_id, cue_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_id) AS seq, after, why IS NULL AS accepted, coalesce(why, 'rule-repair') AS reason FROM judged""",
    "repaired_targets": f"WITH {PAIRS}, {REPAIRS} SELECT p.media_id, p.cue_id, CASE WHEN j.media_id IS NOT NULL THEN j.after ELSE p.target END AS target FROM pairs p LEFT JOIN judged j ON j.media_id = p.media_id AND j.cue_id = p.cue_id AND j.why IS NULL",
    "pending_scenes": f"WITH RECURSIVE {CUES}, {scenes('cues')} SELECT media_id, scene_idx FROM scenes WHERE scene_idx % 3 <> 0",
    "next_request": f"""WITH {LEDGER} SELECT key, name, modified_ms, path FROM (SELECT run_id AS key, CAST(event_id AS VARCHAR) AS name, at_ms AS modified_ms, 'C:/v/' || event_type AS path,
      row_number() OVER (PARTITION BY run_id ORDER BY at_ms, CAST(event_id AS VARCHAR)) AS r FROM ledger WHERE seq % 3 <> 1) WHERE r = 1""",
    "inbox": f"WITH {LEDGER}, s AS (SELECT run_id, max(at_ms) // 1000 AS at_ms FROM ledger GROUP BY 1) SELECT run_id, at_ms FROM s WHERE 2500000 - at_ms <= {C.INBOX_TTL_MS}",
    "source_choice": """SELECT doc_id AS media_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS rank,
      CASE WHEN doc_id % 3 = 0 THEN 'file' WHEN doc_id % 2 = 0 THEN 'track' ELSE 'recognised' END AS kind, source AS path FROM documents""",
}

SQL["content_fingerprint"] = """SELECT doc_id, sha256(encode('cue-content-v1') || unhex(array_to_string(list_reverse(regexp_extract_all(printf('%016X', octet_length(encode(text))), '..')), '')) || encode(text)) AS fingerprint FROM documents"""
SQL["clip_cues"] = f"""WITH {CUES}, {ISSUES}, {CLUSTERS}, {ALL_ISSUES}, {RANGES}, f AS (SELECT r.media_id, r.piece, r.start_ms AS f, r.end_ms AS t, i * 9000 - 2000 AS s, i * 9000 + 3000 AS e FROM ranges r, unnest(range(5)) AS u(i))
  SELECT media_id, s + f AS start_ms, e + f AS end_ms FROM f WHERE s + e + 2 * f >= 2 * f AND s + e + 2 * f < 2 * t"""

SQL["launch_policy"] = f"""WITH RECURSIVE {LEDGER},
  l AS (SELECT run_id AS key, at_ms // 3600 AS at_ms, row_number() OVER (PARTITION BY run_id ORDER BY at_ms // 3600, seq) AS i, event_type = 'purchase' AS running, seq % 4 = 0 AS starts,
    CASE event_type WHEN 'view' THEN ['view'] WHEN 'click' THEN ['click', 'other'] ELSE CAST([] AS VARCHAR[]) END AS players FROM ledger),
  s AS (
    SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS at_ms, CAST([] AS VARCHAR[]) AS pending, CAST([] AS VARCHAR[]) AS known, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS later, false AS launched FROM l
    UNION ALL
    SELECT key, i, at_ms, CASE WHEN running OR (tried AND (starts OR tries + 1 >= {C.LAUNCH_ATTEMPTS})) THEN CAST([] AS VARCHAR[]) ELSE pend END, players,
      CASE WHEN running THEN 0 WHEN tried THEN tries + 1 ELSE tries END, CASE WHEN tried THEN at_ms + {C.COOLDOWN_MS} ELSE later END, tried
    FROM (SELECT *, NOT running AND len(pend) > 0 AND at_ms >= later AS tried FROM (
      SELECT l.*, s.later, list_distinct(list_concat(list_filter(s.pending, lambda x: list_contains(l.players, x)), list_filter(l.players, lambda x: NOT list_contains(s.known, x)))) AS pend,
        CASE WHEN len(list_filter(l.players, lambda x: NOT list_contains(s.known, x))) > 0 THEN 0 ELSE s.attempts END AS tries FROM s JOIN l ON l.key = s.key AND l.i = s.i + 1)))
  SELECT key, at_ms, launched, CAST(len(pending) AS INT) AS pending, CAST(attempts AS INT) AS attempts FROM s WHERE i > 0"""

ANSWERS = f"""a AS (SELECT conv_id AS response_id, CAST(turn AS INT) AS cue_id, {trimmed("CASE WHEN turn % 2 = 0 THEN left(text, 10) ELSE left(text, 20) END")} AS target FROM conversations),
given AS (SELECT * FROM a WHERE NOT (response_id % 4 = 0 AND cue_id = 0) AND target <> '')"""

FULL = f"""{ANSWERS}, full_ AS (SELECT response_id FROM a GROUP BY 1 HAVING response_id % 4 <> 1 AND count(*) = (SELECT count(*) FROM given g WHERE g.response_id = a.response_id))"""

RECOVERED = f"""WITH {CUES.replace("cues AS", "all_cues AS").replace("FROM events", "FROM events WHERE user_id % 2 = 0")}, {SANITIZED.replace("FROM cues", "FROM all_cues")},
  cues AS (SELECT media_id, cue_id, cue_id - 1 AS pos, start_ms, end_ms, text FROM c9), {REPORT},
  tally AS (SELECT a.media_id, CASE WHEN a.media_id % 3 = 0 THEN a.n ELSE a.n + 9 END AS initial_n, a.media_id % 5 + a.n - coalesce(b.n, 0) AS removed_n, a.media_id % 4 + coalesce(b.k, 0) AS compacted_n
    FROM (SELECT media_id, count(*) AS n FROM all_cues GROUP BY 1) a LEFT JOIN (SELECT media_id, count(*) AS n, count(*) FILTER (compacted) AS k FROM c9 GROUP BY 1) b USING (media_id)),
  {gate("(SELECT removed_n FROM tally t WHERE t.media_id = report.media_id)", "(SELECT compacted_n FROM tally t WHERE t.media_id = report.media_id)", "(SELECT initial_n FROM tally t WHERE t.media_id = report.media_id)")}
  SELECT media_id, (SELECT initial_n FROM tally t WHERE t.media_id = decided.media_id) AS initial_count, cue_count, removed, compacted, disposition FROM decided"""


def measures(body: str, name: str) -> str:
    kept = "cue_count, suspicious, removed, over_10, over_20, over_30, longest_ms"
    return f"""SELECT measure, {name} FROM (UNPIVOT (SELECT CAST(coalesce(sum(cue_count), 0) AS BIGINT) AS cue_count, CAST(coalesce(sum(suspicious), 0) AS BIGINT) AS suspicious,
      CAST((SELECT count(*) FROM events) - coalesce(sum(cue_count), 0) AS BIGINT) AS removed, CAST(coalesce(sum(over_10), 0) AS BIGINT) AS over_10, CAST(coalesce(sum(over_20), 0) AS BIGINT) AS over_20,
      CAST(coalesce(sum(over_30), 0) AS BIGINT) AS over_30, CAST(coalesce(max(longest_ms), 0) AS BIGINT) AS longest_ms FROM ({body})) ON {kept} INTO NAME measure VALUE {name})"""


_CLEANED = f"""WITH {CUES.replace("cues AS", "all_cues AS")}, {SANITIZED.replace("FROM cues", "FROM all_cues")}, cues AS (SELECT media_id, cue_id, cue_id - 1 AS pos, start_ms, end_ms, text FROM c9), {REPORT} SELECT * FROM report"""

SQL |= {
    "tier_summary": f"""SELECT f.measure, fast, quality FROM ({measures(f"WITH {CUES}, {REPORT} SELECT * FROM report", "fast")}) f JOIN ({measures(_CLEANED, "quality")}) q ON f.measure = q.measure""",
    "japanese_lines": f"""WITH {CUES}, t AS (SELECT media_id, cue_id, text || CASE cue_id % 4 WHEN 0 THEN '漢字仮名文' WHEN 1 THEN ' 12, 漢字!' WHEN 2 THEN '東京の空は青い and more words' ELSE '' END AS text FROM cues)
      SELECT media_id, cue_id, {japanese('text')} AS japanese FROM t""",
    "translation_parse": f"WITH {FULL} SELECT response_id, cue_id, target FROM given WHERE response_id IN (SELECT response_id FROM full_)",
    "glossary_updates": f"WITH {FULL} SELECT response_id, 'term' || response_id AS source, 'kept' AS target FROM full_",
    "repair_parse": f"WITH {ANSWERS} SELECT response_id, cue_id, target FROM given WHERE cue_id % 3 <> 1",
    "glossary_variants": f"""WITH {TERMS}, {PAIRS}, f AS (SELECT unnest([term, lower(left(term, 3)), 'and']) AS form, upper(term) AS rendering FROM terms)
      SELECT media_id, cue_id FROM pairs p WHERE trim(source) <> '' AND trim(coalesce(target, '')) <> '' AND EXISTS (SELECT 1 FROM f WHERE {has_term('p.source', 'form')} AND NOT contains(p.target, rendering))""",
    "term_pass": f"""WITH {TERMS}, m AS (SELECT map(list(term), list(upper(term))) AS forms FROM terms)
      SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda r: coalesce(forms[r], r)), '') ELSE text END AS text FROM conversations, m""",
    "scene_frames": f"""WITH RECURSIVE {CUES}, {scenes('cues')} SELECT s.media_id, s.scene_idx, CASE WHEN pos < start_pos THEN 'before' WHEN pos > end_pos THEN 'after' ELSE 'target' END AS part, c.pos
      FROM scenes s JOIN cues c ON c.media_id = s.media_id AND c.pos BETWEEN start_pos - 4 AND end_pos + 4""",
    "repair_frames": f"""WITH {LINES}, w AS (SELECT media_id, cue_id, coalesce(array_to_string(list(text) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS ctx_before,
      coalesce(array_to_string(list(text) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)), '') AS ctx_after FROM lines) SELECT * FROM w WHERE cue_id % 9 = 0""",
    "recovered": RECOVERED,
    "source_preparation": f"""WITH r AS ({RECOVERED}), n AS ({SQL["clean_and_gate"]}), m AS (SELECT DISTINCT user_id AS media_id FROM events)
      SELECT media_id, CASE WHEN media_id % 7 = 0 THEN 'accepted' WHEN r.disposition <> 'blocked' THEN 'recovered' ELSE 'recognised' END AS origin,
        media_id % 7 = 0 OR coalesce(r.disposition <> 'blocked', false) OR n.disposition <> 'blocked' OR media_id % 3 = 0 AS can_continue
      FROM m LEFT JOIN r USING (media_id) LEFT JOIN n USING (media_id) WHERE media_id % 7 = 0 OR n.media_id IS NOT NULL""",
    "pass_totals": f"""WITH {LEDGER}, p AS (SELECT run_id AS media_id, CAST(round(value) AS BIGINT) AS n FROM ledger)
      SELECT media_id, CAST(sum(n) AS BIGINT) AS removed, CAST(sum(n % 7) AS BIGINT) AS compacted, CAST(sum(n % 5) AS BIGINT) AS retried, CAST(sum(n % 3) AS BIGINT) AS regions, count(*) AS passes FROM p GROUP BY 1""",
    "publish_files": """WITH f AS (SELECT doc_id, 'a:b ' || doc_id AS stem, doc_id % 5 AS p FROM documents WHERE doc_id % 11 > 0)
      SELECT doc_id AS media_id, 'beside' AS place, stem || '.srt' AS name, 'bilingual' AS text, CASE p WHEN 0 THEN 'write' WHEN 1 THEN 'keep' WHEN 4 THEN 'foreign' ELSE 'replace' END AS action FROM f WHERE doc_id % 3 > 0
      UNION ALL SELECT doc_id, 'beside', stem || '.zh-CN.srt', 'target', 'delete' FROM f WHERE doc_id % 3 > 0 AND doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'archive', replace(stem, ':', '_') || '-' || x || '.srt', x, 'write' FROM f, (VALUES ('bilingual'), ('source'), ('target')) AS v(x)""",
    "state_hashes": f"""WITH {PAIRS} SELECT media_id, sha256('[' || string_agg(to_json([CAST(cue_id AS VARCHAR), target]), ',' ORDER BY CAST(cue_id AS VARCHAR)) || ']') AS hash FROM pairs WHERE target IS NOT NULL GROUP BY 1""",
    "queue_complete": f"SELECT * FROM ({SQL['queue_upsert']}) WHERE seq % 2 <> 0",
    "players_active": f"""WITH {LEDGER}, k AS (SELECT run_id AS key, list_sort(list(DISTINCT event_type)) AS p FROM ledger WHERE seq <= 9 GROUP BY 1), n AS (SELECT run_id AS key, list(DISTINCT event_type) AS p FROM ledger WHERE seq > 9 AND run_id % 2 = 0 GROUP BY 1)
      SELECT key, coalesce(array_to_string(list_filter(k.p, lambda x: list_contains(n.p, x)), ','), '') AS players FROM k LEFT JOIN n USING (key)""",
    "file_sizes": """WITH d AS (SELECT doc_id, n_chars * (doc_id + 1) * 64 AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', round(n / 1073741824, 2)) WHEN n >= 1048576 THEN printf('%.1f MB', round(n / 1048576, 1)) ELSE printf('%.0f KB', round(n / 1024, 0)) END AS size FROM d""",
}

SQL["library"] = f"""WITH f AS (SELECT source || '-' || doc_id % 9 AS folder, max(doc_id) AS modified, count(*) FILTER (doc_id % 3 > 0) AS srt_files FROM documents WHERE doc_id % 9 <> 4 GROUP BY 1)
  SELECT folder, modified, srt_files, (SELECT count(*) FROM f) > {C.LIBRARY_ROWS} AS more FROM f ORDER BY modified DESC, folder LIMIT {C.LIBRARY_ROWS}"""

_CRLF = "chr(13) || chr(10)"


def _rendered(text: str) -> str:
    return f"""WITH {CUES} SELECT media_id, string_agg(CAST(cue_id AS VARCHAR) || {_CRLF} || {clock("start_ms")} || ' --> ' || {clock("end_ms")} || {_CRLF} || {text} || {_CRLF} || {_CRLF}, '' ORDER BY cue_id) AS content FROM cues GROUP BY media_id"""


SQL |= {
    "answer_status": """WITH k AS (SELECT conv_id, turn, (conv_id * 100 + turn) % 6 AS k, text FROM conversations),
      s AS (SELECT *, CASE WHEN k = 2 THEN 'no-choices' WHEN k = 1 THEN 'output-limit' WHEN k = 3 THEN 'not-finished' WHEN k = 4 OR trim(coalesce(text, '')) = '' THEN 'blank' ELSE 'ok' END AS status FROM k)
      SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN text END AS content FROM s""",
    "term_parse": f"""WITH t AS (SELECT conv_id AS response_id, turn, 'term' || turn % 3 AS source, {trimmed("left(text, 10)")} AS target, CASE WHEN turn % 2 = 0 THEN {trimmed("left(text, 3)")} || ',other' ELSE '' END AS variants FROM conversations WHERE turn % 4 <> 1 AND {trimmed("left(text, 10)")} <> '')
      SELECT response_id, source, target, variants FROM (SELECT *, row_number() OVER (PARTITION BY response_id, source ORDER BY turn) AS r FROM t) WHERE r = 1""",
    "cache_probe": """WITH c AS (SELECT doc_id AS m, CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE sha256(text) END AS sig, CASE WHEN doc_id % 7 > 0 THEN 'state' END AS st, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 'report' END AS rep,
        CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'output' END AS o FROM documents),
      r AS (SELECT doc_id AS m, sha256(text) AS sig, doc_id % 6 = 0 AS resumable FROM documents WHERE doc_id % 5 > 0)
      SELECT c.m AS media_id, CASE WHEN r.m IS NULL OR r.sig <> c.sig THEN 'miss' WHEN st IS DISTINCT FROM 'state' OR rep <> 'report' THEN 'error' WHEN o IS DISTINCT FROM 'output' OR resumable THEN 'miss' ELSE 'hit' END AS result
      FROM c LEFT JOIN r ON c.m = r.m""",
    "cache_keys": """SELECT doc_id AS media_id, regexp_full_match(CASE doc_id % 3 WHEN 0 THEN left(sha256(text), 24) WHEN 1 THEN upper(left(sha256(text), 24)) ELSE left(sha256(text), 23) END, '[0-9a-f]{24}') AS valid FROM documents""",
    "resumable": f"""WITH {LEDGER} SELECT run_id, run_id % 3 > 0 AND bool_or((failed AND seq % 3 < 2) OR (event_type = 'purchase' AND seq % 4 = 0)) AS can_resume FROM ledger WHERE seq <= 5 GROUP BY 1""",
    "current_jobs": "SELECT sha256(text) AS fingerprint, CASE WHEN min(doc_id) % 3 = 0 THEN 'new/' ELSE 'old/' END || min(doc_id) AS path FROM documents GROUP BY 1",
    "retried_cues": f"""WITH {CUES}, {ISSUES}, {CLUSTERS}, {ALL_ISSUES}, {RANGES}, hit AS (SELECT * FROM ranges WHERE piece % 2 = 0),
      new_ AS (SELECT media_id, start_ms AS f, end_ms AS t, start_ms + i * 9000 - 2000 AS s, start_ms + i * 9000 + 3000 AS e, -10 * piece - i - 1 AS pos FROM hit, unnest(range(5)) AS u(i)),
      kept AS (SELECT media_id, start_ms, end_ms, pos, text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM hit r WHERE r.media_id = c.media_id AND c.start_ms + c.end_ms >= 2 * r.start_ms AND c.start_ms + c.end_ms < 2 * r.end_ms)
        UNION ALL SELECT media_id, s, e, pos, 'anew' FROM new_ WHERE s + e >= 2 * f AND s + e < 2 * t)
      SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos) AS INT) AS cue_id, start_ms, end_ms, text FROM kept""",
    "srt_render": _rendered("text"),
    "bilingual_render": _rendered(f"text || {_CRLF} || CASE WHEN cue_id % 2 = 0 THEN 'T' || cue_id ELSE '' END"),
    "target_render": _rendered("CASE WHEN cue_id % 2 = 0 THEN 'T' || cue_id ELSE '' END"),
    "publish_warnings": """SELECT doc_id AS media_id, 'medium is gone: kept in the cache only' AS warning FROM documents WHERE doc_id % 11 = 0
      UNION ALL SELECT doc_id, 'foreign sidecar: archived only' FROM documents WHERE doc_id % 11 > 0 AND doc_id % 3 > 0 AND doc_id % 5 = 4""",
    "reverted_targets": f"WITH {PAIRS} SELECT media_id, cue_id, target FROM pairs",
    "trusted_report": f"WITH {CUES}, {REPORT} SELECT * REPLACE (cue_count > 0 AS passed), 'trusted' AS disposition FROM report",
}

_ENDINGS = ", ".join(f"'.{e}'" for e in MEDIA_EXTENSIONS)


def _name(path: str) -> str:
    return f"regexp_extract({path}, '[^/\\\\]*$')"


def _video(path: str) -> str:
    return f"lower(regexp_extract({path}, '[.][^./\\\\]+$')) IN ({_ENDINGS})"


def _titled(shown: str, path: str) -> str:
    name = f"lower({_name(path)})"
    return f"(lower({shown}) = {name} OR lower({shown}) = regexp_replace({name}, '[.][^.]*$', '') OR starts_with(lower({shown}), {name} || ' '))"


PLAYED = f"""{LEDGER}, played AS (SELECT *, 'C:/v' || event_id % 4 || '/' || event_type || event_id % 3 || CASE WHEN event_id % 5 = 0 THEN '.txt' WHEN event_id % 2 = 0 THEN '.MKV' ELSE '.mp4' END AS path FROM ledger),
  there AS (SELECT DISTINCT lower(path) AS f FROM played WHERE event_id % 7 > 0),
  raw AS (SELECT run_id AS key, CASE event_id % 6 WHEN 0 THEN n WHEN 1 THEN regexp_replace(n, '[.][^.]*$', '') WHEN 2 THEN n || ' 1080p' WHEN 3 THEN upper(n) WHEN 4 THEN 'PLAYER' ELSE 'no ' || n END AS shown
    FROM (SELECT *, {_name("path")} AS n FROM played)),
  titles AS (SELECT DISTINCT * FROM raw WHERE lower(shown) <> 'player'),
  links AS (SELECT run_id AS key, path, at_ms // 3600000 AS at_s FROM played WHERE event_type <> 'view'),
  fresh AS (SELECT key, path, r FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_s DESC, path) AS r FROM links)
    WHERE r <= 30 AND 700 - at_s <= 600 AND {_video("path")} AND lower(path) IN (SELECT f FROM there)),
  linked AS (SELECT t.key, t.shown, arg_min(path, r) AS path FROM titles t JOIN fresh l ON t.key = l.key AND {_titled("shown", "path")} GROUP BY ALL)"""

SQL |= {
    "recent_links": f"WITH {PLAYED} SELECT * FROM linked",
    "title_resolution": f"""WITH {PLAYED}, known AS (SELECT run_id AS key, path, max(seq) AS last_seq FROM played WHERE event_type IN ('view', 'click') AND seq % 3 = 0 GROUP BY ALL HAVING lower(path) IN (SELECT f FROM there)),
      pairs AS (SELECT t.key, t.shown, last_seq, CASE WHEN {_titled("shown", "path")} THEN path
          WHEN {_video("shown")} AND lower(left(path, length(path) - length({_name("path")})) || shown) IN (SELECT f FROM there) THEN left(path, length(path) - length({_name("path")})) || shown END AS path
        FROM titles t JOIN known k ON t.key = k.key),
      a AS (SELECT key, shown, arg_max(path, last_seq) AS path FROM pairs WHERE path IS NOT NULL GROUP BY ALL),
      now_ AS (SELECT run_id AS key, arg_min(path, seq) AS path FROM played WHERE seq > 4 GROUP BY 1),
      b AS (SELECT t.key, t.shown, path FROM titles t JOIN now_ n ON t.key = n.key AND {_titled("shown", "path")} AND lower(path) IN (SELECT f FROM there))
      SELECT t.key, t.shown, coalesce(a.path, b.path, c.path) AS path FROM titles t LEFT JOIN a ON t.key = a.key AND t.shown = a.shown LEFT JOIN b ON t.key = b.key AND t.shown = b.shown LEFT JOIN linked c ON t.key = c.key AND t.shown = c.shown""",
    "command_line_media": f"""WITH {PLAYED}, m AS (SELECT *, {_name("path")} AS n FROM played),
      also AS (SELECT f FROM there UNION SELECT lower('d:/A b+' || n) FROM m WHERE event_id % 3 > 0 UNION SELECT lower('\\\\HOST\\v\\' || n) FROM m WHERE event_id % 3 > 0),
      first AS (SELECT run_id AS pid, arg_min(path, seq) AS path, arg_min(n, seq) AS n FROM m GROUP BY 1),
      args AS (SELECT pid, unnest([path, 'D:/a b+' || n, n, '\\\\host\\v\\' || n, replace(path, '/v', '/V'), '../' || n]) AS path FROM first)
      SELECT DISTINCT pid, path FROM args WHERE regexp_matches(path, '^([A-Za-z]:|\\\\)') AND {_video("path")} AND lower(path) IN (SELECT f FROM also)""",
}

SQL["played_media"] = f"""WITH {LEDGER}, e AS (SELECT run_id AS session, at_ms // 60000 AS at_ms, seq, CASE WHEN event_type <> 'error' THEN CASE WHEN seq % 2 = 0 THEN upper(event_type) ELSE event_type END || '.mkv' END AS path FROM ledger),
  g AS (SELECT *, coalesce(at_ms - lag(at_ms) OVER w >= 720, true) AS fresh, coalesce(lead(at_ms) OVER w - at_ms >= 720, true) AS last_one FROM e WINDOW w AS (PARTITION BY session ORDER BY at_ms, seq)),
  i AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY session ORDER BY at_ms, seq) AS island FROM g),
  c AS (SELECT *, lag(lower(path)) OVER (PARTITION BY session, island ORDER BY at_ms, seq) AS before FROM i WHERE path IS NOT NULL),
  q AS (SELECT session, island, at_ms + 720 AS at_ms FROM i WHERE last_one)
  SELECT session, at_ms, path FROM c WHERE before IS NULL OR before <> lower(path)
  UNION ALL SELECT session, at_ms, NULL FROM q WHERE EXISTS (SELECT 1 FROM c WHERE c.session = q.session AND c.island = q.island)"""

# The tags of each language by rank, as the rule of sidecars has them.
_TAGS = ", ".join(f"('{code}', '{tag}', {i})" for code, named in LANGUAGES.items() for i, tag in enumerate(dict.fromkeys((code, *named))))

SQL |= {
    "player_names": f"""WITH {LEDGER}, n AS (SELECT event_id, ' ' || CASE WHEN seq % 3 = 0 THEN upper(event_type) ELSE event_type END || CASE WHEN seq % 2 = 0 THEN '.EXE' ELSE '' END AS name FROM ledger)
      SELECT event_id, regexp_replace(lower(trim(name)), '[.]exe$', '') IN (lower('View'), lower('click')) AS player FROM n""",
    "receipts": """WITH old AS (SELECT doc_id AS media_id, sha256(text) AS signature FROM documents), work AS (SELECT media_id FROM old WHERE media_id % 3 = 0),
      aside AS (SELECT * FROM old WHERE media_id IN (SELECT media_id FROM work)), done AS (SELECT media_id, 'new-' || signature AS signature FROM aside WHERE media_id % 2 = 0),
      force AS (SELECT * FROM old WHERE media_id NOT IN (SELECT media_id FROM work))
      SELECT * FROM force WHERE media_id NOT IN (SELECT media_id FROM done) UNION ALL SELECT * FROM done""",
    "segment_reuse": f"""WITH {CUES}, m AS (SELECT media_id, CASE WHEN size IS NULL THEN 'missing:a.wav' ELSE concat_ws(':', 'a.wav', size, 7) END AS file FROM (SELECT DISTINCT media_id, CASE WHEN media_id % 5 > 0 THEN media_id END AS size FROM cues)),
      signed AS (SELECT media_id, file, v, concat_ws('|', v, {C.SEGMENT_MS}, {C.SEGMENT_OVERLAP_MS}, 'ja', file) AS signature FROM m, (VALUES ('v1'), ('v2')) AS versions(v)),
      stored AS (SELECT media_id, signature FROM signed WHERE v = CASE WHEN media_id % 2 = 0 THEN 'v2' ELSE 'v1' END)
      SELECT c.media_id, max(n.file) AS file, count(*) AS n FROM cues c JOIN signed n ON n.media_id = c.media_id AND n.v = 'v2' JOIN stored t ON t.media_id = c.media_id AND trim(t.signature) = n.signature GROUP BY 1""",
    "sidecar_choice": f"""WITH tags AS (SELECT * FROM (VALUES {_TAGS}) AS v(language, tag, rank)),
      d AS (SELECT doc_id AS media_id, 'v' || doc_id AS stem, doc_id % 6 AS part, text, CASE WHEN doc_id % 4 = 1 THEN 'en' ELSE 'ja' END AS language, CASE WHEN doc_id % 6 >= 3 THEN '漢字仮名交じりの文' || left(text, 9) ELSE left(text, 50) END AS content FROM documents),
      f AS (SELECT stem, stem || unnest(CASE part WHEN 0 THEN ['.jp.srt', '.jpn.srt'] WHEN 1 THEN ['.en.srt', '.srt'] ELSE ['.srt'] END) AS name, content FROM d),
      own AS (SELECT media_id, sha256(content) AS hash FROM d WHERE part = 4),
      found AS (SELECT d.media_id, f.name, t.rank FROM d JOIN tags t ON t.language = d.language JOIN f ON f.stem = d.stem AND f.name = d.stem || '.' || t.tag || '.srt'
        UNION ALL SELECT d.media_id, f.name, 1000 FROM d JOIN f ON f.stem = d.stem AND f.name = d.stem || '.srt' WHERE d.language = 'ja' AND {japanese("left(f.content, 16000)")}
          AND NOT EXISTS (SELECT 1 FROM own WHERE own.media_id = d.media_id AND own.hash = sha256(f.content)))
      SELECT media_id, arg_min(name, rank) AS name FROM found GROUP BY 1""",
    "usage_totals": f"""WITH {LEDGER}, b AS (SELECT run_id, CASE WHEN event_type = 'purchase' THEN '{{}}' ELSE '{{"usage":{{"prompt_tokens":' || t || CASE WHEN event_type <> 'error' THEN ',"completion_tokens":' || (t + 1) ELSE '' END
          || CASE WHEN seq % 3 = 0 THEN ',"completion_tokens_details":{{"reasoning_tokens":' || (t - 50) || '}}' ELSE '' END || '}}}}' END AS body FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS t FROM ledger)),
      u AS (SELECT run_id, TRY_CAST(json_extract_string(body, '$.usage.prompt_tokens') AS BIGINT) AS p, TRY_CAST(json_extract_string(body, '$.usage.completion_tokens') AS BIGINT) AS c,
        TRY_CAST(json_extract_string(body, '$.usage.completion_tokens_details.reasoning_tokens') AS BIGINT) AS r FROM b),
      k AS (SELECT *, p IS NOT NULL AND c IS NOT NULL AS known FROM u)
      SELECT run_id, count(*) AS responses, count(*) FILTER (NOT known) AS unknown, CAST(coalesce(sum(greatest(p, 0)) FILTER (known), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(greatest(c, 0)) FILTER (known), 0) AS BIGINT) AS completion_tokens,
        CAST(coalesce(sum(greatest(r, 0)) FILTER (known), 0) AS BIGINT) AS reasoning_tokens, count(*) FILTER (known AND r IS NOT NULL) AS with_reasoning FROM k GROUP BY run_id""",
    "budget_thinking": SQL["budget_admission"].replace(str(C.TOKEN_LIMIT), str(C.THINKING_TOKEN_LIMIT)).replace(f">= {C.TIME_LIMIT_MS}", f">= {C.THINKING_TIME_LIMIT_MS}"),
    "review_frames": f"""WITH RECURSIVE {CUES}, {scenes('cues')} SELECT s.media_id, s.scene_idx, CASE WHEN pos < start_pos THEN 'before' WHEN pos > end_pos THEN 'after' ELSE 'target' END AS part, c.cue_id, c.text
      FROM scenes s JOIN cues c ON c.media_id = s.media_id AND c.pos BETWEEN start_pos - 8 AND end_pos + 8 WHERE s.scene_idx % 4 = 1""",
}
