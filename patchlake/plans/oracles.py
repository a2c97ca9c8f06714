"""Oracle SQL: the same questions for DuckDB over the same parquet tables."""

from __future__ import annotations

from patchlake.functions import columns as C, rules
from patchlake.operators import evaluation as ev, findings as fi


def case(column: str, table: dict, default: object = 0) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


SEV, EVI, STA = case("severity", C.SEVERITY_RANK), case("evidence_status", C.EVIDENCE_RANK), case("verification_status", C.STATUS_RANK)
_CAT = r"CASE WHEN category IS NULL OR regexp_replace(category, '^\s+|\s+$', '', 'g') = '' THEN 'general' ELSE lower(regexp_replace(category, '^\s+|\s+$', '', 'g')) END"
F = f"f AS (SELECT DISTINCT * REPLACE ({_CAT} AS category) FROM findings)"
KEY = "review_id, file_path, category, start_line"
_DEC = " OR ".join(f"{c} <= 0.15 OR {c} >= 0.85" for c in C.SEVERITY_WEIGHTS)
_SCORE = " + ".join(f"{w}::DOUBLE * {c}" for c, w in C.SEVERITY_WEIGHTS.items())
DERIVED = f"CASE WHEN NOT ({_DEC}) THEN severity " + " ".join(f"WHEN {_SCORE} >= {cut}::DOUBLE THEN '{name}'" for cut, name in C.SEVERITY_CUTS) + " ELSE 'info' END"
G1 = f"g AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY confidence DESC, {SEV} DESC, ord) AS n, min(ord) OVER (PARTITION BY {KEY}) AS first_ord FROM f)"
IDENT = r"list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z_][\p{{L}}\p{{N}}_]{{2,}}'), lambda t: lower(t)))"
WORDS = r"list_transform(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+'), lambda r: CASE WHEN regexp_full_match(r, '\p{{Nd}}+') THEN r ELSE regexp_extract(r, '[A-Za-z_].*') END), lambda r: r <> ''), lambda r: lower(r))"
LEVEL = case("severity", C.SARIF_LEVEL, "note")
RULE = "coalesce(nullif(rule_id, ''), category || '/' || substring(title, 1, 40))"

DIFF = r"""
    raw AS (SELECT entry_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS r FROM (SELECT entry_id, string_split(regexp_replace(diff, '\n$', ''), chr(10)) AS l FROM benchmark_entries WHERE regexp_matches(diff, '\S'))),
    ln AS (SELECT entry_id, pos, regexp_replace(r, '\r$', '') AS line FROM raw),
    nb AS (SELECT *, lead(line) OVER w AS nx, lead(line, 2) OVER w AS nn, lag(line) OVER w AS pv FROM ln WINDOW w AS (PARTITION BY entry_id ORDER BY pos)),
    fl AS (SELECT *, CASE WHEN line LIKE 'diff --git %' OR (line LIKE '--- %' AND coalesce(nx LIKE '+++ %' AND nn LIKE '@@ -%', FALSE)
        AND NOT coalesce(regexp_matches(pv, '^(diff --git |index |new file mode|deleted file mode|old mode|new mode|similarity index|dissimilarity index|rename (from|to)|copy (from|to)|Binary files)'), FALSE)) THEN 1 ELSE 0 END AS isf FROM nb),
    fx AS (SELECT *, sum(isf) OVER (PARTITION BY entry_id ORDER BY pos) AS file_idx FROM fl),
    hk AS (SELECT *, CASE WHEN file_idx > 0 AND regexp_matches(line, '^@@ -[0-9]+(,[0-9]+)? \+[0-9]+(,[0-9]+)? @@') THEN 1 ELSE 0 END AS ish FROM fx),
    hx AS (SELECT *, sum(ish) OVER (PARTITION BY entry_id, file_idx ORDER BY pos) AS hunk_idx FROM hk),
    m AS (SELECT entry_id, pos, line, file_idx, hunk_idx, CASE WHEN hunk_idx = 0 THEN 'header' WHEN ish = 1 THEN 'hunk' WHEN line LIKE '+%' THEN 'added' WHEN line LIKE '-%' THEN 'removed' WHEN line LIKE '\%' THEN 'marker' ELSE 'context' END AS role FROM hx),
    st AS (SELECT *, max(CASE WHEN role = 'hunk' THEN regexp_extract(line, '^@@ -([0-9]+)(,[0-9]+)? \+([0-9]+)', 1)::INT END) OVER h AS o, max(CASE WHEN role = 'hunk' THEN regexp_extract(line, '^@@ -([0-9]+)(,[0-9]+)? \+([0-9]+)', 3)::INT END) OVER h AS nw
        FROM m WHERE hunk_idx > 0 AND role <> 'marker' WINDOW h AS (PARTITION BY entry_id, file_idx, hunk_idx)),
    num AS (SELECT entry_id, file_idx, hunk_idx, pos, role AS kind, CASE WHEN substring(line, 1, 1) IN ('+', '-', ' ') THEN substring(line, 2) ELSE line END AS text,
        CASE WHEN role <> 'added' THEN o + coalesce(count(*) FILTER (role NOT IN ('hunk', 'added')) OVER b, 0) END AS old_line, CASE WHEN role <> 'removed' THEN nw + coalesce(count(*) FILTER (role NOT IN ('hunk', 'removed')) OVER b, 0) END AS new_line
        FROM st WINDOW b AS (PARTITION BY entry_id, file_idx, hunk_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lines AS (SELECT * FROM num WHERE kind <> 'hunk'),
    hd AS (SELECT entry_id, file_idx,
        max(CASE WHEN role = 'header' AND line LIKE '--- %' THEN regexp_replace(string_split(substring(line, 5), chr(9))[1], '^a/', '') END) AS po, max(CASE WHEN role = 'header' AND line LIKE '+++ %' THEN regexp_replace(string_split(substring(line, 5), chr(9))[1], '^b/', '') END) AS pn,
        max(CASE WHEN role = 'header' AND line LIKE 'diff --git %' THEN regexp_extract(line, ' b/(.+)$', 1) END) AS pg, max(CASE WHEN role = 'header' AND line LIKE 'rename from %' THEN substring(line, 13) END) AS pf,
        bool_or(role = 'header' AND line LIKE 'new file mode%') AS isnew, bool_or(role = 'header' AND line LIKE 'deleted file mode%') AS isdel, max(hunk_idx) AS hunks, count(*) FILTER (role = 'added') AS added, count(*) FILTER (role = 'removed') AS removed
        FROM m WHERE file_idx > 0 GROUP BY 1, 2),
    fp AS (SELECT *, coalesce(nullif(pn, '/dev/null'), CASE WHEN pn IS NULL THEN pg END, nullif(po, '/dev/null')) AS path, coalesce(pf, nullif(po, '/dev/null')) AS old_path,
        CASE WHEN isnew OR coalesce(po = '/dev/null', FALSE) THEN 'added' WHEN isdel OR coalesce(pn = '/dev/null', FALSE) THEN 'deleted' WHEN pf IS NOT NULL THEN 'renamed' ELSE 'modified' END AS status FROM hd),
    files AS (SELECT *, """ + case(r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))", C.EXTENSION_LANGUAGE, "unknown") + """ AS language FROM fp)"""

_S = "s AS (SELECT DISTINCT ON (score_id) * REPLACE (lower(trim(system)) AS system) FROM entry_scores WHERE system IS NOT NULL)"


def _metrics(name: str, where: str = "TRUE") -> str:
    return f"""
    {name}0 AS (SELECT system, sum(true_positives) tp, sum(false_positives) fp, count(*) FILTER (missed_gold AND success) fn, count(*) FILTER (detected) det, count(*) FILTER (detected OR missed_gold) posv,
        count(*) FILTER (severity_correct) rs, count(*) FILTER (success) done, count(*) entries, sum(CASE WHEN NOT isnan(latency_seconds) THEN latency_seconds::DECIMAL(28, 9) END) FILTER (NOT isnan(latency_seconds))::DOUBLE / count(latency_seconds) FILTER (NOT isnan(latency_seconds)) la, sum(CASE WHEN NOT isnan(cost_usd) THEN cost_usd::DECIMAL(28, 9) END) FILTER (NOT isnan(cost_usd))::DOUBLE / count(cost_usd) FILTER (NOT isnan(cost_usd)) co, sum(tokens) total_tokens FROM s WHERE {where} GROUP BY 1),
    {name}1 AS (SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM {name}0),
    {name} AS (SELECT system, entries, tp, fp, fn, precision, recall, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1, round(fp / nullif(tp + fp, 0), 4) AS false_positive_rate, round(det / nullif(posv, 0), 4) AS bug_detection_rate,
        round(rs / nullif(det, 0), 4) AS severity_accuracy, round(done / entries, 4) AS completion_rate, round(la, 3) AS mean_latency_s, round(co, 6) AS mean_cost_usd, total_tokens FROM {name}1)"""


def _long(name: str) -> str:
    return " UNION ALL ".join(f"SELECT system, '{m}' AS metric, {m}::DOUBLE AS v FROM {name}" for m in ev.METRICS)


_LOWER = ", ".join(f"'{m}'" for m in ev.LOWER_IS_BETTER)
_STOP = "[" + ", ".join(f"'{w}'" for w in ev.STOP_WORDS) + "]"
_GOLD = f"""
    gold AS (SELECT entry_id, affected_files, severity AS gold_severity, list_filter({IDENT.format("concat_ws(' ', bug_description, bug_fix)")}, lambda t: NOT list_contains({_STOP}, t)) AS gold, bug_fix, lower(severity) AS severity FROM benchmark_entries),
    mt AS (SELECT files.entry_id, file_idx AS pred, gold_severity, severity, len(gold) = 0 AS negative, (len(affected_files) = 0 OR coalesce(list_contains(affected_files, path), FALSE) OR (regexp_extract(path, '^(.*)/', 1) <> '' AND list_contains(list_transform(affected_files, lambda a: regexp_extract(a, '^(.*)/', 1)), regexp_extract(path, '^(.*)/', 1))))
        AND len(list_intersect({IDENT.format("bug_fix")}, gold)) >= 1 AS matched FROM files JOIN gold USING (entry_id))"""
_TERMS = f"t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)"
_HASH = "(('0x' || substring(md5(token), 1, 8))::BIGINT % 1024)"
_SIGN = "CASE WHEN ('0x' || substring(md5(token), 9, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END"
_NORM = "coalesce(nullif(sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))), 0), 1)"
_TITLE = r"regexp_extract(coalesce(text, ''), '^([^\r\n]*)', 1)"
_KNOW = f"k AS (SELECT doc_id, kind, {_TITLE} AS title, coalesce(text, '') AS content, repository, coalesce(category, '') AS category, coalesce(source, '') AS source FROM documents), ki AS (SELECT *, substring(sha256(kind || chr(0) || title || chr(0) || content || chr(0) || repository || chr(0) || category), 1, 16) AS content_id FROM k)"
_E = "e AS (SELECT DISTINCT ON (event_no) * FROM workflow_events ORDER BY event_no, received_at)"
_U = "u AS (SELECT *, coalesce((payload->>'input_tokens')::BIGINT, 0) AS it, coalesce((payload->>'calls')::BIGINT, 0) AS ca FROM e WHERE kind = 'usage')"
_DONE = "('stage_done', 'stage_failed', 'stage_skipped')"
_PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(fi.INTERACTIONS))


def _rules_sql() -> str:
    out = []
    for c, r, flags, p in rules.RULES:
        if "(?!" in p:
            continue
        q = p.replace("'", "''")
        out.append(f"SELECT '{c}' AS category, '{r}' AS rule_id, entry_id FROM a WHERE regexp_matches(text, '{f'(?{flags})' if flags else ''}{q}')")
    return " UNION ALL ".join(out)


_FILES = "bf AS (SELECT entry_id, e.key AS path, e.value AS content FROM (SELECT entry_id, unnest(map_entries(base_files)) AS e FROM benchmark_entries))"
_SIZE = "sz AS (SELECT entry_id, file_idx, path, greatest(1, floor(chars / 4))::BIGINT AS tokens FROM files JOIN (SELECT entry_id, file_idx, sum(length(text) + 1) AS chars FROM lines GROUP BY 1, 2) USING (entry_id, file_idx)), so AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY file_idx) AS n FROM sz)"
_GROUPS = """gr AS (SELECT entry_id, n, file_idx, path, tokens, 0 AS grp, tokens AS used FROM so WHERE n = 1
    UNION ALL SELECT so.entry_id, so.n, so.file_idx, so.path, so.tokens, CASE WHEN gr.used > 0 AND gr.used + so.tokens > 120 THEN gr.grp + 1 ELSE gr.grp END, CASE WHEN gr.used > 0 AND gr.used + so.tokens > 120 THEN so.tokens ELSE gr.used + so.tokens END FROM gr JOIN so ON so.entry_id = gr.entry_id AND so.n = gr.n + 1)"""

_DIS = r"""d AS (SELECT *, regexp_extract(content, '([\w/]+\.(?:py|js|go|java))', 1) AS source_file FROM k WHERE kind = 'dismissed')"""
_LINES_OF_DOCS = "dl AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL))"

SQL = {
    "r1_rank_findings": f"""WITH {F}, {G1}, x AS (SELECT * REPLACE ({DERIVED} AS severity) FROM g WHERE n = 1 AND confidence >= 0.6 - 1e-9 AND evidence_status IN ('confirmed', 'strongly_supported'))
        SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY {SEV} DESC, confidence DESC, {STA} DESC, ord) AS rank, ord, category, severity, confidence, file_path, start_line FROM x""",
    "g1_dedupe_findings": f"WITH {F}, {G1} SELECT review_id, file_path, category, start_line, ord, first_ord, severity, confidence FROM g WHERE n = 1",
    "g2_merge_groups": f"WITH {F} SELECT {KEY}, arg_max(ord, (confidence, -ord)) AS ord, max(confidence) AS confidence FROM f GROUP BY ALL",
    "f1_filter_findings": f"WITH {F} SELECT review_id, ord, confidence, evidence_status FROM f WHERE confidence >= 0.7 - 1e-9 AND evidence_status <> 'rejected'",
    "f3_ignored_files": f"WITH {F} SELECT review_id, ord, file_path FROM f WHERE NOT (file_path LIKE '%/ledger.%' OR file_path LIKE 'tests/%' OR file_path LIKE '%.md')",
    "f10_severity_gate": f"WITH {F} SELECT review_id, max({SEV}) >= 4 AS failed, arg_max(severity, ({SEV}, -ord)) AS worst FROM f GROUP BY 1",
    "f11_count_gate": f"WITH {F}, l(severity, most) AS (VALUES ('critical', 0), ('high', 2), ('medium', 4)) SELECT review_id, severity, count(*) AS n, most FROM f JOIN l USING (severity) GROUP BY ALL HAVING count(*) > most",
    "f12_gate_level": f"WITH {F} SELECT repository AS config_id, arg_min(severity, {SEV}) AS level FROM f GROUP BY 1",
    "g4_severity_counts": f"WITH {F} SELECT review_id, {', '.join(f'count(*) FILTER (severity = {s!r}) AS {s}' for s in C.SEVERITY_RANK)} FROM f GROUP BY 1",
    "g17_verification_summary": f"WITH {F} SELECT review_id, {', '.join(f'count(*) FILTER (evidence_status = {s!r}) AS {s}' for s in C.EVIDENCE_RANK)}, (sum(round(confidence * 1e6)::BIGINT) // count(confidence)) / 1e6 AS mean_confidence, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM f GROUP BY 1",
    "g18_action_counts": f"WITH {F} SELECT category, evidence_status, count(*) AS n FROM f GROUP BY 1, 2",
    "g19_cross_tab": f"""WITH {F}, c(category) AS (VALUES {', '.join(f"('{c}')" for c in C.CHECKS)}), n AS (SELECT category, {', '.join(f'count(*) FILTER (severity = {s!r}) AS {s}' for s in C.SEVERITY_RANK)}, count(*) AS total FROM f GROUP BY 1)
        SELECT c.category, {', '.join(f'coalesce({s}, 0) AS {s}' for s in (*C.SEVERITY_RANK, 'total'))} FROM c LEFT JOIN n USING (category) UNION ALL SELECT category, {', '.join('NULL' for _ in C.SEVERITY_RANK)}, total FROM n WHERE category NOT IN (SELECT category FROM c)""",
    "j4_interactions": f"""WITH {F}, p(pair, a, b) AS (VALUES {_PAIRS}), x AS (SELECT *, {SEV} AS sv FROM f WHERE {EVI} >= 2),
        y AS (SELECT l.review_id, pair, a, b, l.file_path, coalesce(l.start_line, r.start_line) AS start_line, greatest(l.sv, r.sv) AS severity_rank, least(l.confidence, r.confidence) AS confidence, l.ord AS ord_a, r.ord AS ord_b FROM p JOIN x l ON l.category = a JOIN x r ON r.category = b AND r.review_id = l.review_id AND r.file_path = l.file_path
            WHERE l.start_line IS NULL OR r.start_line IS NULL OR abs(l.start_line - r.start_line) <= 5),
        z AS (SELECT *, row_number() OVER (PARTITION BY review_id, pair, file_path, start_line ORDER BY ord_a, ord_b) AS n FROM y)
        SELECT review_id, replace('interaction:' || a || '-' || b, '_', '-') AS rule_id, a AS category, b AS related, file_path, start_line, severity_rank, confidence, ord_a, ord_b FROM z WHERE n = 1""",
    "j6_selections": f"""WITH {F}, s AS (SELECT * FROM f WHERE rule_id IS NOT NULL), c AS (SELECT * FROM f WHERE rule_id IS NULL),
        x AS (SELECT s.review_id, s.ord AS sel, c.ord AS candidate, CASE WHEN coalesce(s.start_line = c.start_line, FALSE) OR s.category = c.category THEN 0 WHEN len(list_intersect({IDENT.format('s.title')}, {IDENT.format('c.title')})) >= 2 THEN 1 END AS way FROM s JOIN c ON s.review_id = c.review_id AND s.file_path = c.file_path)
        SELECT review_id, sel, arg_min(candidate, (way, candidate)) AS candidate, min(way) AS way FROM x WHERE way IS NOT NULL GROUP BY 1, 2""",
    "j7_unmentioned": f"WITH {F} SELECT {KEY}, ord FROM f WHERE {STA} >= 2 AND NOT EXISTS (SELECT 1 FROM f s WHERE s.evidence_status = 'confirmed' AND s.review_id = f.review_id AND s.file_path = f.file_path AND s.category = f.category AND s.start_line IS NOT DISTINCT FROM f.start_line)",
    "x9_derived_severity": f"WITH {F} SELECT review_id, ord, {DERIVED} AS severity FROM f",
    "x11_status_maps": f"WITH {F} SELECT verification_status, evidence_status, {case('evidence_status', C.STATUS_OF_EVIDENCE, 'unverified')} AS status_of_evidence, count(*) AS n FROM f GROUP BY ALL",
    "x17_finding_ids": f"WITH {F} SELECT review_id, ord, file_path || ':' || coalesce(start_line::VARCHAR, 'None') || ':' || category AS finding_id FROM f",
    "k1_json_documents": f"WITH {F} SELECT review_id, count(*) AS findings, min(ord) AS first_ord, md5(string_agg(title || '|' || file_path || '|' || severity || '|' || coalesce(start_line, 0), chr(10) ORDER BY title || '|' || file_path || '|' || severity || '|' || coalesce(start_line, 0))) AS digest FROM f GROUP BY 1",
    "k2_sarif": f"WITH {F} SELECT review_id, '2.1.0' AS version, count(*) AS results, count(DISTINCT {RULE}) AS rules, md5(string_agg({RULE} || '|' || {LEVEL}, chr(10) ORDER BY {RULE} || '|' || {LEVEL})) AS digest FROM f GROUP BY 1",
    "k2_sarif_levels": f"WITH {F} SELECT review_id, {LEVEL} AS level, count(*) AS results, count(DISTINCT {RULE}) AS rules FROM f GROUP BY 1, 2",
    "k3_markdown": f"WITH {F} SELECT review_id, '# Review ' || review_id || chr(10) || string_agg('- [' || severity || '] ' || title || ' (' || file_path || ':' || coalesce(start_line::VARCHAR, '-') || ')', chr(10) ORDER BY {SEV} DESC, confidence, ord) AS document FROM f GROUP BY review_id",
    "k5_comments": f"""WITH {F}, r AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {SEV} DESC, confidence DESC, {STA} DESC, ord) AS rank FROM f)
        SELECT review_id, rank, file_path AS path, start_line AS line, md5(substring(concat_ws(chr(10) || chr(10), title, description, recommendation), 1, 65000)) AS digest FROM r WHERE rank <= 20 AND file_path <> '' AND start_line IS NOT NULL""",
    "k11_redacted_meta": f"WITH {_E}, x AS (SELECT unnest(map_entries(meta)) AS m FROM e) SELECT m.key AS key, CASE WHEN regexp_matches(m.key, '(?i)(key|token|secret|password|authorization|cookie)') THEN '***' ELSE m.value END AS value, count(*) AS n FROM x GROUP BY 1, 2",
    "d1_diff_files": f"WITH {DIFF} SELECT entry_id, file_idx, path, old_path, status, language, hunks, added, removed FROM files",
    "d2_numbered_lines": f"WITH {DIFF} SELECT entry_id, pos, kind, text, old_line, new_line FROM lines",
    "d3_hunks": rf"WITH {DIFF}, x AS (SELECT *, regexp_extract(line, '^@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@', ['a', 'b', 'c', 'd']) AS g FROM m WHERE role = 'hunk') SELECT entry_id, file_idx, hunk_idx, g.a::INT AS old_start, coalesce(nullif(g.b, '')::INT, 1) AS old_count, g.c::INT AS new_start, coalesce(nullif(g.d, '')::INT, 1) AS new_count FROM x",
    "d4_added_removed": f"WITH {DIFF} SELECT entry_id, kind, count(*) AS lines, sum(length(text)) AS n_chars FROM lines WHERE kind <> 'context' GROUP BY 1, 2",
    "d5_changed_lines": f"WITH {DIFF} SELECT entry_id, file_idx, new_line FROM lines WHERE kind = 'added'",
    "d6_changed_ranges": f"WITH {DIFF}, x AS (SELECT *, new_line - row_number() OVER (PARTITION BY entry_id, file_idx, hunk_idx ORDER BY new_line) AS i FROM lines WHERE kind = 'added') SELECT entry_id, file_idx, hunk_idx, min(new_line) AS first_line, max(new_line) AS last_line FROM x GROUP BY entry_id, file_idx, hunk_idx, i",
    "d7_languages": f"WITH {DIFF} SELECT language, status, count(*) AS files, sum(added) AS added FROM files GROUP BY 1, 2",
    "d8_to_text": f"WITH {DIFF}, x AS (SELECT entry_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM m WHERE file_idx > 0 GROUP BY 1) SELECT entry_id, length(t) AS n_chars, md5(t) AS digest FROM x",
    "d10_reversed": f"WITH {DIFF} SELECT CASE kind WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE kind END AS kind, count(*) AS lines, sum(new_line) AS old_sum, sum(old_line) AS new_sum FROM lines GROUP BY 1",
    "w3_budget_groups": f"WITH RECURSIVE {DIFF}, {_SIZE}, {_GROUPS} SELECT entry_id, grp, file_idx, path, tokens FROM gr",
    "g14_group_descriptions": f"WITH RECURSIVE {DIFF}, {_SIZE}, {_GROUPS} SELECT entry_id, grp, string_agg(path, ', ' ORDER BY file_idx) AS files, sum(tokens) AS tokens FROM gr GROUP BY 1, 2",
    "g6_system_metrics": f"WITH {_S}, {_metrics('m')} SELECT * FROM m",
    "j12_regressions": f"""WITH {_S}, {_metrics('b', "scored_at < TIMESTAMP '2025-04-01'")}, {_metrics('c', "scored_at >= TIMESTAMP '2025-04-01'")}, bl AS ({_long('b')}), cl AS ({_long('c')}),
        j AS (SELECT coalesce(bl.system, cl.system) AS system, coalesce(bl.metric, cl.metric) AS metric, bl.v AS baseline, cl.v AS candidate, round(cl.v - bl.v, 6) AS delta, bl.system IS NULL AS nob, cl.system IS NULL AS noc FROM bl FULL JOIN cl ON bl.system = cl.system AND bl.metric = cl.metric WHERE bl.v IS NOT NULL OR bl.system IS NULL),
        k AS (SELECT *, CASE WHEN metric IN ({_LOWER}) THEN delta ELSE -delta END AS worse FROM j),
        l AS (SELECT *, CASE WHEN noc THEN 'missing' WHEN nob THEN 'extra' WHEN candidate IS NULL THEN 'regressed' WHEN worse > 0.02 THEN 'regressed' WHEN worse < 0 THEN 'improved' WHEN delta = 0 THEN 'unchanged' ELSE 'tolerated' END AS label FROM k)
        SELECT system, metric, baseline, candidate, delta, label = 'regressed' AS regressed, label FROM l""",
    "u4_system_differences": f"WITH {_S}, a AS (SELECT DISTINCT system FROM s WHERE run_id LIKE '%-0'), b AS (SELECT DISTINCT system FROM s WHERE run_id LIKE '%-1') SELECT system, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT system, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "k12_result_rows": f"WITH {_S}, {_metrics('m')} SELECT system, system || ' | ' || {' || chr(32) || chr(124) || chr(32) || '.join(f'''coalesce({m}::DECIMAL(20, 4)::VARCHAR, '-')''' for m in ev.METRICS[:9])} AS row FROM m",
    "j9_gold_matches": f"WITH {DIFF}, {_GOLD} SELECT entry_id, pred, matched, negative FROM mt",
    "g5_entry_scores": f"WITH {DIFF}, {_GOLD} SELECT entry_id, count(*) FILTER (matched) AS true_positives, count(*) FILTER (NOT matched) AS false_positives, bool_or(matched) AS detected, NOT bool_or(matched) AND NOT bool_or(negative) AS missed_gold, bool_or(matched AND severity = gold_severity) AS severity_correct FROM mt GROUP BY 1",
    "f8_leakage_guard": "SELECT count(*) AS entries, count(*) FILTER (NOT hold_out) AS not_held_out, count(*) FILTER (NOT hold_out) = 0 AS allowed FROM benchmark_entries",
    "j11_entries_by_system": f"WITH {_S}, h AS (SELECT entry_id FROM benchmark_entries WHERE hold_out), y AS (SELECT DISTINCT system FROM s), n AS (SELECT entry_id, system, count(*) AS scores FROM s GROUP BY 1, 2) SELECT entry_id, system, coalesce(scores, 0) AS scores FROM h CROSS JOIN y LEFT JOIN n USING (entry_id, system)",
    "x1_identifier_tokens": f"SELECT doc_id, md5(array_to_string(list_sort({IDENT.format('text')}), ' ')) AS tokens FROM documents",
    "x4_token_estimate": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents WHERE text IS NOT NULL",
    "g12_document_frequency": f"WITH {_TERMS} SELECT token, df FROM df",
    "g13_term_counts": f"WITH {_TERMS} SELECT doc_id, token, tf FROM tf",
    "x5_idf": f"WITH {_TERMS} SELECT token, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM df",
    "x6_hashed_features": f"WITH {_TERMS} SELECT token, {_HASH} AS idx, {_SIGN} AS sign FROM df",
    "x7_tfidf_vectors": f"""WITH {_TERMS}, w AS (SELECT doc_id, token, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
        v AS (SELECT doc_id, {_HASH} AS idx, sum(w * {_SIGN}) AS w FROM w GROUP BY 1, 2) SELECT doc_id, count(*) AS features, min(idx) AS first_idx, max(idx) AS last_idx, round(sum(abs(v.w / n.n)), 4) AS l1, round(sum(v.w / n.n), 4) AS total, round(sum(v.w / n.n * idx / 1024), 4) AS moment FROM v JOIN n USING (doc_id) GROUP BY 1""",
    "x18_slugs": r"SELECT entry_id, regexp_replace(repository, '[^A-Za-z0-9_.\-]', '_', 'g') AS slug FROM benchmark_entries",
    "x20_directories": f"WITH {F} SELECT review_id, ord, regexp_extract(file_path, '^(.*)/', 1) AS directory FROM f",
    "x21_query_text": f"WITH {DIFF}, a AS (SELECT entry_id, string_agg(text, chr(10) ORDER BY pos) AS added FROM lines WHERE kind = 'added' GROUP BY 1) SELECT entry_id, md5(substring(concat_ws(chr(10), bug_description, added), 1, 8000)) AS digest FROM benchmark_entries LEFT JOIN a USING (entry_id)",
    "r2_nearest_vectors": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / ({_NORM.format('q.embedding')} * {_NORM.format('v.embedding')}), 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 6""",
    "w4_budget_prefix": "WITH x AS (SELECT repository, doc_id, sum(length(text)) OVER (PARTITION BY repository ORDER BY doc_id) AS used FROM documents WHERE text IS NOT NULL) SELECT * FROM x WHERE used <= 24000",
    "s7_budget_overshoot": "WITH x AS (SELECT repository, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY repository ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents WHERE text IS NOT NULL AND trim(text) <> '') SELECT * FROM x WHERE used < 24000",
    "s11_knowledge_scope": "SELECT repository, kind, count(*) AS entries FROM documents GROUP BY 1, 2",
    "x12_content_ids": f"WITH {_KNOW} SELECT doc_id, content_id FROM ki",
    "k8_add_new": f"WITH {_KNOW} SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY doc_id) AS n FROM ki WHERE kind <> 'rule' AND content_id NOT IN (SELECT content_id FROM ki WHERE kind = 'rule')) WHERE n = 1",
    "g16_captured": f"WITH {_KNOW}, a AS (SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY doc_id) AS n FROM ki WHERE kind <> 'rule' AND content_id NOT IN (SELECT content_id FROM ki WHERE kind = 'rule')) WHERE n = 1) SELECT kind, count(*) AS added FROM a GROUP BY 1",
    "r4_knowledge_search": f"""WITH {_KNOW}, ke AS (SELECT doc_id, repository, category, unnest(list_distinct({WORDS.format("title || ' ' || content")})) AS token FROM k), q AS (SELECT doc_id AS query_id, repository, category, unnest(list_distinct({WORDS.format('title')})) AS token FROM k WHERE doc_id % 50 = 0),
        m AS (SELECT query_id, doc_id, count(*) + CASE WHEN any_value(q.category) <> '' AND any_value(ke.category) = any_value(q.category) THEN 2 ELSE 0 END AS score FROM ke JOIN q USING (token) WHERE coalesce(ke.repository, '') = '' OR ke.repository = q.repository GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 4""",
    "g9_usage_totals": f"WITH {_E}, {_U} SELECT review_id, sum(it) AS input_tokens, sum(ca) AS calls, count(*) AS usages FROM u GROUP BY 1",
    "w10_running_usage": f"WITH {_E}, {_U} SELECT review_id, event_no, sum(it) OVER w AS tokens_so_far, sum(ca) OVER w AS calls_so_far FROM u WINDOW w AS (PARTITION BY review_id ORDER BY event_ts, event_no ROWS UNBOUNDED PRECEDING)",
    "g10_latest_status": f"WITH {_E} SELECT review_id, stage, arg_max(kind, (event_ts, event_no)) AS status, max(event_ts) AS at FROM e WHERE stage <> '' GROUP BY 1, 2",
    "e4_stage_deadlines": f"WITH {_E}, x AS (SELECT review_id, stage, round((epoch_us(max(event_ts) FILTER (kind IN {_DONE})) - epoch_us(min(event_ts) FILTER (kind = 'stage_start'))) / 1e6, 3) AS seconds FROM e WHERE stage <> '' AND kind IN ('stage_start', 'stage_done', 'stage_failed', 'stage_skipped') GROUP BY 1, 2) SELECT review_id, stage, seconds, seconds > 20 AS over_budget FROM x",
    "w8_history_tail": f"WITH {_E} SELECT review_id, max(event_ts) AS finished FROM e WHERE kind = 'finish' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000",
    "e1_stage_stats": f"WITH {_E} SELECT stage, {', '.join(f'count(*) FILTER (kind = {k!r}) AS {k}' for k in ('stage_start', 'stage_done', 'stage_failed', 'stage_skipped', 'usage'))}, round(avg(stage_seconds) FILTER (kind = 'stage_done'), 3) AS mean_seconds, max(stage_seconds) AS max_seconds FROM e WHERE stage <> '' GROUP BY 1",
    "e2_stream_usage": f"WITH {_E}, {_U} SELECT review_id, sum(it) AS input_tokens, sum(ca) AS calls, count(*) AS usages FROM u GROUP BY 1",
    "e3_stream_status": f"WITH {_E} SELECT review_id, stage, arg_max(kind, (event_ts, event_no)) AS status, max(event_ts) AS at FROM e WHERE stage <> '' GROUP BY 1, 2",
    "d9_plain_focused_files": f"""WITH {DIFF}, a AS (SELECT entry_id, file_idx, string_agg(text, chr(10) ORDER BY pos) AS text FROM lines WHERE kind = 'added' GROUP BY 1, 2), h AS ({_rules_sql().replace('entry_id FROM a', 'entry_id, file_idx FROM a')}), fi AS (SELECT DISTINCT entry_id, file_idx FROM lines),
        c AS (SELECT unnest([{', '.join(f"'{x}'" for x in C.CHECKS)}]) AS category), mt AS (SELECT DISTINCT entry_id, category, file_idx FROM h), kept AS (SELECT fi.entry_id, c.category, fi.file_idx FROM fi CROSS JOIN c WHERE (fi.entry_id, c.category) NOT IN (SELECT entry_id, category FROM mt) OR (fi.entry_id, c.category, fi.file_idx) IN (SELECT entry_id, category, file_idx FROM mt)),
        z AS (SELECT k.*, coalesce(length(a.text), 0) AS chars FROM kept k LEFT JOIN a USING (entry_id, file_idx)), u AS (SELECT *, sum(chars) OVER w AS used, row_number() OVER w AS n FROM z WINDOW w AS (PARTITION BY entry_id, category ORDER BY file_idx))
        SELECT category, count(*) AS files, sum(least(chars, 400)) AS chars FROM u WHERE used <= 400 OR n = 1 GROUP BY 1""",
    "j3_line_texts": f"""WITH {DIFF}, {_FILES}, l AS (SELECT entry_id, path, arg_min(text, pos) AS shown FROM lines JOIN files USING (entry_id, file_idx) WHERE new_line = 12 GROUP BY 1, 2),
        x AS (SELECT entry_id, path, coalesce(shown, string_split_regex(content, '\r\n|\n|\r')[12]) AS text FROM bf LEFT JOIN l USING (entry_id, path)) SELECT entry_id, path, md5(text) AS digest FROM x WHERE text IS NOT NULL""",
    "s6_commit_files": f"WITH {DIFF}, x AS (SELECT entry_id, path, min(file_idx) AS nth FROM files WHERE path IS NOT NULL GROUP BY 1, 2) SELECT entry_id, md5(string_agg(path, chr(10) ORDER BY nth, path)) AS digest FROM x GROUP BY 1",
    "s7_snapshots": f"""WITH {_FILES}, a AS (SELECT entry_id, generate_subscripts(affected_files, 1) AS o, unnest(affected_files) AS path FROM benchmark_entries), c AS (SELECT entry_id, path, min(o) AS o FROM a GROUP BY 1, 2),
        x AS (SELECT entry_id, path, row_number() OVER w AS place, coalesce(sum(length(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM bf LEFT JOIN c USING (entry_id, path) WHERE trim(coalesce(content, '')) <> '' WINDOW w AS (PARTITION BY entry_id ORDER BY o NULLS LAST, path))
        SELECT entry_id, path, place, used FROM x WHERE place <= 3 AND used < 1500""",
    "s9_merged_pages": f"WITH {_FILES} SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY path) AS place, path AS item FROM bf",
    "s15_imported": f"""WITH {DIFF}, {_FILES}, t AS (SELECT entry_id, count(*) AS files, arg_min(language, file_idx) AS language FROM files WHERE path IS NOT NULL GROUP BY 1), h AS (SELECT entry_id, count(*) AS held FROM bf WHERE (entry_id, path) IN (SELECT entry_id, path FROM files WHERE path IS NOT NULL) GROUP BY 1)
        SELECT entry_id, repository, t.language, files, coalesce(held, 0) AS held FROM benchmark_entries b JOIN t USING (entry_id) LEFT JOIN h USING (entry_id)""",
    "f4_enabled_findings": f"WITH {F} SELECT review_id, ord, category FROM f WHERE category NOT IN ('testing', 'i18n')",
    "z9_models": f"WITH {F} SELECT DISTINCT category, CASE WHEN category IN ('security', 'concurrency') THEN 'large' ELSE 'small' END AS model FROM f",
    "z8_retried": f"""WITH {_S}, x AS (SELECT *, row_number() OVER (PARTITION BY entry_id, system ORDER BY scored_at, score_id) AS n FROM s), y AS (SELECT * FROM x WHERE n <= 3),
        e AS (SELECT entry_id, system, coalesce(min(n) FILTER (success OR coalesce(error = 'budget_exceeded', FALSE)), max(n)) AS tries FROM y GROUP BY 1, 2)
        SELECT entry_id, system, tries, CASE WHEN success THEN 'answered' ELSE 'failed' END AS outcome, CASE WHEN NOT success THEN error END AS error FROM e JOIN y USING (entry_id, system) WHERE n = tries""",
    "k4_exports": f"WITH {F} SELECT format, count(DISTINCT review_id) AS documents, count(DISTINCT review_id) AS filled FROM f, (VALUES ('markdown'), ('json'), ('sarif')) v(format) GROUP BY 1",
    "k8_removed": f"WITH {_KNOW}, g AS (SELECT DISTINCT arg_min(content_id, doc_id) AS content_id FROM ki GROUP BY category) SELECT kind, count(*) AS entries, max(doc_id) AS last FROM ki WHERE content_id NOT IN (SELECT content_id FROM g) GROUP BY 1",
    "k11_redacted_payloads": f"WITH {_E} SELECT event_no, CASE WHEN payload->>'input_tokens' IS NOT NULL THEN '***' END AS input_tokens, payload->>'calls' AS calls, '***' AS api_key FROM e WHERE payload IS NOT NULL",
    "g17_stage_versions": f"""WITH {_E}, x AS (SELECT review_id, stage, arg_max(meta['model'], (event_ts, event_no)) AS v FROM e WHERE stage IN ('planner', 'aggregator', 'verifier', 'checks') AND meta['model'] IS NOT NULL GROUP BY 1, 2)
        SELECT review_id, string_agg(stage || '=' || v, ',' ORDER BY stage) AS versions FROM x GROUP BY 1""",
    "x15_sections": "SELECT doc_id, regexp_replace('Review ' || coalesce(repository, ''), '\\s+$', '') AS task, coalesce(kind, '') AS rules, '' AS absent FROM documents",
    "x18_experiment_slugs": "SELECT entry_id, regexp_replace(regexp_replace(lower(repository), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM benchmark_entries",
    "x22_dismissals": f"""WITH {F} SELECT review_id, ord, 'Dismissed: ' || title AS title, substring(sha256('dismissed' || chr(0) || 'Dismissed: ' || title || chr(0) || concat_ws(chr(10), description, 'File: ' || file_path) || chr(0) || repository || chr(0) || category), 1, 16) AS content_id FROM f WHERE evidence_status = 'rejected'""",
    "d11_embedded_patches": f"WITH {F}, x AS (SELECT review_id, ord, regexp_extract(coalesce(recommendation, ''), '(?s)(diff --git .*?)(?:```|\n\n|$)', 1) AS patch FROM f) SELECT review_id, ord, patch FROM x WHERE patch <> ''",
    "x24_import_names": rf"""WITH {DIFF}, a AS (SELECT entry_id, pos, text, coalesce(nullif(regexp_extract(text, '^\s*import\s+(?:type\s+)?([^''"]+?)\s+from\s+[''"]', 1), ''), nullif(regexp_extract(text, '^\s*(?:const|let|var)\s+(\{{[^}}]*\}}|\w+)\s*=\s*require\(', 1), '')) AS sc,
        coalesce(nullif(regexp_extract(text, '^\s*from\s+\S+\s+import\s+\(?([\w ,.]+)\)?\s*(?:#.*)?$', 1), ''), nullif(regexp_extract(text, '^\s*import\s+([\w ,.]+?)\s*(?:#.*)?$', 1), '')) AS py FROM lines WHERE kind = 'added'),
        n AS (SELECT entry_id, pos, unnest(CASE WHEN sc IS NOT NULL THEN list_transform(string_split(translate(sc, '{{}}', '  '), ','), lambda p: regexp_replace(p, '^.*(?:\bas\s|:)', '')) ELSE list_transform(string_split(py, ','), lambda p: regexp_replace(p, '^.* as ', '')) END) AS part FROM a WHERE sc IS NOT NULL OR py IS NOT NULL),
        x AS (SELECT entry_id, pos, regexp_extract(trim(part), '^([A-Za-z_$][\w$]*)', 1) AS name FROM n) SELECT entry_id, pos, name FROM x WHERE name <> ''""",
    "e6_stream_severities": f"WITH {F} SELECT severity, count(*) AS n FROM f GROUP BY 1",
    "e6_stream_counts": f"WITH {_E} SELECT kind, count(*) AS n FROM e GROUP BY 1",
    "e7_stream_daily_counts": f"WITH {_E} SELECT date_trunc('day', event_ts)::TIMESTAMP AS day, kind, count(*) AS n FROM e GROUP BY 1, 2",
    "f2_plain_rule_hits": f"WITH {DIFF}, a AS (SELECT entry_id, text FROM lines WHERE kind = 'added'), h AS ({_rules_sql()}) SELECT category, rule_id, count(*) AS lines, count(DISTINCT entry_id) AS entries FROM h GROUP BY 1, 2",
    "j8_not_dismissed": f"""WITH {F}, {_KNOW}, {_DIS} SELECT review_id, ord FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE (coalesce(d.repository, '') = '' OR d.repository = f.repository) AND (d.category = '' OR d.category = f.category)
        AND ((d.source_file <> '' AND d.source_file = f.file_path) OR len(list_intersect({IDENT.format("concat_ws(' ', f.title, f.description)")}, {IDENT.format("concat_ws(' ', d.title, d.content)")})) >= 3))""",
    "s12_sections": f"""WITH {_LINES_OF_DOCS}, h AS (SELECT *, regexp_matches(line, '^#{{1,6}} +\\S') AS is_h FROM dl), x AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
        SELECT doc_id, section, regexp_replace(max(line) FILTER (is_h), '^#{{1,6}} +|\\s+$', '', 'g') AS title, md5(trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_h), ''), ' ')) AS digest FROM x WHERE section > 0 GROUP BY 1, 2 HAVING trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_h), ''), ' ') <> ''""",
    "x16_rendered": f"""WITH {_KNOW}, r AS (SELECT repository, doc_id, '- [' || kind || '] ' || title || ': ' || regexp_replace(content, '\\s+', ' ', 'g') AS whole, regexp_replace(content, '\\s+', ' ', 'g') AS flat FROM k WHERE kind = 'rule'),
        l AS (SELECT repository, doc_id, CASE WHEN length(flat) > 200 THEN substring(whole, 1, length(whole) - length(flat)) || rtrim(substring(flat, 1, 200)) || '...' ELSE whole END AS line FROM r),
        b AS (SELECT repository, string_agg(line, chr(10) ORDER BY doc_id) AS block FROM l GROUP BY 1) SELECT repository, md5(CASE WHEN length(block) > 1200 THEN rtrim(substring(block, 1, 1200)) || '...' ELSE block END) AS digest FROM b""",
    "f5_applicable_entries": "SELECT entry_id, trim(coalesce(bug_description, '')) <> '' AS applicable FROM benchmark_entries",
    "f6_sane_checks": f"WITH {F} SELECT review_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (category IN ({', '.join(f"'{c}'" for c in C.CHECKS)})), 'correctness') AS checks FROM f GROUP BY 1",
    "f7_applicable_knowledge": "SELECT repository, count(*) + (SELECT count(*) FROM documents WHERE repository = '') AS entries FROM documents WHERE repository <> '' GROUP BY 1",
    "f13_listing": "SELECT kind, coalesce(category, '') AS category, count(*) AS entries, min(doc_id) AS first FROM documents GROUP BY 1, 2",
    "g11_merged_summaries": """SELECT repository, count(*) AS changes, count(*) FILTER (bug_fix <> '') AS purposes, coalesce(sum(length(bug_fix)) FILTER (bug_fix <> ''), 0) AS n_chars, arg_min(bug_fix, entry_id) FILTER (bug_fix <> '') AS first_fix,
        arg_max(bug_fix, entry_id) FILTER (bug_fix <> '') AS last_fix, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM benchmark_entries GROUP BY 1""",
    "g15_costs": f"WITH {_E}, {_U} SELECT review_id, round(sum(it) / 1e6 * 3.0, 6) AS cost FROM u GROUP BY 1",
    "s16_file_history": "WITH x AS (SELECT entry_id, repository, unnest(list_distinct(affected_files)) AS path FROM benchmark_entries), r AS (SELECT *, row_number() OVER (PARTITION BY repository, path ORDER BY entry_id DESC) AS n FROM x) SELECT entry_id, repository, path FROM r WHERE n <= 5",
    "s3_repository_names": r"SELECT link_id, regexp_extract(old_repository, '[/:]([^/:]+/[^/]+?)(?:\.git)?/?$', 1) AS name FROM repo_links",
    "u3_ordered_union": """WITH a AS (SELECT entry_id, generate_subscripts(affected_files, 1) - 1 AS o, unnest(affected_files) AS path FROM benchmark_entries UNION ALL SELECT entry_id, 1000000, unnest(map_keys(base_files)) FROM benchmark_entries),
        m AS (SELECT entry_id, path, min(o) AS o FROM a GROUP BY 1, 2) SELECT entry_id, path, row_number() OVER (PARTITION BY entry_id ORDER BY o, path) AS place FROM m""",
    "u6_task_order": f"WITH {F} SELECT review_id, ord, row_number() OVER (PARTITION BY review_id ORDER BY evidence_status <> 'confirmed', ord) AS place FROM f",
    "w5_inflated_budget": "WITH x AS (SELECT repository, sum(length(text)) OVER (PARTITION BY repository ORDER BY doc_id) AS used FROM documents WHERE text IS NOT NULL) SELECT repository, count(*) FILTER (used <= 24000) AS taken, max(used) AS used FROM x GROUP BY 1",
    "x13_cache_keys": """SELECT entry_id, sha256('{"model":"scripted","parent":' || coalesce('"' || parent_commit || '"', 'null') || ',"prompt":"' || commit_sha || '","temperature":"0"}') AS key FROM benchmark_entries""",
    "x14_extracted_json": f"WITH {_E} SELECT event_no, md5(payload) AS digest FROM e WHERE payload IS NOT NULL",
    "x15_filled_template": "SELECT entry_id, 'Review of ' || repository || ' in ' || language || '.' AS prompt FROM benchmark_entries",
    "x19_retry_schedule": f"WITH {_S} SELECT score_id, a.range AS attempt, 2.0 * pow(2, a.range) + 0.1 * a.range AS wait FROM s, range(3) a WHERE NOT success",
    "x22_knowledge_of_findings": f"WITH {F} SELECT review_id, ord, substring(sha256('finding' || chr(0) || title || chr(0) || description || chr(10) || 'Evidence: ' || evidence || chr(10) || 'Recommendation: ' || recommendation || chr(0) || repository || chr(0) || category), 1, 16) AS content_id FROM f WHERE evidence_status = 'confirmed'",
    "code_signature_changes": rf"""WITH {DIFF}, x AS (SELECT entry_id, path, kind, new_line, regexp_extract(text, '^\s*(?:async\s+)?def\s+(\w+)\s*\((.*)$', 1) AS name, regexp_extract(text, '^\s*(?:async\s+)?def\s+(\w+)\s*\((.*)$', 2) AS rest FROM lines JOIN files USING (entry_id, file_idx) WHERE kind <> 'context')
        SELECT DISTINCT n.entry_id, n.path, n.name, n.new_line AS line FROM x n JOIN x o ON o.entry_id = n.entry_id AND o.path = n.path AND o.name = n.name AND o.kind = 'removed' AND n.kind = 'added' WHERE n.name <> '' AND o.rest <> n.rest""",
    "code_snapshot_budget": f"WITH {_FILES}, x AS (SELECT entry_id, path, sum(length(content)) OVER w AS used, row_number() OVER w AS n FROM bf WHERE length(content) <= 1000000 WINDOW w AS (PARTITION BY entry_id ORDER BY path)) SELECT entry_id, path, used FROM x WHERE n <= 4000 AND used <= 4000",
}
