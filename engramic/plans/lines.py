"""More queries of one column a row: capture rules, reflection reports, governance, ownership and metadata.

Each entry is name: (column, SQL of the same column). Rows come back as id, value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import admission, capture, governance, identity, metadata, recall, reflection, rules, schedule, scoring, text
from engramic.plans import memories
from engramic.plans.columns import _DEEP, _RECENCY, _SCORE, _TOTAL, Row, _any, _unit, r6
from engramic.plans.memories import BASE, DAY, NOW, PHRASE_SQL, SMART_SQL, TRIM

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_OR = lambda parts: "(" + " OR ".join(parts) + ")"
_HEADERS = capture.HEADERS.replace(r"[\s\S]*?", "(?s:.*?)")
_CAPTURE = f"""(SELECT length(s) BETWEEN CASE WHEN regexp_matches(s, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]') THEN 4 ELSE 10 END AND 500
  AND NOT contains(s, '<relevant-memories>') AND NOT (starts_with(s, '<') AND contains(s, '</')) AND NOT (contains(s, '**') AND contains(s, chr(10) || '-'))
  AND len(regexp_extract_all(s, '{capture.EMOJI}')) <= 3 AND NOT {_any(capture.EXCLUDED, 's')} AND {_any(capture.TRIGGERS, 's')}
  FROM (SELECT regexp_replace(t, {_Q(_HEADERS)}, '', 'g') AS s) z)"""
_PLAIN = "regexp_replace(regexp_replace(replace(%s, '**', ''), '(?i)^(invariants?|reflections?|derived)[:：]\\s*', ''), " + TRIM + ")"
_TRIMMED = "regexp_replace(%s, " + TRIM + ")"
_HOLDS = lambda x: _OR([f"{_TRIMMED % f'replace({x}, {_Q('**')}, {_Q('')})'} = ''", _any(reflection.PLACEHOLDERS, _TRIMMED % f"replace({x}, '**', '')")])
_SPANS = rf"list_filter(list_transform(string_split_regex(text, '\n+'), lambda l: {_TRIMMED % 'l'}), lambda l: l <> '')"
_SPANS = rf"array_to_string(list_sort(list_distinct(list_concat({_SPANS}, flatten(list_transform({_SPANS}, lambda l: list_filter(list_transform(string_split_regex(l, '[。！？!?]+'), lambda s: {_TRIMMED % 's'}), lambda s: length(s) >= 4)))))), '|')"
_WORDS = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]{4,}'), lambda w: regexp_replace(w, '^[-_]+|[-_]+$', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(map(_Q, rules.STOP_WORDS)) + "], w))))"


def _expanded() -> str:
    groups = []
    for cn, en, more in rules.SYNONYMS:
        hit = _OR([f"contains(lower(text), {_Q(c.lower())})" for c in cn] + [f"regexp_matches(text, {_Q(r'(?i)\b' + e + r'\b')})" for e in en])
        groups.append(f"CASE WHEN {hit} THEN list_filter([{', '.join(map(_Q, more))}], lambda e: NOT contains(lower(text), lower(e))) ELSE [] END")
    every = f"flatten([{', '.join(groups)}])"
    # first occurrences, in order
    first = f"list_filter({every}, lambda e, i: list_position({every}, e) = i)[1:5]"
    return f"CASE WHEN length(t) < 2 OR len({every}) = 0 THEN text ELSE text || ' ' || array_to_string({first}, ' ') END"


def _first(patterns: list[str], of: str) -> str:
    cut = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace({x}, '^[\s"''“”‘’「」『』*`_]+', ''), '[\s"''“”‘’「」『』*`_。！，、,.!?:：；;]+$', ''), {TRIM})"""
    return "coalesce(" + ", ".join(f"nullif({cut(f'regexp_extract({of}, {_Q('(?i)' + p)}, 1)')}, '')" for p in patterns) + ")"


_OWN = """'{' || CASE doc_id % 4 WHEN 0 THEN '"agentId":" main "' WHEN 1 THEN '"agentId":"helper"' WHEN 2 THEN '"agentId":""' ELSE '"other":1' END
  || CASE doc_id % 5 WHEN 0 THEN ',"itemKind":"derived"' WHEN 1 THEN ',"itemKind":"invariant"' WHEN 2 THEN ',"itemKind":7' WHEN 3 THEN ',"itemKind":null' ELSE '' END
  || CASE doc_id % 3 WHEN 0 THEN ',"resolvedAt":null' WHEN 1 THEN ',"resolvedAt":5' ELSE '' END || '}'"""
_AGENT = "CASE doc_id % 6 WHEN 0 THEN 'main' WHEN 1 THEN ' pi-one ' WHEN 2 THEN 'pilot' WHEN 3 THEN '12345' WHEN 4 THEN ' ' ELSE 'helper' END"
_SESSION = "CASE doc_id % 7 WHEN 0 THEN 'agent:main:chat:1' WHEN 1 THEN 'agent:helper' WHEN 2 THEN 'agent:system:x' WHEN 3 THEN ' temp:memory-reflection:9' WHEN 4 THEN 'user:1' WHEN 5 THEN 'agent: ' ELSE '' END"
_SCOPE = "CASE doc_id % 8 WHEN 0 THEN 'global' WHEN 1 THEN 'agent:main' WHEN 2 THEN 'reflection:agent:main' WHEN 3 THEN ' custom:x ' WHEN 4 THEN 'src1' WHEN 5 THEN ' ' WHEN 6 THEN 'user:u' ELSE 'project:p' END"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'user-model' WHEN 2 THEN 'agent-model' ELSE 'lesson' END"
_CONTEXT = "CASE doc_id % 6 WHEN 0 THEN ' Evening ' WHEN 1 THEN '周末' WHEN 2 THEN 'Launch Week' WHEN 3 THEN '' WHEN 4 THEN 'work' ELSE '出差' END"
_CRON = "CASE doc_id % 6 WHEN 0 THEN '30 4 * * *' WHEN 1 THEN '@daily' WHEN 2 THEN '0 24 * * *' WHEN 3 THEN ' 5 23 * * * ' WHEN 4 THEN '5 3 * * 1' ELSE '75 3 * * *' END"
_NAMED = lambda sql, table: f"CASE {sql} " + " ".join(f"WHEN {_Q(k)} THEN {_Q(v)}" for k, v in table.items()) + " END"
_ACCESS = {"main": ["global", "src:src1"], "helper": []}
_POLICY = {"src:src1*": "none", "src:src2": "full", "src:*": "episodic-only"}
_MD = "CASE WHEN json_valid(metadata) THEN metadata::JSON ELSE '{}'::JSON END"
_FADE = " ".join(f"WHEN '{k}' THEN '{k}|{a}|{b}|{c}|{d}'" for k, (a, b, c, d) in reflection.FADING.items())
_L = lambda f: f"coalesce({_TRIMMED % f'json_extract_string({_MD}, {_Q('$.' + f)})'}, '')"
_TOP = [f"{_Q(x)} IN (source, category, memory_category, layer)" for x in ("durable", "fact")]
_INTENDED = "(SELECT CASE " + " ".join(f"WHEN {_any(p)} THEN [{', '.join(map(_Q, c))}]" for _, _, p, c in rules.INTENTS) + f" ELSE [] END FROM (SELECT {_TRIMMED % 'text'} AS t) z)"
_PRIOR = "CASE memory_category " + " ".join(f"WHEN '{c}' THEN {p}::DOUBLE" for c, p in admission.PRIORS["balanced"].items()) + " END"

#: Over memory rows with their typed metadata.
ROWS: dict[str, tuple[Callable[[Row], Column], str]] = {
    "b6_metadata_caps": (lambda r: governance.capped(F.sequence(F.lit(1), F.col("doc_id") % 30 + 1), F.sequence(F.lit(1), F.col("doc_id") % 70 + 1), F.sequence(F.lit(1), F.col("doc_id") % 20 + 1)), "'{\"sources\":' || to_json(range(greatest(1, doc_id % 30 - 18), doc_id % 30 + 2))::VARCHAR || ',\"history\":' || to_json(range(greatest(1, doc_id % 70 - 48), doc_id % 70 + 2))::VARCHAR || ',\"relations\":' || to_json(range(1, least(16, doc_id % 20 + 1) + 1))::VARCHAR || '}'"),
    "b10_lifecycle": (lambda r: F.concat_ws("|", "importance", r.meta["confidence"], r.meta["tier"], r.meta["access_count"], r.at, F.coalesce(F.when(r.meta["last_accessed_at"] > 0, r.meta["last_accessed_at"]), r.at), r.meta["temporal_type"]), "concat_ws('|', importance, confidence, tier, access_count, timestamp, last_accessed_at, temporal_type)"),
    "b17_context": (lambda r: capture.context(F.expr(_CONTEXT)), f"(SELECT CASE WHEN c = '' THEN 'general' ELSE coalesce({_NAMED('c', capture.CONTEXT_NAMES)}, c) END FROM (SELECT lower(trim({_CONTEXT})) AS c) z)"),
    "b24_mapped_fading": (lambda r: F.concat_ws("|", F.expr(_KIND), *[reflection.fading(F.expr(_KIND))[c].cast("string") for c in ("midpoint_days", "k", "weight", "quality")]), f"CASE {_KIND} {_FADE} END"),
    "b25_compacted_abstract": (lambda r: text.trim(F.substring(r.meta["l0"], 1, 180)), _TRIMMED % "substr(l0, 1, 180)"),
    "b26_simple_levels": (lambda r: F.concat_ws("|", governance.simple_levels(r.t)["l0"], governance.simple_levels(r.t)["l1"]), rf"(SELECT concat_ws('|', z, '- ' || z) FROM (SELECT {_TRIMMED % '''substr(CASE WHEN regexp_matches(text, '^[^.!?。！？' || chr(10) || ']') THEN regexp_extract(text, '^[^.!?。！？' || chr(10) || ']+[.!?。！？]?') ELSE text END, 1, 100)'''} AS z) y)"),
    "b27_fact_serialiser": (lambda r: F.concat_ws("|", "id", "scope", "category", r.meta["memory_category"], r.meta["fact_key"], metadata.active_at(r.now).cast("string"), r.meta["valid_from"], r.meta["valid_until"], r.meta["invalidated_at"]), f"concat_ws('|', id, scope, category, memory_category, fact_key, {memories.ACTIVE_SQL}::VARCHAR, valid_from, valid_until, invalidated_at)"),
    "c17_neighbor_governance": (lambda r: recall.eligible(r.meta, r.now), f"state = 'confirmed' AND layer NOT IN ('archive', 'reflection') AND NOT coalesce(suppressed_until_ms > {NOW}, false)"),
    "c20_source_filter": (lambda r: governance.from_sources(r.meta, F.col("category"), ["recall", "durable", "fact"]), f"source IN ('manual', 'auto-capture', 'legacy') OR {' OR '.join(_TOP)}"),
    "c21_active_user_memory": (lambda r: governance.active_user(r.meta, r.now), f"state <> 'archived' AND layer <> 'archive' AND coalesce(invalidated_at > {NOW}, true) AND source <> 'dreaming-engine'"),
    "c22_reflection_owner": (lambda r: governance.owned(F.expr(_OWN), "main"), f"(SELECT coalesce((json_type(o, '$.itemKind') IS NULL OR json_type(o, '$.itemKind') = 'VARCHAR') AND trim(json_extract_string(o, '$.agentId')) = 'main', false) FROM (SELECT ({_OWN})::JSON AS o) z)"),
    "c23_reflection_row": (lambda r: governance.is_reflection(F.col("category"), r.meta["row_type"]), "category = 'reflection' OR coalesce(row_type IN ('memory-reflection', 'memory-reflection-event', 'memory-reflection-item'), false)"),
    "c24_unresolved": (lambda r: governance.unresolved(r.meta["row_type"], F.expr(_OWN)), "coalesce(row_type = 'memory-reflection-item', false) AND doc_id % 3 = 2"),
    "c25_temporal_fact": (lambda r: governance.temporal_fact(F.col("metadata")), f"(SELECT coalesce(list_has_any(json_keys(j), ['supersedes', 'superseded_by', 'invalidated_at', 'valid_until']), false) OR coalesce(json_extract_string(j, '$.memory_temporal_type') = 'dynamic', false) FROM (SELECT {_MD} AS j) z)"),
    "c26_fact_query": (lambda r: governance.fact_matches(r.meta, r.t, "EDITOR 3", None), "coalesce(contains(lower(fact_key), 'editor 3'), false) OR contains(memory_category, 'editor 3') OR contains(lower(l0), 'editor 3') OR contains(lower(l1), 'editor 3') OR contains(lower(text), 'editor 3')"),
    "c27_legacy_row": (lambda r: governance.is_legacy(F.col("category"), r.meta), f"category <> 'reflection' AND NOT starts_with(coalesce(row_type, ''), 'memory-reflection') AND coalesce(json_extract_string({_MD}, '$.memory_category'), '') = ''"),
    "c28_summary_levels": (lambda r: governance.level_fault(F.col("metadata")), f"CASE WHEN {_L('l0_abstract')} = '' OR {_L('l1_overview')} = '' OR {_L('l2_content')} = '' THEN 'missing summary level(s)' WHEN {_L('l0_abstract')} = {_L('l1_overview')} AND {_L('l1_overview')} = {_L('l2_content')} THEN 'degenerate identical levels' END"),
    "c30_extraction_policy": (lambda r: capture.extraction_policy(F.col("scope"), _POLICY), "CASE WHEN scope = 'src:src2' THEN 'full' WHEN scope LIKE 'src:src1%' THEN 'none' WHEN scope LIKE 'src:%' THEN 'episodic-only' ELSE 'full' END"),
    "c31_agent_exclusion": (lambda r: capture.excluded_agent(F.expr(_AGENT), F.expr(_SESSION), ["pi-", " helper", "temp:*", ""]), f"trim({_AGENT}) <> '' AND (starts_with(trim({_AGENT}), 'pi-') OR trim({_AGENT}) = 'helper' OR starts_with(trim({_SESSION}), 'temp:memory-reflection'))"),
    "c32_agent_id": (lambda r: capture.invalid_agent(F.expr(_AGENT), ["main", "pilot"]), f"trim({_AGENT}) = '' OR regexp_full_match({_AGENT}, '[0-9]+') OR {_AGENT} NOT IN ('main', 'pilot')"),
    "c33_scope_validity": (lambda r: capture.valid_scope(F.expr(_SCOPE), ["src1"]), f"trim({_SCOPE}) IN ('global', 'src1') OR regexp_matches(trim({_SCOPE}), '^(agent|custom|project|user|reflection):')"),
    "d12_tier_of_decay": (lambda r: F.concat_ws("|", r.meta["tier"], F.coalesce(scoring.next_tier(r.meta["tier"], r.meta["access_count"], r.total, r.imp, r.at, r.now), r.meta["tier"]), r6(r.total).cast("decimal(9,4)")), f"(SELECT concat_ws('|', tier, CASE WHEN tier = 'peripheral' AND access_count >= 3 AND c >= 0.4 THEN 'working' WHEN tier = 'working' AND access_count >= 10 AND c >= 0.7 AND importance >= 0.8 THEN 'core' WHEN tier = 'working' AND (c < 0.15 OR (({NOW} - timestamp) / {DAY}.0 > 60 AND access_count < 3)) THEN 'peripheral' WHEN tier = 'core' AND c < 0.15 AND access_count < 3 THEN 'working' ELSE tier END, round(c, 6)::DECIMAL(9, 6)::DECIMAL(9, 4)) FROM (SELECT {_TOTAL} AS c) z)"),
    "g7_category_boost": (lambda r: r6(scoring.category_boost(r.score, F.col("category"), rules.intent(r.t))), f"round(CASE WHEN list_contains({_INTENDED}, category) THEN least(1, {_SCORE} * 1.15) ELSE {_SCORE} END, 6)"),
    "h2_scope_union": (lambda r: F.array_join(capture.accessible_scopes(F.expr(_AGENT), _ACCESS), ","), f"CASE trim({_AGENT}) WHEN 'main' THEN 'global,src:src1,reflection:agent:main' WHEN 'helper' THEN 'reflection:agent:helper' ELSE 'global,agent:' || trim({_AGENT}) || ',reflection:agent:' || trim({_AGENT}) END"),
    "h6_scope_intersection": (lambda r: F.array_join(F.array_intersect(F.array(F.col("scope"), F.lit("global"), F.lit("reflection:agent:main")), capture.accessible_scopes(F.lit("main"), _ACCESS)), ","), "CASE WHEN scope = 'src:src1' THEN 'src:src1,' ELSE '' END || 'global,reflection:agent:main'"),
    "i17_search_boost": (lambda r: r6(scoring.search_boost(r.meta["tier"], r.total, r.recency)), f"round(least(1, 0.3 + 0.7 * greatest(CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END, {_TOTAL}, {_RECENCY})), 6)"),
    "i5_rerank_blend": (lambda r: r6(scoring.rerank_blend(r.score, F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 7) / 7.0), (F.col("doc_id") % 4) * 0.25 + 0.1)), f"""round((SELECT greatest(f, least(1, CASE WHEN doc_id % 3 > 0 THEN 0.6 * (doc_id % 7) / 7.0::DOUBLE + 0.4 * {_SCORE} ELSE 0.8 * {_SCORE} END)) FROM (SELECT {_SCORE} * CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 3 THEN 1 WHEN 2 THEN 0.95 ELSE 0.8 END ELSE CASE doc_id % 4 WHEN 3 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.5 END END AS f) z), 6)"""),
    "i6_cosine_rerank": (lambda r: r6(scoring.cosine_rerank(r.score, (F.col("doc_id") % 9) / 4.0 - 1)), _unit(f"0.7 * {_SCORE} + 0.3 * ((doc_id % 9) / 4.0::DOUBLE - 1)")),
    "i23_type_prior": (lambda r: admission.type_prior(r.meta["memory_category"], F.col("doc_id") % 3 == 0), f"CASE WHEN doc_id % 3 = 0 AND memory_category <> 'events' THEN least({_PRIOR}, 0.45) ELSE {_PRIOR} END"),
    "i62_session_agent": (lambda r: capture.agent_of_session(F.expr(_SESSION)), f"CASE WHEN starts_with(trim({_SESSION}), 'agent:') THEN nullif(nullif(trim(split_part(trim({_SESSION}), ':', 2)), ''), 'system') END"),
    "i66_cron": (lambda r: schedule.minute_of_day(F.expr(_CRON)), "CASE doc_id % 6 WHEN 0 THEN 270 WHEN 1 THEN 0 WHEN 3 THEN 1385 END"),
    "i67_next_run": (lambda r: schedule.wait_ms(F.expr(_CRON), r.at, 8), "(SELECT CASE WHEN m IS NULL THEN 86400000 ELSE greatest(1000, w + CASE WHEN w <= 500 THEN 86400000 ELSE 0 END) END::BIGINT FROM (SELECT m, m * 60000 - (timestamp + 28800000) % 86400000 AS w FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 270 WHEN 1 THEN 0 WHEN 3 THEN 1385 END AS m) z) y)"),
    "i68_date_stamp": (lambda r: schedule.date_stamp(r.at, 8), "strftime(make_timestamp((timestamp + 28800000) * 1000), '%Y-%m-%d')"),
}

#: Over the documents and the literal phrases.
TEXTS: dict[str, tuple[Callable[[Row], Column], str]] = {
    "c12_capture_trigger": (lambda r: capture.capturable(r.t), _CAPTURE),
    "c13_remember_command": (lambda r: capture.remember_command(r.t), _any([capture.REMEMBER_COMMAND])),
    "c34_unsafe_line": (lambda r: reflection.is_unsafe(r.t), f"(SELECT p = '' OR {_any(reflection.UNSAFE, 'p')} FROM (SELECT {_PLAIN % 'text'} AS p) z)"),
    "c35_placeholder_line": (lambda r: reflection.is_placeholder(r.t), _HOLDS("text")),
    "c37_recall_used": (lambda r: capture.recall_used(r.t), f"length(text) > 24 AND {_OR([f'contains(lower(text), {_Q(m)})' for m in capture.USE_MARKERS])}"),
    "c38_transcript_noise": (lambda r: capture.transcript_noise(r.t), f"text = '' OR starts_with(ltrim(text), '/') OR length(text) > 2000 OR {_OR([f'starts_with(text, {_Q(p)})' for p in capture.NOISE_PREFIXES])} OR {_OR([f'contains(lower(text), {_Q(p)})' for p in capture.NOISE_PARTS])} OR (starts_with(trim(text), '```') AND ends_with(trim(text), '```'))"),
    "i29_support_spans": (lambda r: F.array_join(F.array_sort(rules.support_spans(r.t)), "|"), _SPANS),
    "i30_pattern_words": (lambda r: F.array_join(F.array_sort(F.array_distinct(rules.pattern_words(r.t))), "|"), f"array_to_string({_WORDS}, '|')"),
    "i32_query_expansion": (lambda r: rules.expand_query(r.t), _expanded()),
    "i37_depth_l1": (lambda r: rules.at_depth(r.t, F.lit("fact"), F.lit("global"), "l1", F.lit(0.5)), "'- [fact:global] ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END || ' (50%)'"),
    "i51_line_key": (lambda r: reflection.line_key(r.t), rf"lower(regexp_replace(regexp_replace(text, '[\s\p{{Z}}\x{{FEFF}}\x0B]+', ' ', 'g'), {TRIM}))"),
    "i59_identity": (lambda r: F.concat_ws("|", identity.values(r.t)["name"], identity.values(r.t)["addressing"]), f"concat_ws('|', {_first(identity.NAMES, 't')}, {_first(identity.ADDRESSES, 't')})"),
}

_BR = " || chr(10) || "
#: A report in Markdown made of the row's number.
_REPORT = _BR.join([
    "'# Run ' || CAST(doc_id AS STRING)", "'## Invariants'",
    "CASE doc_id % 5 WHEN 0 THEN '- Always pin build ' || CAST(doc_id % 7 AS STRING) WHEN 1 THEN '- (none captured)' WHEN 2 THEN '* **Invariants:** never push on day ' || CAST(doc_id % 3 AS STRING) WHEN 3 THEN '- plain remark' ELSE 'no bullet' END",
    "'- should keep logs '", "'## Derived'",
    "CASE doc_id % 4 WHEN 0 THEN '- Next run: retry step ' || CAST(doc_id % 9 AS STRING) WHEN 1 THEN '- nothing' ELSE '' END",
    "'## Invariants & Reflections'", "'- stable rule: never skip tests' || chr(10) || '- reflect: verify cache ' || CAST(doc_id % 2 AS STRING)",
    "'## Open loops / next actions'", "'- Verify release ' || CAST(doc_id % 6 AS STRING) || chr(10) || '- ask Ana'",
    "'## Decisions (durable)'", "'- We must use tabs' || chr(10) || '- (none)' || chr(10) || '- agreed on ' || CAST(doc_id % 4 AS STRING)",
    "'## Lessons & pitfalls (symptom / cause / fix / prevention)'", "CASE WHEN doc_id % 3 = 0 THEN '- cache was stale' || chr(10) || '* derived: clear it' ELSE 'none' END",
    "'## Learning governance candidates (.learnings / promotion / skill extraction)'",
    "CASE WHEN doc_id % 2 = 0 THEN '### Entry 1' || chr(10) || '**Priority**: high' || chr(10) || '### Summary' || chr(10) || 'Keep ' || CAST(doc_id % 5 AS STRING) || chr(10) || '### Details' || chr(10) || 'more' || chr(10) || '### Entry 2' || chr(10) || '**Status**: new' ELSE '- one bullet' END",
    "'## Other' || chr(10) || '- end'",
])


def _sec(heading: str) -> str:
    import re

    return f"regexp_extract(report, '(?s)(?:^|\\n)## {re.escape(heading)}\\n(.*?)(?:\\n## |$)', 1)"


def _bul(heading: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split({_sec(heading)}, chr(10)), lambda x: starts_with(trim(x), '- ') OR starts_with(trim(x), '* ')), lambda x: trim(substr(trim(x), 3))), lambda x: x <> '')"


def _cleaned(lines: str) -> str:
    return f"list_filter(list_transform({lines}, lambda x: {_PLAIN % 'x'}), lambda x: NOT {_HOLDS('x')})"


def _only(lines: str, *sets: list[str]) -> str:
    return f"list_filter({lines}, lambda x: {' AND '.join(_any(s, 'x') for s in sets)})"


_INV = [_only(_cleaned(_bul("Invariants")), reflection.INVARIANT), _only(_cleaned(_only(_bul("Invariants & Reflections"), ["invariant|stable|policy|rule"])), reflection.INVARIANT), _only(_cleaned(_bul("Decisions (durable)")), reflection.INVARIANT)]
_DER = [_only(_cleaned(_bul("Derived")), reflection.DERIVED), _only(_cleaned(_only(_bul("Invariants & Reflections"), ["reflect|inherit|derive|change|apply"])), reflection.DERIVED), _only(_cleaned(_bul("Open loops / next actions")), reflection.OPEN_LOOP, reflection.DERIVED)]
_SLICES = f"array_to_string((CASE WHEN len({_INV[0]}) > 0 THEN {_INV[0]} WHEN len({_INV[1]}) > 0 THEN {_INV[1]} ELSE {_INV[2]} END)[1:8], '|') || '||' || array_to_string((CASE WHEN len({_DER[0]}) > 0 THEN {_DER[0]} ELSE list_concat({_DER[1]}, {_DER[2]}) END)[1:10], '|')"
_ITEMS = " || ".join(f"array_to_string(list_transform({_cleaned(_bul(h))}, lambda x, i: '{k}:' || (i - 1) || '/' || len({_cleaned(_bul(h))}) || ':' || x || ';'), '')" for h, _, k, _ in reflection.MAPPED)

#: Over the reports.
REPORTS: dict[str, tuple[Callable[[Row], Column], str]] = {
    "i52_section": (lambda r: reflection.section(F.col("report"), "Invariants"), _TRIMMED % _sec("Invariants")),
    "i53_bullets": (lambda r: F.array_join(reflection.bullets(F.col("report"), "Decisions (durable)"), "|"), f"array_to_string({_bul('Decisions (durable)')}, '|')"),
    "i54_reflection_slices": (lambda r: F.concat_ws("||", F.array_join(reflection.slices(F.col("report"))["invariants"], "|"), F.array_join(reflection.slices(F.col("report"))["derived"], "|")), _SLICES),
    "i55_mapped_items": (lambda r: F.array_join(F.transform(reflection.mapped_items(F.col("report")), lambda x: F.concat(x.kind, F.lit(":"), x.ordinal, F.lit("/"), x.group_size, F.lit(":"), x.text, F.lit(";"))), ""), _ITEMS),
    "i56_governance": (lambda r: F.array_join(F.transform(reflection.governance(F.col("report")), lambda e: F.concat_ws("|", e.priority, e.summary, e.details)), ";"), "CASE WHEN doc_id % 2 = 0 THEN 'high|Keep ' || (doc_id % 5) || '|more' ELSE '' END"),
}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), "doc_id", F.expr(_REPORT).alias("report"))


def _run(of: Callable[[SparkSession, str], DataFrame], value: Callable[[Row], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir)
    return rows.select("id", value(Row()).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sets = ((memories.smart, ROWS), (memories.phrases, TEXTS), (reports, REPORTS))
    return {name: partial(_run, of, value) for of, entries in sets for name, (value, _) in entries.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: f"WITH {SMART_SQL} SELECT id, {sql} AS value FROM smart" for name, (_, sql) in ROWS.items()}
    out |= {name: f"WITH {PHRASE_SQL} SELECT id, {sql} AS value FROM ph" for name, (_, sql) in TEXTS.items()}
    return out | {name: f"SELECT id, {sql} AS value FROM (SELECT 'doc:' || doc_id AS id, doc_id, {_REPORT} AS report FROM documents) z" for name, (_, sql) in REPORTS.items()}
