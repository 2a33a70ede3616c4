"""Queries of one column a row: each applies a function of the library to all memory rows or phrases.

Each entry is name: (table, column, SQL of the same column). Rows come back as id, value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import capture, metadata, recall, rules, scoring, text
from engramic.plans import memories
from engramic.plans.memories import ACTIVE_SQL, BASE, DAY, HOUR, NOW, PHRASE_SQL, SMART_SQL, TRIM


class Row:
    """The columns of a memory row that queries name; made when a query runs, since columns need a session."""

    def __init__(self) -> None:
        self.now, self.meta, self.t = F.lit(NOW), F.col("meta"), F.col("text")
        self.at, self.imp = F.col("timestamp"), F.col("importance")
        self.last_active = F.when(self.meta["access_count"] > 0, self.meta["last_accessed_at"]).otherwise(self.at)
        self.dynamic = F.coalesce(self.meta["temporal_type"] == "dynamic", F.lit(False))
        self.recency = scoring.weibull_recency(self.imp, self.meta["tier"], self.dynamic, self.last_active, self.now)
        self.frequent = scoring.frequency(self.meta["access_count"], self.at, self.last_active)
        self.total = scoring.composite(self.recency, self.frequent, self.imp * self.meta["confidence"])
        self.score = (F.col("doc_id") % 10 + 1) / 10.0
        self.half_life = scoring.effective_half_life(F.when(self.dynamic, 20.0).otherwise(60.0), self.meta["reinforced"], self.meta["reinforced_at"], self.now)
        self.corpus = F.lit(False)
        self.label = F.element_at(F.array(*map(F.lit, ["Preference ", "profile", "Event", "other", "decision", "nonsense", "CASE"])), (F.col("doc_id") % 7 + 1).cast("int"))
        self.stamp = F.when(F.col("doc_id") % 3 == 0, "1700000000").when(F.col("doc_id") % 3 == 1, "1700000000123.9").otherwise("bad")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _any(patterns: list[str], of: str = "t") -> str:
    return f"regexp_matches({of}, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_PARSED = "CASE doc_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'plain' WHEN 2 THEN scope || ':more' ELSE scope END"
_ACTIVE = "CASE WHEN access_count > 0 THEN last_accessed_at ELSE timestamp END"
_RECENCY = f"exp(-ln(2) / (CASE WHEN temporal_type = 'dynamic' THEN 10.0 ELSE 30.0 END * exp(1.5 * importance)) * pow(greatest(0, ({NOW} - ({_ACTIVE})) / {DAY}.0::DOUBLE), CASE tier WHEN 'core' THEN 0.8 WHEN 'working' THEN 1.0 ELSE 1.3 END))"
_FREQ = f"(1 - exp(-access_count / 5.0::DOUBLE)) * CASE WHEN access_count <= 1 THEN 1 ELSE 0.5 + 0.5 * exp(-greatest(1, (({_ACTIVE}) - timestamp) / {DAY}.0::DOUBLE) / greatest(access_count - 1, 1) / 30) END"
_TOTAL = f"(0.4 * {_RECENCY} + 0.3 * {_FREQ} + 0.3 * importance * confidence)"
_SCORE = "((doc_id % 10 + 1) / 10.0::DOUBLE)"
_AGE = f"(({NOW} - timestamp) / {DAY}.0::DOUBLE)"
_REINFORCED = "least(10000, access_count)"
_SEEN = "CASE WHEN TRY_CAST(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata::JSON ELSE '{}'::JSON END, '$.last_accessed_at') AS BIGINT) IS NULL THEN 0 ELSE last_accessed_at END"
_HALF = f"(CASE WHEN {_REINFORCED} <= 0 THEN 1 ELSE least(1 + 0.5 * ln(1 + {_REINFORCED} * exp(-greatest(0, ({NOW} - ({_SEEN})) / {DAY}.0::DOUBLE) * ln(2) / 30)), 3) END * CASE WHEN temporal_type = 'dynamic' THEN 20.0 ELSE 60.0 END)"
_DEEP = f"(importance * 0.45 + confidence * 0.2 + least(1, access_count / 6.0::DOUBLE) * 0.25 + exp(-greatest(0, {_AGE}) / 14) * 0.1)"


def _unit(x: str) -> str:
    return f"round(greatest(0, least(1, {x})), 6)"


_MIN = "CASE WHEN regexp_matches(t, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]') THEN %d ELSE %d END"
_QUERY = rf"""(SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  t, '(?im)^(Conversation info|Sender) \(untrusted metadata\):(?s:.*?)\n\s*\n', '', 'g'), '(?i)^\[cron:[^\]]+\]\s*', ''),
  '^\[[A-Za-z]{{3}}\s\d{{4}}-\d{{2}}-\d{{2}}\s\d{{2}}:\d{{2}}\s[^\]]+\]\s*', ''), {TRIM}))"""
_U = (_MIN % (6, 15)).replace("(t,", "(u,")
_SKIP = f"(SELECT NOT {_any(rules.FORCED, 'u')} AND (length(u) < 5 OR {_any(rules.SKIPPED, 'u')} OR (length(u) < {_U} AND NOT contains(u, '?') AND NOT contains(u, '？'))) FROM (SELECT {_QUERY} AS u) x)"
_VALUE = f"""CASE WHEN t = '' THEN 'empty' WHEN {_any(rules.TOOL_CALLS)} THEN 'tool_call' WHEN {_any(rules.CORRECTIONS)} THEN 'correction'
  WHEN {_any(rules.DECISIONS)} THEN 'decision' WHEN {_any(rules.ACKNOWLEDGED)} THEN 'acknowledgment'
  WHEN length(t) > {_MIN % (30, 80)} THEN CASE WHEN regexp_matches(t, '^<[a-z-]+>') AND regexp_matches(t, '</[a-z-]+>\\s*$') THEN 'system_xml' ELSE 'substantive' END
  WHEN contains(t, '?') OR contains(t, '？') THEN 'short_question' ELSE 'short_statement' END"""
_INTENT = "CASE WHEN t = '' THEN 'empty' " + " ".join(f"WHEN {_any(p)} THEN '{n}'" for n, _, p, _ in rules.INTENTS) + " ELSE 'broad' END"
_HINT = "CASE " + " ".join(f"WHEN {_any(p, 'lower(text)')} THEN '{c}'" for c, p in rules.CATEGORY_HINTS) + " ELSE 'other' END"
_EXPIRY = "CASE " + " ".join(f"WHEN {_any(p, 'text')} THEN {NOW + h * 3_600_000}" for p, h in rules.EXPIRIES) + " END::BIGINT"
_STEP = "CASE x WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 WHEN 3 THEN 0.6 WHEN 4 THEN 0.8 WHEN 5 THEN 0.95 ELSE greatest(0, least(1, x)) END"
_STRIKES = f"(CASE WHEN suppressed_until_ms IS NULL OR coalesce({NOW} - last_injected_at > {DAY}, true) THEN 0 ELSE bad_recall_count END + CASE WHEN last_injected_at IS NOT NULL AND coalesce(last_confirmed_use_at < last_injected_at, true) THEN 1 ELSE 0 END)"
_REDACTED = r"regexp_replace(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [REDACTED]', 'g')"
for _p in rules.SECRETS:
    _to = "[REDACTED]"
    if "(?<=" in _p:  # no look-around in the oracle's patterns
        _p, _to = _p.replace("(?<=://)", "(://)").replace("(?=@)", "(@)"), r"\1[REDACTED]\2"
    _REDACTED = "regexp_replace(" + _REDACTED + ", '" + _p.replace("'", "''") + f"', '{_to}', 'g')"
_SQUEEZED = r"regexp_replace(%s, '[\s\p{Z}\x{FEFF}\x0B]+', ' ', 'g')"
_SIGNATURE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_REDACTED}), '[a-z]:\\[^ \n\r\t]+', '<path>', 'g'), '/[^ \n\r\t]+', '<path>', 'g'), '\b0x[0-9a-f]+\b', '<hex>', 'g'), '\b\d+\b', '<n>', 'g')"
_SIGNATURE = f"substr(regexp_replace({_SQUEEZED % _SIGNATURE}, {TRIM}), 1, 240)"
_SAFE = r"translate(regexp_replace(regexp_replace(text, '[\r\n]+', '\\n', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '<>', '＜＞')"
_SAFE = f"substr(regexp_replace({_SQUEEZED % _SAFE}, {TRIM}), 1, 300)"
_LABEL = "(['Preference ', 'profile', 'Event', 'other', 'decision', 'nonsense', 'CASE'])[doc_id % 7 + 1]"
_END = r"length(regexp_extract(text, '^((?s:.*?))(?:[.!?]\s|[。！？])', 1))"
_CUT = "regexp_extract(substr(text, 1, 80), '^((?s:.*)) ', 1)"
_SENTENCE = f"CASE WHEN {_END} > 0 AND {_END} < 80 THEN substr(text, 1, {_END} + 1) WHEN length(text) <= 80 THEN text ELSE CASE WHEN length({_CUT}) > 48 THEN {_CUT} ELSE substr(text, 1, 80) END || '...' END"
_KNOWN = f"CASE lower(trim({_LABEL})) WHEN 'preference' THEN 'preferences' WHEN 'profile' THEN 'profile' WHEN 'event' THEN 'events' WHEN 'case' THEN 'cases' END"

#: Over memory rows with their typed metadata.
ROWS: dict[str, tuple[Callable[[Row], Column], str]] = {
    "b1_timestamp_normaliser": (lambda r: metadata.timestamp_ms(r.stamp, r.at), "CASE doc_id % 3 WHEN 0 THEN 1700000000000 WHEN 1 THEN 1700000000123 ELSE timestamp END::BIGINT"),
    "b2_importance_clamp": (lambda r: metadata.importance(r.imp * 2 - 0.5), "round(greatest(0, least(1, importance * 2 - 0.5)), 6)"),
    "b3_legacy_importance": (lambda r: metadata.legacy_importance((F.col("doc_id") % 8).cast("double")), f"(SELECT {_STEP} FROM (SELECT (doc_id % 8)::DOUBLE AS x) y)::DOUBLE"),
    "b7_legacy_category": (lambda r: metadata.category_from_legacy(F.col("category"), r.t, r.meta["row_type"]), "legacy"),
    "b8_default_layer": (lambda r: r.meta["layer"], "layer"),
    "b9_fact_key": (lambda r: r.meta["fact_key"], "fact_key"),
    "b11_category_normaliser": (lambda r: metadata.category(r.label), _KNOWN),
    "b12_tool_category": (lambda r: F.concat_ws("/", metadata.tool_category(r.label)["memory_category"], metadata.tool_category(r.label)["storage_category"]), f"CASE {_LABEL} WHEN 'other' THEN 'patterns/other' WHEN 'decision' THEN 'events/decision' WHEN 'nonsense' THEN 'patterns/other' WHEN 'profile' THEN 'profile/fact' WHEN 'Event' THEN 'events/decision' WHEN 'CASE' THEN 'cases/fact' ELSE 'preferences/preference' END"),
    "b14_access_metadata": (lambda r: r.meta["reinforced"], f"{_REINFORCED}::BIGINT"),
    "b21_injection_patch": (lambda r: F.concat_ws("|", *[recall.injection_patch(r.meta, r.now)[c] for c in ("access_count", "injected_count", "bad_recall_count", "suppressed_until_ms")]), f"concat_ws('|', access_count + 1, injected_count + 1, {_STRIKES}, CASE WHEN {_STRIKES} >= 3 THEN greatest(coalesce(suppressed_until_ms, 0), {NOW + 1_800_000}) ELSE coalesce(suppressed_until_ms, 0) END)"),
    "b28_serialised_row": (lambda r: F.concat_ws("|", "id", "scope", r.meta["memory_category"], r.meta["tier"]), "concat_ws('|', id, scope, memory_category, tier)"),
    "c3_timestamp_before": (lambda r: metadata.before(F.when(F.col("doc_id") % 3 == 0, F.floor(r.at / 1000)).otherwise(r.at), BASE + 200 * HOUR), f"timestamp < {BASE + 200 * HOUR}"),
    "c4_active_at": (lambda r: metadata.in_force(r.meta, r.now), f"valid_from <= {NOW} AND coalesce(invalidated_at > {NOW}, true)"),
    "c5_expired": (lambda r: metadata.expired(r.meta, r.now), f"coalesce(valid_until <= {NOW}, false)"),
    "c6_category_match": (lambda r: metadata.category_matches(F.col("category"), r.meta["stamped_category"], "events"), "CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 6 = 1 THEN false ELSE category = 'decision' END"),
    "c14_recall_suppressed": (lambda r: recall.suppressed(r.meta, r.now), f"coalesce(suppressed_until_ms > {NOW}, false)"),
    "c15_recall_governance": (lambda r: recall.eligible(r.meta, r.now), f"state = 'confirmed' AND layer NOT IN ('archive', 'reflection') AND NOT coalesce(suppressed_until_ms > {NOW}, false)"),
    "i7_rerank_floor": (lambda r: r6(scoring.rerank_floor(r.score, (F.col("doc_id") % 4) * 0.25 + 0.1, F.col("doc_id") % 2 == 0)), f"round({_SCORE} * CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 4 WHEN 3 THEN 1 WHEN 2 THEN 0.95 ELSE 0.8 END ELSE CASE doc_id % 4 WHEN 3 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.5 END END, 6)"),
    "i8_recency_boost": (lambda r: r6(scoring.recency_boost(r.score, r.at, r.now)), _unit(f"{_SCORE} + 0.1 * exp(-{_AGE} / 14)")),
    "i9_importance_weight": (lambda r: r6(scoring.importance_weight(r.score, r.imp)), _unit(f"{_SCORE} * (0.7 + 0.3 * importance)")),
    "i10_length_norm": (lambda r: r6(scoring.length_norm(r.score, F.length(r.t), r.corpus)), _unit(f"{_SCORE} / (1 + 0.5 * log2(greatest(length(text) / 500.0::DOUBLE, 1)))")),
    "i11_time_decay": (lambda r: r6(scoring.time_decay(r.score, r.at, r.half_life, r.corpus, r.now)), _unit(f"{_SCORE} * (0.5 + 0.5 * exp(-{_AGE} / {_HALF}))")),
    "i12_decay_boost": (lambda r: r6(scoring.unit(r.score * scoring.search_boost(r.meta["tier"], r.total, r.recency))), _unit(f"{_SCORE} * least(1, 0.3 + 0.7 * greatest(CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END, {_TOTAL}, {_RECENCY}))")),
    "i13_effective_half_life": (lambda r: r6(r.half_life), f"round({_HALF}, 6)"),
    "i14_weibull_recency": (lambda r: r6(r.recency), f"round({_RECENCY}, 6)"),
    "i15_frequency": (lambda r: r6(r.frequent), f"round({_FREQ}, 6)"),
    "i16_intrinsic": (lambda r: r6(r.imp * r.meta["confidence"]), "round(importance * confidence, 6)"),
    "i18_tier_transition": (lambda r: scoring.next_tier(r.meta["tier"], r.meta["access_count"], r.total, r.imp, r.at, r.now), f"CASE WHEN tier = 'peripheral' AND access_count >= 3 AND {_TOTAL} >= 0.4 THEN 'working' WHEN tier = 'working' AND access_count >= 10 AND {_TOTAL} >= 0.7 AND importance >= 0.8 THEN 'core' WHEN tier = 'working' AND ({_TOTAL} < 0.15 OR ({_AGE} > 60 AND access_count < 3)) THEN 'peripheral' WHEN tier = 'core' AND {_TOTAL} < 0.15 AND access_count < 3 THEN 'working' END"),
    "i19_reflection_logistic": (lambda r: r6(scoring.logistic(scoring.days(r.now, r.at), F.lit(45.0), F.lit(0.25))), f"round(1 / (1 + exp(0.25 * (greatest(0, {_AGE}) - 45))), 6)"),
    "i20_reflection_score": (lambda r: r6(scoring.reflection_score(scoring.days(r.now, r.at), F.lit(21.0), F.lit(0.3), r.imp, r.meta["confidence"], F.col("doc_id") % 2 == 0)), f"round(1 / (1 + exp(0.3 * (greatest(0, {_AGE}) - 21))) * importance * confidence * CASE WHEN doc_id % 2 = 0 THEN 0.75 ELSE 1 END, 6)"),
    "i21_line_quality": (lambda r: r6(scoring.line_quality(F.col("doc_id") % 9)), "round(CASE WHEN doc_id % 9 = 0 THEN 0.2::DOUBLE ELSE least(1, 0.55 + least(6, doc_id % 9) * 0.075) END, 6)"),
    "i22_deep_score": (lambda r: r6(scoring.deep_score(r.imp, r.meta["confidence"], r.meta["access_count"], r.at, r.now)), f"round({_DEEP}, 6)"),
    "i61_scope_parse": (lambda r: F.concat_ws("|", capture.scope_parts(F.expr(_PARSED))["type"], capture.scope_parts(F.expr(_PARSED))["id"]), f"(SELECT CASE WHEN s = 'global' THEN 'global|' WHEN contains(s, ':') THEN split_part(s, ':', 1) || '|' || substr(s, strpos(s, ':') + 1) ELSE '' END FROM (SELECT {_PARSED} AS s) z)"),
    "g10_canonical_score": (lambda r: r6(scoring.canonical_score(r.imp, F.length(r.t), r.at)), "round(importance * 10 + least(2, length(text) / 400.0::DOUBLE) + timestamp / 1e13, 6)"),
}

#: Over the documents and the literal phrases.
TEXTS: dict[str, tuple[Callable[[Row], Column], str]] = {
    "c7_tag_tokens": (lambda r: F.array_join(rules.tag_tokens(r.t), "|"), r"array_to_string(regexp_extract_all(text, '(?i)\b(?:proj|env|team|scope):[\w-]+'), '|')"),
    "c8_noise": (lambda r: rules.is_noise(r.t), f"length(t) < 5 OR {_any(rules.DENIALS + rules.META_QUESTIONS + rules.FRUSTRATION + rules.BOILERPLATE + rules.DIAGNOSTICS)}"),
    "c9_frustration": (lambda r: rules.is_frustration(r.t), _any(rules.FRUSTRATION)),
    "c11_skip_retrieval": (lambda r: rules.skips_retrieval(r.t), _SKIP),
    "c36_error_signal": (lambda r: rules.has_error(r.t), _any(rules.ERRORS, "lower(text)")),
    "i31_lexical_hit": (lambda r: r6(scoring.lexical_hit(F.lit("the"), F.lower(text.trim(r.t)), 0.98)), "round(CASE WHEN contains(lower(t), 'the') THEN 0.78 * 0.98 ELSE 0 END, 6)::DOUBLE"),
    "i33_query_normalise": (lambda r: rules.plain_query(r.t), _QUERY),
    "i34_temporal_class": (lambda r: rules.temporal_class(r.t), f"CASE WHEN {_any(rules.DYNAMIC, 'text')} THEN 'dynamic' ELSE 'static' END"),
    "i35_expiry": (lambda r: rules.expiry(r.t, r.now), _EXPIRY),
    "i36_intent": (lambda r: rules.intent(r.t)["label"], _INTENT),
    "i38_first_sentence": (lambda r: rules.first_sentence(r.t), _SENTENCE),
    "i39_category_hint": (lambda r: rules.category_hint(r.t), _HINT),
    "i40_text_value": (lambda r: rules.text_value(r.t)["reason"], _VALUE),
    "i45_redacted": (lambda r: rules.redact(r.t), _REDACTED),
    "i46_error_signature": (lambda r: rules.error_signature(r.t), _SIGNATURE),
    "i48_safe_context": (lambda r: rules.safe_context(r.t), _SAFE),
    "i47_reason_key": (lambda r: rules.reason_key(r.t), rf"regexp_replace(regexp_replace(regexp_replace(lower(text), '\d+(?:\.\d+)?', '#', 'g'), '[\s\p{{Z}}\x{{FEFF}}\x0B]+', ' ', 'g'), {TRIM})"),
    "i49_inline_text": (lambda r: text.squeeze(r.t), rf"regexp_replace(regexp_replace(text, '[\s\p{{Z}}\x{{FEFF}}\x0B]+', ' ', 'g'), {TRIM})"),
    "i50_truncate": (lambda r: text.truncate(r.t, 200), "CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 199)) || '…' END"),
    "i28_tokens": (lambda r: F.size(F.array_distinct(rules.tokens(r.t))).cast("long"), r"len(list_distinct(regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')))"),
}


def _run(of: Callable[[SparkSession, str], DataFrame], value: Callable[[Row], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir)
    return rows.select("id", value(Row()).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(_run, memories.smart, value) for name, (value, _) in ROWS.items()}
    return out | {name: partial(_run, memories.phrases, value) for name, (value, _) in TEXTS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: f"WITH {SMART_SQL} SELECT id, {sql} AS value FROM smart" for name, (_, sql) in ROWS.items()}
    return out | {name: f"WITH {PHRASE_SQL} SELECT id, {sql} AS value FROM ph" for name, (_, sql) in TEXTS.items()}
