"""Rules on rows and their metadata: whose, of what source, whether a fact, whether complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramic.functions.capture import owned_by
from engramic.functions.text import trim

# Named groups of sources, and types of reflection rows.
SOURCE_NAMES = {"daily": ["manual", "auto-capture", "legacy"], "sessions": ["session-summary"], "recall": ["manual", "auto-capture", "legacy"], "logs": ["auto-capture"], "memory": ["manual", "auto-capture", "legacy"]}
REFLECTION_TYPES = ["memory-reflection", "memory-reflection-event", "memory-reflection-item"]
TEMPORAL_FIELDS = ["supersedes", "superseded_by", "invalidated_at", "valid_until"]
#: Entries of a metadata array that stay.
SOURCES, HISTORY, RELATIONS = 20, 50, 16


def from_sources(meta: Column, category: Column, sources: list[str]) -> Column:
    """Whether a row is of one of the named sources, categories or layers; of any without names."""
    out = F.lit(not sources)
    for s in sources:
        out = out | (meta["source"].isin(SOURCE_NAMES[s]) if s in SOURCE_NAMES else F.coalesce(F.lit(s).isin(meta["source"], category, meta["memory_category"], meta["layer"]), F.lit(False)))
    return out


def active_user(meta: Column, at: Column) -> Column:
    ended = F.coalesce(meta["invalidated_at"] <= at, F.lit(False))
    return (meta["state"] != "archived") & (meta["layer"] != "archive") & ~ended & (meta["source"] != "dreaming-engine")


def owned(raw: Column, agent: str) -> Column:
    """From the metadata's JSON; a null kind is present, and not text."""
    kind = F.try_variant_get(F.try_parse_json(raw), "$.itemKind", "variant")
    present = F.coalesce(F.array_contains(F.json_object_keys(raw), "itemKind"), F.lit(False))
    return owned_by(F.get_json_object(raw, "$.agentId"), F.when(present, F.lit("present")), F.coalesce(F.schema_of_variant(kind) == "STRING", F.lit(False)), agent)


def is_reflection(category: Column, row_type: Column) -> Column:
    return F.coalesce(category == "reflection", F.lit(False)) | F.coalesce(row_type.isin(REFLECTION_TYPES), F.lit(False))


def unresolved(row_type: Column, raw: Column) -> Column:
    resolved = F.coalesce(F.array_contains(F.json_object_keys(raw), "resolvedAt"), F.lit(False))
    return F.coalesce(row_type == "memory-reflection-item", F.lit(False)) & ~resolved


def temporal_fact(raw: Column) -> Column:
    keys = F.coalesce(F.arrays_overlap(F.json_object_keys(raw), F.array(*map(F.lit, TEMPORAL_FIELDS))), F.lit(False))
    return keys | F.coalesce(F.get_json_object(raw, "$.memory_temporal_type") == "dynamic", F.lit(False))


def fact_matches(meta: Column, text: Column, query: str | None, fact_key: str | None) -> Column:
    """Equal keys but for case, and the words of the query in one of the row's fields."""
    out, q = F.lit(True), (query or "").strip().lower()
    if (fact_key or "").strip():
        out = F.coalesce(trim(F.lower(meta["fact_key"])) == fact_key.strip().lower(), F.lit(False))
    if q:
        found = F.lit(False)
        for field in (meta["fact_key"], meta["memory_category"], meta["l0"], meta["l1"], text):
            found = found | F.coalesce(F.contains(F.lower(field), F.lit(q)), F.lit(False))
        out = out & found
    return out


def is_legacy(category: Column, meta: Column) -> Column:
    """Neither a reflection nor stamped with a category."""
    kind = F.coalesce(meta["row_type"], F.lit(""))
    return (category != "reflection") & ~kind.isin([*REFLECTION_TYPES, "memory-reflection-mapped"]) & (F.coalesce(meta["stamped_category"], F.lit("")) == "")


def level_fault(raw: Column) -> Column:
    """Why a row's three summary levels need to be made again, or null."""
    l0, l1, l2 = (F.coalesce(trim(F.get_json_object(raw, f"$.{f}")), F.lit("")) for f in ("l0_abstract", "l1_overview", "l2_content"))
    return F.when((l0 == "") | (l1 == "") | (l2 == ""), "missing summary level(s)").when((l0 == l1) & (l1 == l2), "degenerate identical levels")


def simple_levels(text: Column) -> Column:
    """struct(l0, l1, l2): the first sentence, it as a bullet, and the text."""
    first = F.regexp_extract(text, r"^[^.!?。！？\n]+[.!?。！？]?", 0)
    l0 = trim(F.substring(F.when(first != "", first).otherwise(text), 1, 100))
    return F.struct(l0.alias("l0"), F.concat(F.lit("- "), l0).alias("l1"), text.alias("l2"))


def capped(sources: Column, history: Column, relations: Column) -> Column:
    """JSON with the newest sources and versions and the first relations."""
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))
    return F.to_json(F.struct(last(sources, SOURCES).alias("sources"), last(history, HISTORY).alias("history"), F.slice(relations, 1, RELATIONS).alias("relations")))


def related(relations: Column, kind: Column, target: Column) -> Column:
    """The relations with one more, unless it is among them."""
    return F.when(F.exists(relations, lambda r: (r.type == kind) & (r.target_id == target)), relations).otherwise(F.concat(relations, F.array(F.struct(kind.alias("type"), target.alias("target_id")))))


def event_id(at: Column, session_key: Column, session: Column, agent: Column, command: Column) -> Column:
    """Readable time and eight digits of a digest."""
    digest = F.sha1(F.concat_ws("|", at.cast("string"), session_key, session, agent, command))
    return F.concat(F.lit("refl-"), F.date_format(F.to_utc_timestamp(F.timestamp_millis(at), F.current_timezone()), "yyyyMMddHHmmss"), F.lit("-"), F.substring(digest, 1, 8))


def corpus_rows(chunks: DataFrame) -> DataFrame:
    """Store rows of chunks(agent, source, path, text): id by place, scope by agent, importance by source."""
    key = F.concat_ws("\x1f", "agent", "source", "path")
    scope = F.when(F.col("agent") == "main", F.lit("global")).otherwise(F.concat(F.lit("agent:"), "agent"))
    return chunks.select(
        F.concat(F.lit("corpus:"), F.substring(F.sha2(key, 256), 1, 48)).alias("id"), scope.alias("scope"),
        F.when(F.col("source") == "memory", 0.7).otherwise(0.45).alias("importance"), F.sha2("text", 256).alias("content"),
    )
