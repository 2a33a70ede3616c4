"""Row normalisers: time stamps, importance, categories and the typed view of a row's JSON metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramic.functions.text import java, squeeze, trim

# Categories, their old names and how they map.
CATEGORIES = ["profile", "preferences", "entities", "events", "cases", "patterns"]
OLD_CATEGORIES = ["preference", "fact", "decision", "entity", "reflection", "other"]
STORED_AS = {"profile": "fact", "preferences": "preference", "entities": "entity", "events": "decision", "cases": "fact", "patterns": "other"}
READ_AS = {"preference": "preferences", "fact": "cases", "decision": "events", "entity": "entities", "reflection": "patterns", "other": "patterns"}
SINGULAR = {"preference": "preferences", "entity": "entities", "event": "events", "case": "cases", "pattern": "patterns"}
VERSIONED = ["preferences", "entities"]
PERSONAL = r"(?i)\b(my |i am |i'm |name is |叫我|我的|我是)\b"
SECONDS_BELOW = 1_000_000_000_000

#: Fields of the metadata; all are read as text, then cast, so that "5" and 5 are one.
FIELDS = [
    "l0_abstract", "l1_overview", "l2_content", "memory_category", "tier", "access_count", "confidence", "last_accessed_at",
    "valid_from", "invalidated_at", "valid_until", "memory_temporal_type", "fact_key", "supersedes", "superseded_by", "source_session",
    "state", "source", "memory_layer", "injected_count", "last_injected_at", "last_confirmed_use_at", "bad_recall_count",
    "suppressed_until_turn", "suppressed_until_ms", "canonical_id", "type", "accessCount", "lastAccessedAt",
]


def lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def number(text: Column) -> Column:
    """A finite double or null."""
    n = text.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)  # NaN is above all


def timestamp_ms(value: Column, fallback: Column) -> Column:
    """Whole milliseconds; seconds of old rows times 1000; the fallback where not positive."""
    n = number(value.cast("string"))
    whole = F.floor(n)
    return F.when(n > 0, F.when(whole < SECONDS_BELOW, whole * 1000).otherwise(whole)).otherwise(fallback).cast("long")


def importance(value: Column) -> Column:
    n = number(value.cast("string"))
    return F.when(n.isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def legacy_importance(value: Column) -> Column:
    """The old scale of 1 to 5, else as `importance`."""
    out = importance(value)
    for step, new in [(1, 0.2), (2, 0.4), (3, 0.6), (4, 0.8), (5, 0.95)]:
        out = F.when(value == step, F.lit(new)).otherwise(out)
    return out


def clamp_unit(text: Column, fallback: float) -> Column:
    n = number(text)  # greatest and least pass over nulls
    return F.when(n.isNull(), fallback).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)))


def whole(text: Column) -> Column:
    """A finite number of at most 18 digits, rounded down, or null; one cast, so that filters on it stay small."""
    return F.floor(text.try_cast("decimal(24,6)")).cast("long")


def count(text: Column, fallback: Column | int = 0) -> Column:
    n = whole(text)
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(n >= 0, n).otherwise(other).cast("long")


def instant(text: Column) -> Column:
    """Whole milliseconds or null."""
    n = whole(text)
    return F.when(n > 0, n)


def optional(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def one_of(text: Column, known: list[str], fallback: Column | str) -> Column:
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(text.isin(known), text).otherwise(other)


def category(label: Column) -> Column:
    """One of the six categories or null."""
    lower = trim(F.lower(label))
    named = F.coalesce(lookup(lower, SINGULAR), lower)
    return F.when(named.isin(CATEGORIES), named)


def tool_category(label: Column) -> Column:
    """struct(memory_category, storage_category) of any label."""
    raw, known = trim(F.lower(label)), category(label)
    return F.struct(
        F.coalesce(known, lookup(raw, READ_AS), F.lit("patterns")).alias("memory_category"),
        F.coalesce(lookup(known, STORED_AS), F.when(raw.isin(OLD_CATEGORIES), raw), F.lit("other")).alias("storage_category"),
    )


def category_candidates(requested: str) -> list[str]:
    """Values of the stored column that may hold a requested category, to be pushed to the scan."""
    raw = requested.lower().strip()
    known = SINGULAR.get(raw, raw)
    found = [raw]
    if known in CATEGORIES:
        found += [known, STORED_AS[known], *(c for c in CATEGORIES + OLD_CATEGORIES if SINGULAR.get(c, c) == known)]
    return list(dict.fromkeys(found))


def category_from_legacy(old: Column, text: Column, row_type: Column) -> Column:
    personal = text.rlike(java(PERSONAL)) & (F.length(text) < 200)
    fact = F.when(personal, F.lit("profile")).otherwise(F.lit("cases"))
    mapped = F.coalesce(row_type == "memory-reflection-mapped", F.lit(False))
    return (
        F.when(old.isin(CATEGORIES), old)
        .when(old == "preference", F.lit("preferences"))
        .when(old == "entity", F.lit("entities"))
        .when((old == "fact") | ((old == "decision") & mapped), fact)
        .when(old == "decision", F.lit("events"))
        .otherwise(F.lit("patterns"))
    )


def category_matches(old: Column, stamped: Column, requested: str) -> Column:
    """Whether a row is of a requested category, by its stored label or its metadata."""
    raw = trim(F.lower(old))
    known = SINGULAR.get(requested.lower().strip(), requested.lower().strip())
    same = raw == requested.lower().strip()
    if known not in CATEGORIES:
        return F.coalesce(same, F.lit(False))
    return F.coalesce(same | (F.coalesce(category(stamped), category(old), lookup(raw, READ_AS)) == known), F.lit(False))


def default_layer(source: Column, memory_category: Column, state: Column, row_type: Column) -> Column:
    mapped = F.coalesce(row_type == "memory-reflection-mapped", F.lit(False))
    return (
        F.when(~mapped & source.isin("reflection", "dreaming-engine", "session-summary"), F.lit("reflection"))
        .when(state == "archived", F.lit("archive"))
        .when(memory_category.isin("profile", "preferences", "events"), F.lit("durable"))
        .otherwise(F.lit("working"))
    )


def fact_key(memory_category: Column, abstract: Column) -> Column:
    """`category:topic` of a versioned category: what stands before a colon or an arrow, else the whole."""

    def plain(t: Column) -> Column:
        topic = F.coalesce(optional(F.regexp_extract(t, "^(.{1,120}?)[：:]", 1)), optional(F.regexp_extract(t, r"^(.{1,120}?)(?:\s*->|\s*=>)", 1)), t)
        return trim(F.regexp_replace(F.regexp_replace(F.lower(topic), r"\s+", " "), r"[。.!?]+$", ""))

    # bound once, since each step names its input more than once
    key = F.transform(F.transform(F.array(trim(abstract)), plain), lambda k: F.when(k != "", F.concat(memory_category, F.lit(":"), k)))
    return F.when(memory_category.isin(VERSIONED), key[0])


def with_smart_metadata(rows: DataFrame) -> DataFrame:
    """Adds `meta`, the typed metadata with every default filled in; malformed JSON gives defaults alone.

    Rows need text, category, timestamp and metadata. The JSON is parsed once a row.
    """
    raw = F.from_json("metadata", "struct<" + ",".join(f"`{f}`:string" for f in FIELDS) + ">")
    rows = rows.withColumn("_raw", F.coalesce(raw, F.struct(*[F.lit(None).cast("string").alias(f) for f in FIELDS])))
    r = {f: F.col(f"_raw.{f}") for f in FIELDS}
    text, at = F.coalesce("text", F.lit("")), F.col("timestamp")
    l0 = F.coalesce(optional(r["l0_abstract"]), text)
    legacy = category_from_legacy(F.col("category"), text, r["type"])
    named = F.coalesce(r["memory_category"], legacy)
    reflected = r["type"].isin("memory-reflection", "memory-reflection-item", "memory-reflection-mapped")
    implied = F.when(r["type"] == "session-summary", F.lit("session-summary")).when(reflected, F.lit("reflection")).otherwise(F.lit("legacy"))
    source = one_of(F.coalesce(r["source"], implied), ["manual", "auto-capture", "reflection", "dreaming-engine", "session-summary"], "legacy")
    usual = F.when(source == "session-summary", F.lit("archived")).otherwise(F.lit("confirmed"))
    state = one_of(F.coalesce(r["state"], usual), ["pending", "confirmed", "archived"], "confirmed")
    layer = F.coalesce(r["memory_layer"], default_layer(source, F.coalesce(category(r["memory_category"]), legacy), state, r["type"]))
    since, ended = F.coalesce(instant(r["valid_from"]), at), instant(r["invalidated_at"])
    meta = F.struct(
        l0.alias("l0"),
        F.coalesce(optional(r["l1_overview"]), F.concat(F.lit("- "), l0)).alias("l1"),
        F.coalesce(optional(r["l2_content"]), text).alias("l2"),
        named.alias("memory_category"),
        one_of(r["tier"], ["core", "working", "peripheral"], "working").alias("tier"),
        count(r["access_count"]).alias("access_count"),
        clamp_unit(r["confidence"], 0.7).alias("confidence"),
        count(r["last_accessed_at"], at).alias("last_accessed_at"),
        since.alias("valid_from"),
        F.when(ended >= since, ended).alias("invalidated_at"),
        instant(r["valid_until"]).alias("valid_until"),
        F.when(r["memory_temporal_type"].isin("static", "dynamic"), r["memory_temporal_type"]).alias("temporal_type"),
        F.coalesce(optional(r["fact_key"]), fact_key(named, l0)).alias("fact_key"),
        optional(r["supersedes"]).alias("supersedes"),
        optional(r["superseded_by"]).alias("superseded_by"),
        r["source_session"].alias("source_session"),
        state.alias("state"),
        source.alias("source"),
        one_of(layer, ["durable", "working", "reflection", "archive"], "working").alias("layer"),
        count(r["injected_count"]).alias("injected_count"),
        instant(r["last_injected_at"]).alias("last_injected_at"),
        instant(r["last_confirmed_use_at"]).alias("last_confirmed_use_at"),
        count(r["bad_recall_count"]).alias("bad_recall_count"),
        count(r["suppressed_until_turn"]).alias("suppressed_until_turn"),
        F.when(r["suppressed_until_ms"].isNotNull(), count(r["suppressed_until_ms"])).alias("suppressed_until_ms"),
        optional(r["canonical_id"]).alias("canonical_id"),
        r["type"].alias("row_type"),
        r["memory_category"].alias("stamped_category"),
        F.least(F.lit(10000), count(F.coalesce(r["accessCount"], r["access_count"]))).alias("reinforced"),
        count(F.coalesce(r["lastAccessedAt"], r["last_accessed_at"])).alias("reinforced_at"),
    )
    return rows.withColumn("meta", meta).drop("_raw")


def in_force(meta: Column, at: Column) -> Column:
    """Begun and not ended at a time."""
    return (meta["valid_from"] <= at) & F.coalesce(meta["invalidated_at"] > at, F.lit(True))


def expired(meta: Column, at: Column) -> Column:
    return F.coalesce(meta["valid_until"] <= at, F.lit(False))


def before(at: Column, cutoff_ms: int) -> Column:
    """Whether a stored time, in milliseconds or in the seconds of old rows, lies before a cutoff; never for cutoffs that are no time."""
    if cutoff_ms <= 0:
        return F.lit(False)
    seconds = (at > 0) & (at < SECONDS_BELOW) & (at < -(-cutoff_ms // 1000))
    return F.coalesce(((at >= SECONDS_BELOW) & (at < cutoff_ms)) | seconds, F.lit(False))


def active_at(at: Column) -> Column:
    """Of rows with `meta`: begun, not ended and not expired at a time."""
    begun = F.col("meta.valid_from") <= at
    return begun & F.coalesce(F.col("meta.invalidated_at") > at, F.lit(True)) & F.coalesce(F.col("meta.valid_until") > at, F.lit(True))


#: Fields of the metadata by their names in ``meta``.
TYPED = {
    "l0_abstract": "l0", "l1_overview": "l1", "l2_content": "l2", "memory_category": "memory_category", "tier": "tier", "access_count": "access_count", "confidence": "confidence",
    "last_accessed_at": "last_accessed_at", "valid_from": "valid_from", "invalidated_at": "invalidated_at", "valid_until": "valid_until", "memory_temporal_type": "temporal_type", "fact_key": "fact_key",
    "supersedes": "supersedes", "superseded_by": "superseded_by", "source_session": "source_session", "source": "source", "state": "state", "memory_layer": "layer", "injected_count": "injected_count",
    "last_injected_at": "last_injected_at", "last_confirmed_use_at": "last_confirmed_use_at", "bad_recall_count": "bad_recall_count", "suppressed_until_turn": "suppressed_until_turn",
    "suppressed_until_ms": "suppressed_until_ms", "canonical_id": "canonical_id",
}


def built(raw: Column, meta: Column, patch: dict[str, Column], at: Column) -> Column:
    """JSON metadata with every typed field written out: those of ``meta``, and of ``patch`` where it holds a usable value.

    A null in the patch leaves a field. Other keys of the raw metadata and of the patch stay as they
    are. An end before the begin is dropped; 0 ends a suppression. Values are kept as text.
    """
    given = lambda f: patch[f].cast("string") if f in patch else F.lit(None).cast("string")
    base = {f: meta[m] for f, m in TYPED.items()}
    either = lambda f, usable: F.when(given(f).isNull(), base[f]).otherwise(usable)
    n = {f: number(given(f)) for f in ("confidence", "suppressed_until_ms")}
    new = {f: F.coalesce(optional(given(f)), base[f]) for f in ("l0_abstract", "l1_overview", "l2_content")}
    new |= {f: F.coalesce(given(f), base[f]) for f in ("memory_category", "source_session")}
    new |= {f: count(given(f), base[f]) for f in ("access_count", "injected_count", "bad_recall_count", "suppressed_until_turn")}
    new |= {f: either(f, instant(given(f))) for f in ("valid_until", "last_injected_at", "last_confirmed_use_at")}
    new |= {f: either(f, optional(given(f))) for f in ("supersedes", "superseded_by", "canonical_id")}
    new["tier"] = one_of(F.coalesce(given("tier"), base["tier"]), ["core", "working", "peripheral"], "working")
    new["confidence"] = F.when(n["confidence"].isNull(), base["confidence"]).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n["confidence"])))
    new["last_accessed_at"] = count(given("last_accessed_at"), F.coalesce(F.nullif(base["last_accessed_at"], F.lit(0)), at))
    new["valid_from"] = F.coalesce(instant(given("valid_from")), base["valid_from"])
    ended = either("invalidated_at", instant(given("invalidated_at")))
    new["invalidated_at"] = F.when(ended >= new["valid_from"], ended)
    new["memory_temporal_type"] = either("memory_temporal_type", F.when(given("memory_temporal_type").isin("static", "dynamic"), given("memory_temporal_type")))
    new["fact_key"] = F.coalesce(optional(given("fact_key")), base["fact_key"], fact_key(new["memory_category"], new["l0_abstract"]))
    new["source"] = either("source", one_of(given("source"), ["manual", "auto-capture", "reflection", "dreaming-engine", "session-summary"], "legacy"))
    new["state"] = either("state", one_of(given("state"), ["pending", "confirmed", "archived"], "confirmed"))
    new["memory_layer"] = either("memory_layer", one_of(given("memory_layer"), ["durable", "working", "reflection", "archive"], "working"))
    new["suppressed_until_ms"] = either("suppressed_until_ms", F.when(n["suppressed_until_ms"] >= 0, F.floor(n["suppressed_until_ms"])).otherwise(0))
    new |= {f: given(f) for f in patch if f not in TYPED}
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), v.cast("string").alias("value")) for f, v in new.items()])
    old = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin([*TYPED, *patch]))
    told = F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull()))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, told)))))


def support_info(raw: Column, now: Column) -> Column:
    """struct(global_strength, total_observations, slices) of the JSON of a row's support, in its old flat form or by contexts; null and other JSON give no evidence."""
    one = "struct<context:string,confirmations:double,contradictions:double,strength:double,last_observed_at:double>"
    by_context = F.from_json(raw, f"struct<global_strength:double,total_observations:double,slices:array<{one}>>")
    flat = F.from_json(raw, "struct<confirmations:double,contradictions:double>")

    def entry(context: Column, yes: Column, no: Column, strength: Column, at: Column) -> Column:
        return F.struct(context.alias("context"), yes.cast("long").alias("confirmations"), no.cast("long").alias("contradictions"), strength.alias("strength"), at.cast("long").alias("last_observed_at"))

    def known(s: Column) -> Column:
        positive = lambda x: F.when(x >= 0, x).otherwise(0)
        return entry(s.context, positive(s.confirmations), positive(s.contradictions), F.when(s.strength.between(0, 1), s.strength).otherwise(0.5), F.coalesce(s.last_observed_at, now))

    listed = F.struct(F.coalesce(by_context["global_strength"], F.lit(0.5)).alias("global_strength"), F.coalesce(by_context["total_observations"], F.lit(0)).cast("long").alias("total_observations"), F.transform(F.filter(by_context["slices"], lambda s: s.context.isNotNull()), known).alias("slices"))
    yes, no = F.coalesce(flat["confirmations"], F.lit(0.0)), F.coalesce(flat["contradictions"], F.lit(0.0))
    single = F.struct((yes / F.nullif(yes + no, F.lit(0.0))).alias("global_strength"), (yes + no).cast("long").alias("total_observations"), F.array(entry(F.lit("general"), yes, no, yes / F.nullif(yes + no, F.lit(0.0)), now)).alias("slices"))
    none = F.struct(F.lit(0.5).alias("global_strength"), F.lit(0).cast("long").alias("total_observations"), F.filter(F.array(entry(F.lit(""), yes, no, F.lit(0.5), now)), lambda s: F.lit(False)).alias("slices"))
    return F.when(by_context["slices"].isNotNull(), listed).when(yes + no > 0, single).otherwise(none)


def number_vector(values: Column) -> Column:
    """An array of strings or numbers as doubles; empty if null or if one of them is no finite number."""
    read = F.transform(values, lambda x: number(x.cast("string")))
    return F.when(values.isNull() | F.exists(read, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(read)
