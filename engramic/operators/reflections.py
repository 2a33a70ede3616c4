"""Reports of reflection as rows of the store: the event, one row for each line, and the older combined row; and rows that were mapped from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramic.functions import metadata, reflection
from engramic.functions.governance import event_id
from engramic.operators.tools import patched

# How lines of both kinds fade (days to the middle, steepness, weight, quality), and the combined row.
FADING = {"invariant": (45, 0.22, 1.1, 1.0), "derived": (7, 0.65, 1.0, 0.95)}
COMBINED_MIDDLE, COMBINED_STEEPNESS, FALLBACK_WEIGHT = 3, 1.2, 0.35
NOTHING = "(none captured)"
# Categories of rows by what a report's line was mapped as.
MAPPED_AS = {"user-model": "preferences", "agent-model": "patterns", "lesson": "cases", "decision": "cases"}


def payloads(reports: DataFrame, combined: bool = True) -> DataFrame:
    """event_id, kind, ordinal, text, metadata of reports(session_key, session_id, agent, command, scope, run_at, used_fallback, markdown).

    Kinds: event, item-invariant and item-derived (a row for each line, from 0), and combined-legacy where
    a report holds lines. A null report has an event alone. Rows come from their report by explode; nothing
    is shuffled.
    """
    slices = reflection.slices(F.coalesce("markdown", F.lit("")))
    told = reports.withColumn("event_id", event_id(F.col("run_at"), F.col("session_key"), F.col("session_id"), F.col("agent"), F.col("command"))).withColumn("s", slices)
    told = told.select("event_id", "session_key", "session_id", "agent", "command", "scope", "run_at", "used_fallback", F.col("s.invariants").alias("invariants"), F.col("s.derived").alias("derived"))
    by = [F.col("event_id").alias("eventId"), F.col("agent").alias("agentId"), F.col("session_key").alias("sessionKey"), F.col("session_id").alias("sessionId"), F.col("run_at").alias("storedAt"), F.col("used_fallback").alias("usedFallback")]
    day = F.date_format(F.to_utc_timestamp(F.timestamp_millis("run_at"), F.current_timezone()), "yyyy-MM-dd")
    moment = F.date_format(F.to_utc_timestamp(F.timestamp_millis("run_at"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def row(kind: str, text: Column, fields: list[Column], ordinal: Column | None = None) -> Column:
        at = F.lit(0) if ordinal is None else ordinal
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("ordinal"), text.alias("text"), F.to_json(F.struct(*fields)).alias("metadata"))

    def item(kind: str, heading: str, lines: Column) -> Column:
        days, steepness, weight, quality = FADING[kind]
        return F.transform(lines, lambda x, i: row(f"item-{kind}", x, [
            F.lit("memory-reflection-item").alias("type"), F.lit(4).alias("reflectionVersion"), F.lit("reflect-store").alias("stage"), *by, F.lit(kind).alias("itemKind"), F.lit(heading).alias("section"),
            i.alias("ordinal"), F.size(lines).alias("groupSize"), x.alias("l0_abstract"), F.concat(F.lit(f"## {heading}\n- "), x).alias("l1_overview"), x.alias("l2_content"),
            F.lit("logistic").alias("decayModel"), F.lit(days).alias("decayMidpointDays"), F.lit(steepness).alias("decayK"), F.lit(weight).alias("baseWeight"), F.lit(quality).alias("quality"),
        ], i))

    event_text = F.concat_ws("\n", F.concat(F.lit("reflection-event · "), "scope"), F.concat(F.lit("eventId="), "event_id"), F.concat(F.lit("session="), "session_id"), F.concat(F.lit("agent="), "agent"), F.concat(F.lit("command="), "command"), F.concat(F.lit("usedFallback="), F.col("used_fallback").cast("string")))
    event = row("event", event_text, [F.lit("memory-reflection-event").alias("type"), F.lit(4).alias("reflectionVersion"), F.lit("reflect-store").alias("stage"), *by, F.col("command")])
    bullets = lambda lines: F.array_join(F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(NOTHING))), lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("reflection · "), "scope", F.lit(" · "), day), F.concat(F.lit("Session Reflection ("), moment, F.lit(")")), F.concat(F.lit("Session Key: "), "session_key"), F.concat(F.lit("Session ID: "), "session_id"), F.lit(""), F.lit("Invariants:"), bullets(F.col("invariants")), F.lit(""), F.lit("Derived:"), bullets(F.col("derived")))
    both = row("combined-legacy", text, [
        F.lit("memory-reflection").alias("type"), F.lit(3).alias("reflectionVersion"), F.lit("reflect-store").alias("stage"), *by, F.col("command"), F.col("invariants"), F.col("derived"), F.lit("logistic").alias("decayModel"),
        F.lit(COMBINED_MIDDLE).alias("decayMidpointDays"), F.lit(COMBINED_STEEPNESS).alias("decayK"), F.when(F.col("used_fallback"), FALLBACK_WEIGHT).otherwise(1.0).alias("deriveBaseWeight"), F.when(F.col("used_fallback"), "fallback").otherwise("normal").alias("deriveSource"),
    ])
    last = F.when((F.size("invariants") > 0) | (F.size("derived") > 0), F.array(both)).otherwise(F.filter(F.array(both), lambda x: F.lit(False)))
    rows = F.concat(F.array(event), item("invariant", "Invariants", F.col("invariants")), item("derived", "Derived", F.col("derived")), *([last] if combined else []))
    return told.select("event_id", F.explode(rows).alias("p")).select("event_id", "p.*")


def restamped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with mapped ones in the category of their kind, stats: total_mapped, normalized, already_correct).

    Both the stamped category and the stored one must agree; other metadata stays as it is.
    """
    kind = F.get_json_object("metadata", "$.mappedKind")
    mapped = F.coalesce((F.get_json_object("metadata", "$.type") == "memory-reflection-mapped") & kind.isin(list(MAPPED_AS)), F.lit(False))
    due = metadata.lookup(kind, MAPPED_AS)
    stored = metadata.lookup(due, metadata.STORED_AS)
    right = F.coalesce((F.get_json_object("metadata", "$.memory_category") == due) & (F.col("category") == stored), F.lit(False))
    told = rows.withColumn("_mapped", mapped).withColumn("_right", right)
    stats = told.agg(F.count_if("_mapped").alias("total_mapped"), F.count_if(F.col("_mapped") & ~F.col("_right")).alias("normalized"), F.count_if(F.col("_mapped") & F.col("_right")).alias("already_correct"))
    changed = F.col("_mapped") & ~F.col("_right")
    after = told.withColumns({"category": F.when(changed, stored).otherwise(F.col("category")), "metadata": F.when(changed, patched(F.col("metadata"), {"memory_category": due})).otherwise(F.col("metadata"))})
    return after.select(rows.columns), stats


def admission_stats(rows: DataFrame, rejections: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """One row: rejected, admitted, total, reject_rate, latest_rejected_at, observed, last_admitted_at.

    ``rows`` hold the audit of their admission in ``admission_control``; rejections(rejected_at, target_scope)
    are the audit's own. Both are counted side by side, each in one aggregate.
    """
    inside = lambda c: F.lit(True) if not scopes else F.col(c).isin(scopes)
    audit = F.from_json(F.get_json_object("metadata", "$.admission_control"), "struct<decision: string, evaluated_at: double>")
    seen = rows.where(inside("scope")).select(audit.alias("a"), "timestamp").where(F.col("a.decision").isin("pass_to_dedup", "reject"))
    passed = F.col("a.decision") == "pass_to_dedup"
    at = F.when(F.col("a.evaluated_at") > 0, F.col("a.evaluated_at").cast("long")).otherwise(F.when(F.col("timestamp") > 0, F.col("timestamp")))
    admitted = seen.agg(F.count_if(passed).alias("admitted"), F.count(F.lit(1)).alias("observed"), F.max(F.when(passed, at)).alias("last_admitted_at"))
    rejected = rejections.where(inside("target_scope")).agg(F.count(F.lit(1)).alias("rejected"), F.max("rejected_at").alias("latest_rejected_at"))
    total = F.col("admitted") + F.col("rejected")
    return rejected.crossJoin(admitted).select("rejected", "admitted", total.alias("total"), F.when(total > 0, F.round(F.col("rejected") / total, 6)).alias("reject_rate"), "latest_rejected_at", "observed", "last_admitted_at")  # one row beside one row
