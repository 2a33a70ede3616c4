"""From verdicts on candidates to rows: what each becomes, and one patch for each row that they touch.

A verdict names a decision and, from 1 on, one of the candidate's similar rows. Candidates are in a
defined order, ``seq``; where several touch one row, their observations add up, and of replaced texts
and successors the last stands. Rows are changed by one join with one patch each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import capture, metadata, rules
from engramic.operators.tools import patched

# Decisions, those that name a row, those that need a valid number, and categories by what they allow.
DECISIONS = ["create", "merge", "skip", "support", "contextualize", "contradict", "supersede"]
NAMING = ["merge", "support", "contextualize", "contradict", "supersede"]
DESTRUCTIVE = ["supersede", "contradict"]
MERGED_ALWAYS, MERGEABLE = ["profile"], ["preferences", "entities", "patterns"]
IMPORTANCE = {"profile": 0.9, "preferences": 0.8, "entities": 0.7, "events": 0.6, "cases": 0.8, "patterns": 0.85}
MOST_CONTEXTS, MOST_RELATIONS = 8, 16
_SLICES = "array<struct<context:string,confirmations:bigint,contradictions:bigint,last_observed_at:bigint>>"
_RELATIONS = "array<struct<type:string,targetId:string>>"


def interpreted(verdict: Column, similar: Column) -> Column:
    """struct(decision, match_id, reason, context) of a verdict struct(decision, match_index, reason, context_label) on the ids ``similar``.

    A null verdict and unknown decisions create. Without a valid number the first similar row is
    meant, but a decision that ends or contradicts a row then creates.
    """
    decision = F.coalesce(F.lower(verdict["decision"]), F.lit("create"))
    index = verdict["match_index"].try_cast("double")
    valid = F.coalesce((index >= 1) & (index <= F.size(similar)) & (index == F.floor(index)), F.lit(False))
    unsafe = decision.isin(DESTRUCTIVE) & ~valid
    final = F.when(decision.isin(DECISIONS) & ~unsafe, decision).otherwise("create")
    match = F.try_element_at(similar, F.when(valid, index.cast("int")).otherwise(1))
    reason = (
        F.when(verdict.isNull(), "LLM response unparseable")
        .when(~decision.isin(DECISIONS), F.concat(F.lit("Unknown decision: "), verdict["decision"]))
        .when(unsafe, F.concat(decision, F.lit(" degraded: missing match_index")))
        .otherwise(F.coalesce(verdict["reason"], F.lit("")))
    )
    return F.struct(final.alias("decision"), F.when(final.isin(NAMING), match).alias("match_id"), reason.alias("reason"), F.when(final == decision, verdict["context_label"]).alias("context"))


def routed(candidates: DataFrame, judged: DataFrame, rows: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """candidates(cand_id, seq, category, ..) with match_id, context and action.

    judged(cand_id, verdict, similar) as for ``interpreted``; ``rejected(cand_id)`` names those that
    admission turned away. Actions: reject, merge, create, skip, supersede, support, contextualize, contradict
    and, for a support of a row that is gone, none. Profiles are always merged: with their scope's profile row
    of the first id, or created. ``rows`` need ``meta``.
    """
    told = candidates.join(judged, "cand_id", "left").withColumn("v", interpreted(F.col("verdict"), F.coalesce("similar", F.array().cast("array<string>"))))
    told = told.select(*[F.col(c) for c in candidates.columns], F.col("v.decision").alias("decision"), F.col("v.match_id").alias("named"), F.col("v.reason").alias("reason"), F.col("v.context").alias("context"))
    profiles = rows.where(F.col("meta.memory_category") == "profile").groupBy(F.coalesce("scope", F.lit("global")).alias("scope")).agg(F.min("id").alias("profile"))
    told = told.join(profiles, "scope", "left")
    always = F.col("category").isin(MERGED_ALWAYS)
    told = told.withColumn("match_id", F.when(always, F.col("profile")).otherwise(F.col("named"))).drop("profile", "named")
    known = rows.select(F.col("id").alias("match_id"), F.lit(True).alias("there"))
    told = told.join(known, "match_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    versioned = F.col("category").isin(metadata.VERSIONED)
    ends = (F.col("decision") == "supersede") | ((F.col("decision") == "contradict") & (capture.context(F.col("context")) == "general") & (F.col("context") == "general"))
    action = (
        F.when(always, F.when(F.col("there"), "merge").otherwise("create"))
        .when(F.col("decision").isin("create", "skip"), F.col("decision"))
        .when(F.col("match_id").isNull(), "create")
        .when(F.col("decision") == "merge", F.when(F.col("category").isin(MERGEABLE) & F.col("there"), "merge").otherwise("create"))
        .when(F.col("decision") == "support", F.when(F.col("there"), "support").otherwise("none"))
        .when(ends & versioned, F.when(F.col("there"), "supersede").otherwise("create"))
        .when(F.col("decision") == "supersede", "create")
        .otherwise(F.col("decision"))
    )
    if rejected is not None:
        away = rejected.select("cand_id", F.lit(True).alias("away")).distinct()
        told = told.join(away, "cand_id", "left").withColumn("action", F.when(F.col("away"), "reject").otherwise(action)).drop("away")
    else:
        told = told.withColumn("action", action)
    return told.drop("there", "decision")


def created(told: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """New rows (id, text, category, scope, importance, timestamp, metadata) of routed candidates; ``rows`` need ``meta``."""
    new = told.where(F.col("action").isin("create", "supersede", "contextualize", "contradict"))
    keys = rows.select(F.col("id").alias("match_id"), F.col("meta.fact_key").alias("old_key"))
    new = new.join(keys, "match_id", "left")
    ends, links = F.col("action") == "supersede", F.col("action").isin("contextualize", "contradict")
    about = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("abstract"))
    relation = F.when(ends, "supersedes").when(F.col("action") == "contextualize", "contextualizes").when(F.col("action") == "contradict", "contradicts")
    fields = [
        F.col("abstract").alias("l0_abstract"), F.col("overview").alias("l1_overview"), F.col("content").alias("l2_content"), F.col("category").alias("memory_category"),
        F.lit("working").alias("tier"), F.lit(0).alias("access_count"), F.lit(0.7).alias("confidence"), F.lit(now).alias("last_accessed_at"), F.col("session").alias("source_session"),
        F.lit("auto-capture").alias("source"), F.lit("confirmed").alias("state"), F.lit("working").alias("memory_layer"), F.lit(0).alias("injected_count"), F.lit(0).alias("bad_recall_count"), F.lit(0).alias("suppressed_until_turn"),
        F.when(~links, F.lit(now)).alias("valid_from"),
        F.when(ends, F.coalesce("old_key", metadata.fact_key(F.col("category"), F.col("abstract")))).when(~links, metadata.fact_key(F.col("category"), F.col("abstract"))).alias("fact_key"),
        F.when(ends, F.col("match_id")).alias("supersedes"),
        F.when(~links, rules.temporal_class(about)).alias("memory_temporal_type"), F.when(~links, rules.expiry(about, F.lit(now))).alias("valid_until"),
        F.when(links, F.when(F.col("context").isNotNull(), F.array("context")).otherwise(F.array().cast("array<string>"))).alias("contexts"),
        F.when(relation.isNotNull(), F.array(F.struct(relation.alias("type"), F.col("match_id").alias("targetId")))).alias("relations"),
    ]
    return new.select(
        F.concat(F.lit("mem:"), "cand_id").alias("id"), F.col("abstract").alias("text"), F.coalesce(metadata.lookup(F.col("category"), metadata.STORED_AS), F.lit("other")).alias("category"), "scope",
        F.coalesce(*[F.when(F.col("category") == c, F.lit(v)) for c, v in IMPORTANCE.items()], F.lit(0.5)).alias("importance"), F.lit(now).alias("timestamp"), F.to_json(F.struct(*fields)).alias("metadata"),
    )


def _observed(told: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """id, support: the support of rows after all confirmations and contradictions of a batch.

    Counts of a row and context add up before they move; the newest contexts stay (equal times by
    their names), and the evidence of the others counts in the totals.
    """
    seen = told.where(F.col("action").isin("support", "contradict")).select(F.col("match_id").alias("id"), capture.context(F.col("context")).alias("context"), (F.col("action") == "support").cast("long").alias("yes"))
    touched = seen.groupBy("id", "context").agg(F.sum("yes").alias("confirmations"), F.sum(1 - F.col("yes")).alias("contradictions"), F.lit(now).cast("long").alias("last_observed_at"))
    held = rows.join(seen.select("id").distinct(), "id", "left_semi").select("id", F.explode_outer(F.from_json(F.get_json_object(F.get_json_object("metadata", "$.support_info"), "$.slices"), _SLICES)).alias("s")).where("s IS NOT NULL").select("id", "s.*")
    every = held.unionByName(touched).groupBy("id", "context").agg(F.sum("confirmations").alias("confirmations"), F.sum("contradictions").alias("contradictions"), F.max("last_observed_at").alias("last_observed_at"))
    totals = every.groupBy("id").agg(F.sum("confirmations").alias("good"), F.sum(F.col("confirmations") + F.col("contradictions")).alias("all"))
    newest = Window.partitionBy("id").orderBy(F.desc("last_observed_at"), "context")
    kept = every.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= MOST_CONTEXTS)
    slices = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct("context", "confirmations", "contradictions", "last_observed_at").alias("s")))).alias("s"))
    strength = F.when(F.col("all") > 0, F.col("good") / F.col("all")).otherwise(0.5)
    return slices.join(totals, "id").select("id", F.struct(strength.alias("global_strength"), F.col("all").alias("total_observations"), F.transform("s", lambda x: x.s).alias("slices")).alias("support"))


def row_patches(told: DataFrame, merges: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """id, text, l0, l1, l2, successor, support: one row for each row that routed candidates change.

    merges(cand_id, abstract, overview, content) are the texts of merged rows; a merge without one changes nothing.
    """
    last = lambda c: F.max_by(c, F.struct("seq", "cand_id"))
    texts = told.where("action = 'merge'").select("cand_id", "seq", F.col("match_id").alias("id")).join(merges.select("cand_id", F.col("abstract").alias("l0"), F.col("overview").alias("l1"), F.col("content").alias("l2")), "cand_id")
    texts = texts.groupBy("id").agg(last(F.struct("l0", "l1", "l2")).alias("m")).select("id", "m.*")
    ended = told.where("action = 'supersede'").groupBy(F.col("match_id").alias("id")).agg(last(F.concat(F.lit("mem:"), "cand_id")).alias("successor"))
    return texts.join(ended, "id", "full_outer").join(_observed(told, rows, now), "id", "full_outer")


def applied(rows: DataFrame, told: DataFrame, merges: DataFrame, now: int) -> DataFrame:
    """``rows`` (with ``meta``) after a batch: changed ones by their patch, and the new ones; without ``meta``."""
    patches = row_patches(told, merges, rows, now)
    met = rows.join(patches, "id", "left")
    ends, hit = F.col("successor").isNotNull(), F.coalesce("l0", "successor", F.col("support.total_observations").cast("string")).isNotNull()
    changes = {
        "l0_abstract": F.col("l0"), "l1_overview": F.col("l1"), "l2_content": F.col("l2"),
        "invalidated_at": F.when(ends, F.lit(now)), "superseded_by": F.col("successor"), "fact_key": F.when(ends, F.col("meta.fact_key")),
        "support_info": F.to_json("support"),
        "relations": F.when(ends, F.to_json(_linked(F.from_json(F.get_json_object("metadata", "$.relations"), _RELATIONS), F.col("successor")))),
    }
    columns = [c for c in rows.columns if c != "meta"]
    changed = met.withColumn("metadata", F.when(hit, patched(F.col("metadata"), changes)).otherwise(F.col("metadata"))).withColumn("text", F.coalesce("l0", "text"))
    return changed.select(columns).unionByName(created(told, rows, now).select([c for c in columns if c in ("id", "text", "category", "scope", "importance", "timestamp", "metadata")]), allowMissingColumns=True)


def _linked(relations: Column, successor: Column) -> Column:
    new = F.struct(F.lit("superseded_by").alias("type"), successor.alias("targetId"))
    held = F.coalesce(relations, F.array().cast(_RELATIONS))
    return F.slice(F.when(F.array_contains(held, new), held).otherwise(F.concat(held, F.array(new))), 1, MOST_RELATIONS)


def batch_stats(told: DataFrame) -> DataFrame:
    """created, merged, skipped, superseded, supported, rejected of a routed batch."""
    counts = {"created": ["create", "supersede", "contextualize", "contradict"], "merged": ["merge"], "skipped": ["skip"], "superseded": ["supersede"], "supported": ["support"], "rejected": ["reject"]}
    return told.agg(*[F.count_if(F.col("action").isin(kinds)).alias(name) for name, kinds in counts.items()])
