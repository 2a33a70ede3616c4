"""Statistics, rankings, version chains and selections over memory rows, turns and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import metadata, rules, scoring
from engramic.functions.text import any_of, trim
from engramic.operators.ordered import running_sum


def scope_category_counts(rows: DataFrame) -> DataFrame:
    """kind, key, rows: counts by scope (none: global), by category and in all, in one pass.

    An empty table has no rows, not a total of 0.
    """
    keyed = rows.select(F.coalesce("scope", F.lit("global")).alias("scope"), "category")
    sets = keyed.groupingSets([["scope"], ["category"], []], "scope", "category").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("rows"))
    kind = F.when(F.col("g") == 1, "scope").when(F.col("g") == 2, "category").otherwise("all")
    return sets.select(kind.alias("kind"), F.coalesce("scope", "category", F.lit("")).alias("key"), "rows")


#: A sketch of ranks is off by one in ACCURACY rows at most; values within MARGIN of the rank are then ranked themselves.
ACCURACY, MARGIN = 10_000, 0.0005


def latency_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean and nearest-rank p95 of a group; no task meets all values of a group.

    A sketch of ranks tells between which two values the rank lies, however the values are spread;
    only those between, about one row in a thousand, are ranked. Should the sketch miss, which the
    counts on both sides show, all values of that group are.
    """
    own = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    near = F.percentile_approx("v", [0.95 - MARGIN, 0.95 + MARGIN], ACCURACY)
    totals = own.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), near.alias("near"))
    totals = totals.select(by, "n", "mean", F.ceil(F.col("n") * 0.95).alias("target"), F.col("near")[0].alias("lo"), F.col("near")[1].alias("hi"))
    placed = own.join(totals.select(by, "target", "lo", "hi"), by)
    sides = placed.groupBy(by, "target", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") <= F.col("hi")).alias("upto"))
    held = (F.col("below") < F.col("target")) & (F.col("target") <= F.col("upto"))
    bounds = sides.select(by, F.when(held, F.col("below")).otherwise(0).alias("before"), held.alias("held"))
    inside = placed.join(bounds, by).where(~F.col("held") | F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(by, "v", "before", "target").agg(F.count(F.lit(1)).alias("c"))
    ranked = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by).orderBy("v")))
    p95 = ranked.where("upto >= target").groupBy(by).agg(F.min("v").alias("p95"))
    return totals.join(p95, by).select(by, "n", "mean", "p95")


def rejection_reasons(rejections: DataFrame, k: int = 5) -> DataFrame:
    """reason_key, label, rejections of the k commonest reasons; numbers are masked, the first label stands."""
    keyed = rejections.select(rules.reason_key(F.col("reason")).alias("reason_key"), "reason", "seq")
    counted = keyed.groupBy("reason_key").agg(F.min_by("reason", "seq").alias("label"), F.count(F.lit(1)).alias("rejections"))
    return counted.orderBy(F.desc("rejections"), "label").limit(k)


def window_counts(admitted: DataFrame, rejected: DataFrame, now: int, windows: dict[str, int]) -> DataFrame:
    """window, admitted, rejected, reject_rate of each trailing window."""
    both = admitted.select("at", F.lit(1).alias("a")).unionByName(rejected.select("at", F.lit(0).alias("a")))
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(ms).alias("ms")) for n, ms in windows.items()])
    inside = both.select("at", "a", F.explode(spans).alias("s")).where(F.col("at") >= F.lit(now) - F.col("s.ms"))
    counted = inside.groupBy(F.col("s.window").alias("window")).agg(F.sum("a").alias("admitted"), F.sum(1 - F.col("a")).alias("rejected"))
    return counted.withColumn("reject_rate", F.round(F.col("rejected") / (F.col("admitted") + F.col("rejected")), 6))


def ranked_lines(lines: DataFrame, now: Column, k: int = 10) -> DataFrame:
    """kind, line, score, rank from (kind, line, timestamp, midpoint, k, weight, quality, fallback).

    Lines that differ in case and spaces alone count as one; the newest spelling stands.
    """
    age = scoring.days(now, F.col("timestamp"))
    score = scoring.reflection_score(age, F.col("midpoint"), F.col("k"), F.col("weight"), F.col("quality"), F.col("fallback"))
    keyed = lines.withColumn("key", rules.squeeze(F.lower("line"))).where(F.col("key") != "")
    summed = keyed.withColumn("s", score).groupBy("kind", "key").agg(F.round(F.sum("s"), 6).alias("score"), F.max(F.struct("timestamp", "line")).alias("newest"))
    best = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("newest.timestamp"), "newest.line")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("kind", F.col("newest.line").alias("line"), "score", "rank")


def patterns(rows: DataFrame, strength: float, k: int = 6) -> DataFrame:
    """kind, key, rows, strength: categories and words that at least a share of the rows (at least two) have; rows need ``meta``."""
    n = rows.count()

    def counted(kind: str, keys: DataFrame) -> DataFrame:
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "key", "rows")

    words = F.array_distinct(rules.pattern_words(F.concat("meta.l0", F.lit(" "), "text")))
    found = counted("category", rows.select(F.col("category").alias("key")).where("key IS NOT NULL"))
    found = found.unionByName(counted("memory_category", rows.select(F.col("meta.memory_category").alias("key")).where("key IS NOT NULL")))
    found = found.unionByName(counted("term", rows.select(F.explode(words).alias("key"))))
    strong = found.withColumn("strength", F.round(F.col("rows") / max(1, n), 6)).where((F.col("rows") >= 2) & (F.col("strength") >= strength))
    order = F.when(F.col("kind") == "category", 0).when(F.col("kind") == "memory_category", 1).otherwise(2)
    return strong.orderBy(order, F.desc("rows"), "key").limit(k)


def conversation_value(turns: DataFrame) -> DataFrame:
    """conv_id, value (0 to 1): how much a conversation is worth extracting from.

    Patterns are looked for in each turn and over the seam to the next one: the last line of the one,
    a blank, and the first line of the other. Those for the beginning of a text count in the first turn
    alone. A pattern over more than two turns is not found. Whole texts never leave their rows.
    """
    t = F.coalesce("text", F.lit(""))
    placed = running_sum(turns.select("conv_id", "turn", t.alias("text")), "conv_id", "turn", F.lit(1), "pos")
    heads = placed.select("conv_id", (F.col("pos") - 1).alias("pos"), F.substring_index("text", "\n", 1).alias("head"))
    placed = placed.join(heads, ["conv_id", "pos"], "left").withColumn("seam", F.coalesce(F.concat(F.substring_index("text", "\n", -1), F.lit(" "), "head"), F.lit("")))
    t = F.col("text")
    starts = F.when(~F.contains(t, F.lit("\n")) & (F.col("seam") != ""), F.col("seam")).otherwise(t)

    def found(patterns: list[str]) -> Column:
        anywhere = [p for p in patterns if not p.startswith("^")]
        first = [p for p in patterns if p.startswith("^")]
        out = F.max((any_of(t, anywhere) | any_of(F.col("seam"), anywhere)).cast("int"))
        return F.greatest(out, F.min_by(any_of(starts, first).cast("int"), "turn")) if first else out

    value = (
        found(rules.REMEMBER) * 0.5
        + found(rules.TOOL_CALLS) * 0.4
        + F.greatest(found(rules.CORRECTIONS), found(rules.DECISIONS)) * 0.3
        + F.when(F.sum(F.when(F.length(trim(t)) > 20, F.length(t)).otherwise(0)) > 200, 0.2).otherwise(0.0)
        + F.when(F.count(F.lit(1)) > 6, 0.1).otherwise(0.0)
    )
    return placed.groupBy("conv_id").agg(F.round(F.least(F.lit(1.0), value), 6).alias("value"))


def fact_versions(facts: DataFrame) -> DataFrame:
    """facts(fact_key, id, valid_from) with the id and begin of the next version: when each ends."""
    w = Window.partitionBy("fact_key").orderBy("valid_from", "id")
    return facts.withColumn("invalidated_at", F.lead("valid_from").over(w)).withColumn("superseded_by", F.lead("id").over(w))


def facts_as_of(facts: DataFrame, at: DataFrame) -> DataFrame:
    """For each at(fact_key, at_ms): the newest version begun by then, by one sort of both sides together.

    Versions and questions of a key lie in order of time; the last version seen is the answer.
    """
    both = facts.select("fact_key", F.col("valid_from").alias("t"), F.lit(0).alias("q"), "id").unionByName(
        at.select("fact_key", F.col("at_ms").alias("t"), F.lit(1).alias("q"), F.lit(None).cast("string").alias("id"))
    )
    w = Window.partitionBy("fact_key").orderBy("t", "q", "id")
    return both.withColumn("id", F.last("id", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("q") == 1).select("fact_key", F.col("t").alias("at_ms"), "id")


def compacted(rows: DataFrame) -> DataFrame:
    """key, id, copies: of rows with one category and abstract, the newest. Aggregates before it shuffles."""
    key = F.concat(F.col("meta.memory_category"), F.lit(":"), F.lower(trim(F.col("meta.l0"))))
    return rows.groupBy(F.sha2(key, 256).alias("key")).agg(F.max(F.struct("timestamp", "id"))["id"].alias("id"), F.count(F.lit(1)).alias("copies"))


def rate_limited(events: DataFrame, most: int, seconds: int = 3600) -> DataFrame:
    """Events(user_id, event_id, ts) with the number in the window that ends at each, and whether it is over the limit."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("recent") > most)


def char_budget(turns: DataFrame, most: int) -> DataFrame:
    """Newest turns of a conversation whose lengths add up to at most `most`; the last one is cut to fit."""
    size = F.length(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    upto = turns.withColumn("upto", F.sum(size).over(w)).withColumn("before", F.col("upto") - size)
    return upto.where(F.col("before") < most).withColumn("kept", F.least(size, F.lit(most) - F.col("before"))).select("conv_id", "turn", "kept")


def newest_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("conv_id", "turn", "rank")


def dropped_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that a stage let go."""
    return before.select("id").join(after.select("id"), "id", "left_anti")


def legacy_counts(rows: DataFrame) -> DataFrame:
    """category, rows, legacy: how many rows lack the stamped category."""
    stamped = F.coalesce(F.col("meta.stamped_category"), F.lit("")) != ""
    reflected = F.coalesce(F.col("meta.row_type").startswith("memory-reflection"), F.lit(False))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~stamped & ~reflected).alias("legacy"))


def mean_pooled(chunks: DataFrame) -> DataFrame:
    """key, pos, value: element-wise mean of vectors; partial sums on each side of the shuffle."""
    return chunks.select("key", F.posexplode("vector").alias("pos", "x")).groupBy("key", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))
