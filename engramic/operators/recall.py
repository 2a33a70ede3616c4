"""Whole recalls: search, fusion, filters, rerank, lifecycle scores, noise, diversity and the limit.

Rows have id, text, vector, category, scope, importance, timestamp and ``meta``. Queries have
query_id, text and vector. A recall is one pass over its hits, at most some POOL rows a query: each
hit gets the score of every stage and the stage that it left at, so results, traces and counts come
from the same rows. Hits meet rows in joins by id, whose side to broadcast Spark chooses by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import metadata, rules, scoring
from engramic.operators import diversity, retrieval, store
from engramic.operators.stored import written

# Hits before fusion, scores below which hits go, and the most results of a query.
POOL, MIN_SCORE, HARD_MIN, MOST_RESULTS = 20, 0.3, 0.35, 20
HALF_LIFE = 60.0
#: Stages after the search, in order, and the column of a hit's score after each.
STAGES = {
    "min_score": "searched", "expired": "searched", "rerank_window": "searched", "rerank": "reranked", "recency_boost": "recent", "importance_weight": "weighted",
    "length_norm": "normed", "time_decay": "score", "hard_min_score": "score", "noise_filter": "score", "diversity": "score", "limit": "score",
}
#: What a recall reads of a row and of its typed metadata.
COLUMNS = ["id", "text", "vector", "category", "scope", "importance", "timestamp"]
FIELDS = ["valid_from", "invalidated_at", "valid_until", "temporal_type", "reinforced", "reinforced_at", "stamped_category"]


def searchable(rows: DataFrame, scopes: list[str] | None, now: Column) -> DataFrame:
    """The rows that a search may return: of these scopes, begun and not ended."""
    begun = (F.col("meta.valid_from") <= now) & F.coalesce(F.col("meta.invalidated_at") > now, F.lit(True))
    return store.scoped(rows, scopes).where(begun)


def narrowed(rows: DataFrame, *also: str) -> DataFrame:
    """What a recall reads of the rows, and ``also`` these columns; to be stored before one."""
    meta = F.struct(*[F.col(f"meta.{f}").alias(f) for f in FIELDS]).alias("meta")
    return rows.select(*COLUMNS, *also, meta)


def of_category(hits: DataFrame, rows: DataFrame, category: str | None) -> DataFrame:
    if category is None:
        return hits
    kept = rows.where(metadata.category_matches(F.col("category"), F.col("meta.stamped_category"), category)).select("id")
    return retrieval.top(hits.drop("rank").join(kept, "id"), POOL)


def lexical_arm(rows: DataFrame, queries: DataFrame, category: str | None = None, expand: bool = False) -> DataFrame:
    """Lexical hits of a category, ranked again; queries of people are expanded."""
    asked = queries.withColumn("text", rules.expand_query(F.coalesce("text", F.lit("")))) if expand else queries
    return of_category(retrieval.lexical_search(rows, asked, POOL), rows, category)


def traced(hits: DataFrame, rows: DataFrame, now: Column, limit: int, queries: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """hits(query_id, id, score, ..) with the scores of STAGES, left_at (null for results) and position.

    ``queries`` with vectors ask for the rerank by cosine, in a window of twice the limit; ``least`` is the
    score below which hits of the search go.
    """
    corpus = F.col("id").startswith("corpus:")
    dynamic = F.coalesce(F.col("meta.temporal_type") == "dynamic", F.lit(False))
    half = scoring.effective_half_life(F.when(dynamic, HALF_LIFE / 3).otherwise(HALF_LIFE), F.col("meta.reinforced"), F.col("meta.reinforced_at"), now)
    # texts are looked at once a row, however many queries found it: in one plan the search for noise would run once a hit
    hits = written(hits, "hits")
    found = rows.join(hits.select("id").distinct(), "id", "left_semi")
    over = F.coalesce(F.col("meta.valid_until") <= now, F.lit(False))
    told = found.select("id", F.length("text").alias("length"), rules.is_noise(F.col("text")).alias("noise"), "timestamp", "importance", "vector", corpus.alias("corpus"), half.alias("half"), over.alias("over"))
    t = hits.withColumnRenamed("score", "searched").join(written(told, "told"), "id")
    weak = F.col("searched") < least if least is not None else F.lit(False)
    t = t.withColumn("left_at", F.when(weak, "min_score").when(F.col("over"), "expired")).drop("over")
    if queries is None:
        t = t.withColumn("reranked", F.col("searched"))
    else:
        best = Window.partitionBy("query_id", F.col("left_at").isNull()).orderBy(F.desc("searched"), "id")
        late = F.col("left_at").isNull() & (F.row_number().over(best) > 2 * limit)
        t = t.withColumn("left_at", F.when(late, "rerank_window").otherwise(F.col("left_at")))
        t = t.join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
        t = t.withColumn("near", F.coalesce(retrieval.cosine(F.col("vector"), F.col("q")), F.lit(0.0))).drop("q")
        t = t.withColumn("reranked", scoring.cosine_rerank(F.col("searched"), F.col("near"))).drop("near")
    t = t.withColumn("recent", scoring.recency_boost(F.col("reranked"), F.col("timestamp"), now))
    t = t.withColumn("weighted", scoring.importance_weight(F.col("recent"), F.col("importance")))
    t = t.withColumn("normed", F.greatest(F.col("weighted") * 0.3, scoring.length_norm(F.col("weighted"), F.col("length"), F.col("corpus"))))
    t = t.withColumn("score", F.round(F.greatest(F.col("normed") * 0.5, scoring.time_decay(F.col("normed"), F.col("timestamp"), F.col("half"), F.col("corpus"), now)), 6))
    left = F.when(F.col("left_at").isNotNull(), F.col("left_at")).when(F.col("score") < HARD_MIN, "hard_min_score").when(F.col("noise"), "noise_filter")
    # scores are computed once; a filter on what they lead to would hold them all, each in the next
    t = written(t.withColumn("left_at", left).drop("length", "noise", "timestamp", "importance", "corpus", "half"), "scored")
    # hits that are left go in order, diverse ones first; a group is the hits of one query
    order = diversity.diversified(t.where("left_at IS NULL")).select("query_id", "id", "position")
    t = t.drop("vector").join(order, ["query_id", "id"], "left")
    return t.withColumn("left_at", F.when(F.col("position") > limit, "limit").otherwise(F.col("left_at")))


def results(hits: DataFrame) -> DataFrame:
    """query_id, id, score, position of the traced hits that never left."""
    return hits.where("left_at IS NULL").select("query_id", "id", "score", "position")


def hybrid_traced(rows: DataFrame, queries: DataFrame, now: Column, limit: int = 5, scopes: list[str] | None = None, category: str | None = None, expand: bool = False) -> DataFrame:
    """Traced hits of both searches, with vector_score and lexical_score."""
    own = searchable(rows, scopes, now)
    pool = max(POOL, 2 * limit)
    vector = of_category(retrieval.vector_search(own, queries, pool, MIN_SCORE), own, category)
    fused = retrieval.fuse(vector, lexical_arm(own, queries, category, expand), 2 * pool).drop("rank")
    return traced(fused, own, now, limit, queries, MIN_SCORE)


def hybrid(rows: DataFrame, queries: DataFrame, now: Column, limit: int = 5, scopes: list[str] | None = None, category: str | None = None, expand: bool = False) -> DataFrame:
    """query_id, id, score, position of both searches; reranked by cosine, as without a reranking service."""
    return results(hybrid_traced(rows, queries, now, limit, scopes, category, expand))


def vector_only(rows: DataFrame, queries: DataFrame, now: Column, limit: int = 5, scopes: list[str] | None = None, category: str | None = None) -> DataFrame:
    own = searchable(rows, scopes, now)
    hits = of_category(retrieval.vector_search(own, queries, max(POOL, 2 * limit), MIN_SCORE), own, category)
    return results(traced(hits.drop("rank"), own, now, limit))


def lexical_only(rows: DataFrame, queries: DataFrame, now: Column, limit: int = 5, scopes: list[str] | None = None, category: str | None = None) -> DataFrame:
    """For queries with tags: every tag of the query must stand in the row's text."""
    own = searchable(rows, scopes, now)
    tags = queries.select("query_id", F.transform(rules.tag_tokens(F.coalesce("text", F.lit(""))), F.lower).alias("tags"))
    held = lexical_arm(own, queries, category).join(tags, "query_id").join(own.select("id", F.lower("text").alias("low")), "id")
    hits = held.where(F.forall("tags", lambda t: F.contains(F.col("low"), t))).select("query_id", "id", "score")
    return results(traced(hits, own, now, limit))


def retrieve(rows: DataFrame, queries: DataFrame, now: Column, limit: int = 5, scopes: list[str] | None = None, category: str | None = None, mode: str = "hybrid", by_hand: bool = False) -> DataFrame:
    """query_id, id, score, position, way: each query goes the way that it asks for.

    Queries with tags are searched by their words, in which all tags must stand; the others by
    vectors alone (``mode`` "vector") or both ways. The limit is held between 1 and MOST_RESULTS.
    """
    limit = min(MOST_RESULTS, max(1, int(limit)))
    tagged = F.size(rules.tag_tokens(F.coalesce("text", F.lit("")))) > 0
    plain = queries.where(~tagged)
    rest = vector_only(rows, plain, now, limit, scopes, category) if mode == "vector" else hybrid(rows, plain, now, limit, scopes, category, by_hand)
    lexical = lexical_only(rows, queries.where(tagged), now, limit, scopes, category)
    return lexical.withColumn("way", F.lit("lexical")).unionByName(rest.withColumn("way", F.lit(mode)))


def accesses(found: DataFrame, at: int) -> DataFrame:
    """What a recall by hand tells of its rows: id, delta, accessed_at, one row for each row and query."""
    return found.select("id", F.lit(1).alias("delta"), F.lit(at).cast("long").alias("accessed_at"))


def trace(hits: DataFrame) -> DataFrame:
    """query_id, place, stage, input_count, output_count, dropped_ids, least, most: the stages of traced hits, by one grouping.

    ``dropped_ids`` are sorted; ``least`` and ``most`` bound the scores of those that stay, null where none does.
    """
    names = list(STAGES)
    number = F.coalesce(*[F.when(F.col("left_at") == n, F.lit(k)) for k, n in enumerate(names)], F.lit(len(names)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("stage"), F.col(c).alias("score")) for k, (n, c) in enumerate(STAGES.items())]))
    long = hits.select("query_id", "id", number.alias("left"), each.alias("s")).where(F.col("left") >= F.col("s.place")).select("query_id", "id", "s.*", (F.col("left") > F.col("s.place")).alias("stays"))
    score = F.when(F.col("stays"), F.col("score"))
    return long.groupBy("query_id", "place", "stage").agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if("stays").alias("output_count"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.col("id")))).alias("dropped_ids"),
        F.round(F.min(score), 6).alias("least"),
        F.round(F.max(score), 6).alias("most"),
    )


def summaries(stages: DataFrame) -> DataFrame:
    """query_id, final_count, summary: the trace of each query as text; at most five dropped ids a stage are named."""
    ids = F.col("dropped_ids").cast("array<string>")
    named = F.when(F.size(ids) > 5, F.concat(F.array_join(F.slice(ids, 1, 5), ", "), F.lit(" (+"), F.size(ids) - 5, F.lit(" more)"))).otherwise(F.array_join(ids, ", "))
    scores = F.when(F.col("least").isNotNull(), F.concat(F.lit(" scores=["), F.format_string("%.3f", "least"), F.lit(", "), F.format_string("%.3f", "most"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  "), "stage", F.lit(": "), "input_count", F.lit(" -> "), "output_count", F.lit(" (-"), F.col("input_count") - F.col("output_count"), F.lit(")"), scores, F.when(F.size(ids) > 0, F.concat(F.lit("\n    dropped: "), named)).otherwise(""))
    told = stages.select("query_id", "place", "output_count", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"), F.max_by("output_count", "place").alias("last"), F.max("place").alias("reached"))
    final = F.when(F.col("reached") == len(STAGES) - 1, F.col("last")).otherwise(F.lit(0).cast("long"))
    text = F.concat(F.lit("Retrieval trace ("), F.size("lines"), F.lit(" stages):\n"), F.array_join(F.transform("lines", lambda x: x.line), "\n"), F.lit("\n  final count: "), final)
    return told.select("query_id", final.alias("final_count"), text.alias("summary"))


def drop_summary(stages: DataFrame) -> DataFrame:
    """query_id, stage, before, after, dropped, nth: the stages that let rows go, those with most first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("dropped"), "place")
    drops = stages.select("query_id", "place", "stage", F.col("input_count").alias("before"), F.col("output_count").alias("after"), (F.col("input_count") - F.col("output_count")).alias("dropped"))
    return drops.where("dropped > 0").withColumn("nth", F.row_number().over(order)).drop("place")


def neighbors(rows: DataFrame, hits: DataFrame, per_hit: int = 2) -> DataFrame:
    """query_id, id, neighbor, score, position: rows of the hit's scope that are likest to its text and no hits themselves.

    One search asks every hit's text of the rows of its own scope.
    """
    spaced = rows.withColumn("space", F.coalesce("scope", F.lit("global")))
    asked = spaced.select("id", "text", "space").join(hits.select("query_id", "id"), "id").withColumn("key", F.concat_ws("/", "query_id", "id"))
    found = retrieval.lexical_search(spaced.select("id", "text", "space"), asked.select(F.col("key").alias("query_id"), "text", "space"), 50)
    near = found.select(F.col("query_id").alias("key"), F.col("id").alias("neighbor"), "score").join(asked.select("key", "query_id", "id"), "key")
    near = near.join(hits.select("query_id", F.col("id").alias("neighbor")), ["query_id", "neighbor"], "left_anti")
    quiet = near.join(rows.where(~rules.is_noise(F.col("text"))).select(F.col("id").alias("neighbor")), "neighbor")
    best = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "neighbor")
    return quiet.withColumn("position", F.row_number().over(best)).where(F.col("position") <= per_hit).select("query_id", "id", "neighbor", "score", "position")
