"""Rows against rows by vectors: matches of candidates, duplicates, clusters.

Candidates are a stated set that goes to the rows in blocks; within a table, pairs meet inside one
category and scope, in blocks of vectors, and only pairs at the threshold leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramic.functions.scoring import score_to_cosine
from engramic.operators import retrieval
from engramic.operators.stored import written

#: Rows of one key that are compared with each other in one step.
BLOCK = 2048


def matches(rows: DataFrame, candidates: DataFrame, k: int = 8) -> DataFrame:
    """cand_id, id, cosine, rank of candidates(cand_id, category, vector): those of the candidate's own category if there are any."""
    hits = retrieval.vector_search(rows, candidates.select(F.col("cand_id").alias("query_id"), "vector"), k, 0.0)
    told = rows.select("id", F.col("memory_category").alias("of")).join(F.broadcast(hits), "id").withColumnRenamed("query_id", "cand_id")
    told = told.join(F.broadcast(candidates.select("cand_id", "category")), "cand_id").withColumn("same", F.col("of") == F.col("category"))
    any_same = told.groupBy("cand_id").agg(F.max("same").alias("any_same"))
    kept = told.join(F.broadcast(any_same), "cand_id").where(F.col("same") | ~F.col("any_same"))
    return kept.select("cand_id", "id", F.round(score_to_cosine(F.col("score")), 6).alias("cosine"), "rank")


def prefiltered(rows: DataFrame, candidates: DataFrame, k: int = 5, least: float = 0.7) -> DataFrame:
    """cand_id, decision, similar: candidates without a similar row are created; others wait for a verdict on theirs."""
    hits = retrieval.vector_search(rows, candidates.select(F.col("cand_id").alias("query_id"), "vector"), k, least)
    similar = hits.groupBy(F.col("query_id").alias("cand_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("similar"))
    out = candidates.select("cand_id").join(similar, "cand_id", "left")
    return out.select("cand_id", F.when(F.col("similar").isNull(), "create").otherwise("judge").alias("decision"), F.coalesce(F.col("similar").cast("array<string>"), F.array().cast("array<string>")).alias("similar"))


def similar_pairs(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """a, b (a < b), cosine of rows(id, vector, *by) with equal ``by`` and a cosine of ``least`` or more.

    The rows of a key are cut into blocks by a hash; each pair of blocks is one group, so no group
    grows with its key. Work within a key is that of all pairs of its rows.
    """
    held = rows.where(F.size("vector") > 0).select("id", "vector", F.xxhash64(*by).alias("key"))
    sizes = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = held.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "vector")
    kind = rows.schema["id"].dataType.simpleString()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group["p"].iat[0], group["q"].iat[0]
        x, y = group[group["own"] == p], group[group["own"] == q]
        unit = lambda g: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None])(np.stack(list(g["vector"])).astype(float))
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        cos = unit(x) @ unit(y).T
        i, j = np.nonzero(cos >= least)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        out = pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "cosine": cos[i, j].round(6)})
        return out[out["a"] != out["b"]].drop_duplicates(["a", "b"])

    return dealt.groupBy("key", "p", "q").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def survivors(rows: DataFrame, order: list[str], by: list[str], least: float, found: DataFrame | None = None) -> DataFrame:
    """id, kept_by of the rows that are dropped: in the order of ``order``, a row alike to an earlier survivor goes to the first of these.

    Round by round, rows without an undecided earlier neighbour survive and their later neighbours
    go; a round is two joins of the pairs that are left, and there are as many rounds as the longest
    chain of rows each alike to the next. ``order`` must be unique within a key. ``found(a, b)`` are the
    alike pairs where the caller has them already.
    """
    places = rows.select("id", F.struct(*order).alias("place"))
    pairs = similar_pairs(rows, by, least) if found is None else found
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = both.join(places.select(F.col("id").alias("a"), F.col("place").alias("pa")), "a").join(places.select(F.col("id").alias("b"), F.col("place").alias("pb")), "b")
    edges = written(edges.where("pa < pb").select("a", "b", "pa"), "edges")
    open_, kept = edges, None
    while not open_.isEmpty():
        new = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        new = written(new, "kept")
        gone = open_.join(new.select(F.col("id").alias("a")), "a", "left_semi").select("b").distinct()
        kept = new if kept is None else kept.union(new)
        left = open_.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
        # rows whose earlier neighbours have all gone survive too, though no pair of theirs is left
        alone = open_.select(F.col("b").alias("id")).distinct().join(gone.select(F.col("b").alias("id")), "id", "left_anti").join(left.select(F.col("b").alias("id")), "id", "left_anti")
        kept = kept.union(written(alone, "kept"))
        # survivors of this round still drop their later neighbours that are open
        late = left.select("a", "b", "pa").union(edges.join(alone.select(F.col("id").alias("a")), "a", "left_semi").join(gone, "b", "left_anti").select("a", "b", "pa"))
        open_ = written(late.distinct(), "edges")
    if kept is None:
        return edges.select(F.col("b").alias("id"), F.col("a").alias("kept_by"))
    first = edges.join(kept.distinct().select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("pa", "a")).alias("m"))
    return first.join(kept.distinct(), "id", "left_anti").select("id", F.col("m.a").alias("kept_by"))


def clusters(rows: DataFrame, least: float = 0.88) -> DataFrame:
    """seed, id: greedy clusters of a scope; rows of greater importance seed first, then by id."""
    ordered = rows.withColumn("_first", -F.col("importance"))
    gone = survivors(ordered, ["_first", "id"], ["scope"], least)
    seeds = gone.select(F.col("kept_by").alias("seed"), F.col("kept_by").alias("id")).distinct()
    return gone.select(F.col("kept_by").alias("seed"), "id").union(seeds)
