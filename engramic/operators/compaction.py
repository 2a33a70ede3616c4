"""Compaction: clusters of old rows that say the same become one row with what each of them knew.

Candidate pairs come from hyperplane buckets: a table's key is on which side of PLANES random planes a
vector lies. Rows with the same vector are one class from the start, so copies never pair. Pairs are
confirmed by their cosine, and clusters are those of a greedy pass in order of importance. At a cosine
of 0.88 one plane parts a pair with a chance of 0.158, so TABLES tables of PLANES planes miss a pair
with a chance of 1e-3; a lower threshold needs fewer planes or more tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramic.functions import metadata
from engramic.functions.text import trim
from engramic.operators import pairs, retrieval, store
from engramic.operators.stored import written

PLANES, TABLES, SEED = 12, 50, 7
# The threshold, the least members of a cluster, and the caps of abstract and overview.
LEAST, LEAST_SIZE, ABSTRACT, OVERVIEW = 0.88, 2, 180, 8


def classes(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(class, id) of rows with a vector, and (class, vector, *by, place) of each class; its place is that of its first row."""
    held = rows.where(F.size("vector") > 0).withColumn("class", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by], F.to_json(F.struct("vector"))), 256))
    told = held.groupBy("class").agg(F.min(F.struct(*order)).alias("place"), *[F.first(b).alias(b) for b in by], F.first("vector").alias("vector"))
    return held.select("class", "id"), told


def bucket_pairs(rows: DataFrame, by: list[str], least: float, planes: int = PLANES, tables: int = TABLES) -> DataFrame:
    """a, b (a < b), cosine of rows(id, vector, *by) with equal ``by`` that share a bucket and reach ``least``."""
    kind = rows.schema["id"].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(planes)
        for batch in batches:
            lengths = np.asarray([len(v) for v in batch.column("vector")])
            for n in np.unique(lengths).tolist():
                if n not in sides:
                    sides[n] = np.random.default_rng(SEED).standard_normal((n, tables * planes))
                at = np.flatnonzero(lengths == n)
                some = pa.array(at)
                x = np.asarray(batch.column("vector").take(some).flatten(), float).reshape(len(at), n)
                keys = ((x @ sides[n]) > 0).reshape(len(at), tables, planes) @ weights
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(at, tables))), batch.column("key").take(pa.array(np.repeat(at, tables))), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(keys.ravel().astype(np.int64))],
                    ["id", "key", "t", "bucket"],
                )

    keyed = rows.where(F.size("vector") > 0).select("id", F.xxhash64(*by, F.size("vector")).alias("key"), "vector")
    put = keyed.mapInArrow(kernel, f"id {kind.simpleString()}, key long, t int, bucket long")
    other = put.select(F.col("id").alias("b"), "key", "t", "bucket")
    met = put.withColumnRenamed("id", "a").join(other, ["key", "t", "bucket"]).where("a < b").select("a", "b").distinct()
    told = lambda c: rows.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}"))
    near = met.join(told("a"), "a").join(told("b"), "b").select("a", "b", F.round(retrieval.cosine_unit(F.col("va"), F.col("vb")), 6).alias("cosine"))
    return near.where(F.col("cosine") >= least)


def clusters(rows: DataFrame, least: float = LEAST, least_size: int = LEAST_SIZE) -> DataFrame:
    """seed, id, other (whether it is not the seed) of greedy clusters within scopes: rows of greater importance seed first, then by id.

    Rows without a vector are in none.
    """
    ordered = rows.withColumn("_first", -F.col("importance"))
    members, told = classes(ordered, ["scope"], ["_first", "id"])
    members, told = written(members, "members"), written(told.withColumnRenamed("class", "id"), "classes")
    gone = pairs.survivors(told.select("id", "vector", "scope", "place"), ["place"], ["scope"], least, bucket_pairs(told, ["scope"], least))
    head = told.select(F.col("id").alias("class")).join(gone.select(F.col("id").alias("class"), "kept_by"), "class", "left").select("class", F.coalesce("kept_by", "class").alias("head"))
    seeds = told.select(F.col("id").alias("head"), F.col("place.id").alias("seed"))
    put = members.join(head, "class").join(seeds, "head").select("seed", "id")
    sizes = put.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size)
    return put.join(sizes.select("seed"), "seed").select("seed", "id", (F.col("id") != F.col("seed")).alias("other"))


def merged(rows: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """One row (id, text, vector, category, scope, importance, timestamp, metadata) for each cluster found(seed, id, other).

    ``rows`` need ``meta``. Lines of all members, seed first and then by id, stay once each, whatever their
    case; importance, tier, uses and confidence are the greatest; the category is the most frequent,
    of equal ones the first to be met. Members meet line by line and label by label, in aggregates; what is
    gathered is the text of the new row. The vector is the seed's until the text is embedded.
    """
    told = found.join(rows, "id").withColumn("place", F.struct("other", "id"))

    def first_spellings(values: DataFrame, most: int | None = None) -> DataFrame:
        """seed, texts of values(seed, at, text): the first of each spelling, in order."""
        once = values.where("text != ''").groupBy("seed", F.lower("text").alias("key")).agg(F.min(F.struct("at", "text")).alias("m"))
        if most:
            once = once.withColumn("nth", F.row_number().over(Window.partitionBy("seed").orderBy("m"))).where(F.col("nth") <= most)
        return once.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m.text).alias("texts"))

    lines = told.select("seed", "place", F.posexplode(F.split("meta.l2", "\n", -1)).alias("nth", "line"))
    text = first_spellings(lines.select("seed", F.struct("place", "nth").alias("at"), trim(F.col("line")).alias("text"))).select("seed", F.array_join("texts", "\n").alias("text"))
    bullets = told.select("seed", F.col("place").alias("at"), trim(F.regexp_replace("meta.l0", r"^\s*[-*]\s+", "")).alias("text"))
    overview = first_spellings(bullets, OVERVIEW).select("seed", F.array_join(F.transform("texts", lambda t: F.concat(F.lit("- "), t)), "\n").alias("overview"))
    votes = told.groupBy("seed", "category").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    category = votes.groupBy("seed").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "category")).alias("v")).select("seed", F.col("v.category").alias("category"))
    rank = F.when(F.col("meta.tier") == "core", 2).when(F.col("meta.tier") == "working", 1).otherwise(0)
    best = told.groupBy("seed").agg(
        F.least(F.lit(1.0), F.max("importance")).alias("importance"), F.min(F.struct((-F.col("importance")).alias("i"), "place", F.col("meta.l0").alias("l0")))["l0"].alias("l0"), F.first("scope").alias("scope"), F.max(rank).alias("rank"),
        F.max("meta.access_count").alias("access_count"), F.greatest(F.lit(0.7), F.max("meta.confidence")).alias("confidence"), F.greatest(F.max("timestamp"), F.lit(now)).alias("used"), F.count(F.lit(1)).alias("sources"),
    )
    vectors = told.where(~F.col("other")).select("seed", "vector")
    out = best.join(text, "seed", "left").join(overview, "seed", "left").join(category, "seed").join(vectors, "seed").withColumn("text", F.coalesce("text", F.lit("")))
    sentence = F.coalesce(F.nullif(F.regexp_extract("text", r"^[^.!?。！？\n]+[.!?。！？]?", 0), F.lit("")), F.col("text"))
    abstract = trim(F.substring(F.coalesce(F.nullif(F.col("l0"), F.lit("")), sentence), 1, ABSTRACT))
    fields = [
        abstract.alias("l0_abstract"), F.coalesce("overview", F.concat(F.lit("- "), abstract)).alias("l1_overview"), F.col("text").alias("l2_content"), metadata.category_from_legacy(F.col("category"), F.col("text"), F.lit(None).cast("string")).alias("memory_category"),
        F.element_at(F.array(F.lit("peripheral"), F.lit("working"), F.lit("core")), F.col("rank") + 1).alias("tier"), "access_count", "confidence", F.col("used").alias("last_accessed_at"),
        F.lit(True).alias("compacted"), F.col("sources").alias("sourceCount"), F.lit(now).alias("compactedAt"),
    ]
    return out.select(F.concat(F.lit("compacted:"), "seed").alias("id"), "text", "vector", "category", "scope", "importance", F.lit(now).alias("timestamp"), F.to_json(F.struct(*fields)).alias("metadata"))


def compacted(rows: DataFrame, now: int, least_days: int = 7, least: float = LEAST, least_size: int = LEAST_SIZE, scopes: list[str] | None = None, dry_run: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows after a run, clusters found, stats: scanned, clusters, deleted, created).

    Rows younger than ``least_days`` and rows without a vector stay as they are. ``embed`` gives the new rows
    their vectors. A dry run changes nothing.
    """
    old = store.scoped(rows, scopes).where((F.col("timestamp") < now - least_days * 86_400_000) & (F.size("vector") > 0))
    found = written(clusters(old, least, least_size), "clusters")
    counts = found.agg(F.count_distinct("seed").alias("clusters"), F.count(F.lit(1)).alias("members"))
    done = F.lit(0 if dry_run else 1)
    stats = old.agg(F.count(F.lit(1)).alias("scanned")).crossJoin(counts).select("scanned", "clusters", (F.col("members") * done).alias("deleted"), (F.col("clusters") * done).alias("created"))  # one row beside one row
    columns = [c for c in rows.columns if c != "meta"]
    if dry_run:
        return rows.select(columns), found, stats
    new = merged(old, found, now)
    new = embed(new) if embed else new
    left = rows.join(found.select("id"), "id", "left_anti").select(columns)
    return left.unionByName(new.select([c for c in new.columns if c in columns]), allowMissingColumns=True), found, stats
