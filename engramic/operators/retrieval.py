"""Vector search, lexical search and their fusion, for a stated set of queries against all rows.

Queries are asked in blocks of bounded size. A block goes to all partitions of the rows; each scores
its own rows and keeps the k best of each query, so one scan and k rows a query and partition are
all that a block costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engramic.operators import postings
from engramic.operators.stored import written

# Fixed values of the scoring rules.
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3
STRONG, STRONG_SHARE, LEAST = 0.75, 0.92, 0.1
#: Queries, and numbers or words of queries, that are sent to the rows at once; more are asked in blocks.
MOST_QUERIES, MOST_VALUES = 10_000, 8_000_000
#: Scores that a task computes at once.
MOST_SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In -1 to 1; 0 for zero, null and unequally long vectors."""
    usable = (F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))).otherwise(0.0)


def cosine_unit(a: Column, b: Column) -> Column:
    """As ``cosine``, with 0 for negative values."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def cosine_of_prefix(a: Column, b: Column) -> Column:
    """Over the first values that both vectors have."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; equal scores by id. Spark keeps k a query before it shuffles."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int, least: float) -> None:
        self.k, self.held, self.least = k, [[] for _ in range(queries)], np.full(queries, least)

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        """``ids`` belong to ``scores``; scores below the query's least one do not count."""
        for i in np.flatnonzero(scores >= self.least[query]).tolist():
            self.held[query].append((-float(scores[i]), ids[i]))
        if len(self.held[query]) > self.k:
            self.held[query] = sorted(self.held[query])[: self.k]
            self.least[query] = max(self.least[query], -self.held[query][-1][0])

    def rows(self, names: list, id_type: pa.DataType, query_type: pa.DataType) -> pa.RecordBatch:
        out = [(names[q], i, -s) for q, held in enumerate(self.held) for s, i in held]
        q, i, s = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(q, query_type), pa.array(i, id_type), pa.array(s, pa.float64())], ["query_id", "id", "score"])


def _blocks(asked: DataFrame, size: Callable[[list], int]) -> Iterator[list[list]]:
    """The rows of ``asked`` in blocks of at most MOST_QUERIES rows and MOST_VALUES values."""
    block, values = [], 0
    for row in asked.toLocalIterator():
        n = size(row[1])
        if block and (len(block) >= MOST_QUERIES or values + n > MOST_VALUES):
            yield block
            block, values = [], 0
        block.append(list(row))
        values += n
    if block:
        yield block


def _asked(rows: DataFrame, queries: DataFrame, blocks: Iterator[list[list]], kernel: Callable, k: int) -> DataFrame:
    """Hits of all blocks; ``kernel`` makes a function on batches of a block."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    out = None
    for block in blocks:
        held = rows.sparkSession.sparkContext.broadcast(block)
        hits = top(rows.mapInArrow(kernel(held), schema), k)
        out = hits if out is None else out.union(hits)
    return out if out is not None else top(rows.sparkSession.createDataFrame([], schema), k)


def vector_search(rows: DataFrame, queries: DataFrame, k: int = 20, min_score: float = 0.3) -> DataFrame:
    """query_id, id, score, rank; rows(id, vector), queries(query_id, vector); score is 1 / (1 + cosine distance).

    Null and zero vectors, and vectors of another length than the query's, match nothing.
    """
    asked = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))

    kind = to_arrow_type(queries.schema["query_id"].dataType)

    def kernel(held):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [q for q, _ in held.value]
            best = Best(len(names), k, min_score)
            by_size: dict[int, tuple[list[int], np.ndarray]] = {}
            for n in {len(v) for _, v in held.value}:
                own = [i for i, (_, v) in enumerate(held.value) if len(v) == n]
                m = np.asarray([held.value[i][1] for i in own], float)
                norm = np.linalg.norm(m, axis=1)
                by_size[n] = ([i for i, x in zip(own, norm, strict=True) if x > 0], (m / np.where(norm, norm, 1)[:, None])[norm > 0])
            types = None
            for batch in batches:
                ids, vectors = batch.column("id"), batch.column("vector")
                types = ids.type
                lengths = np.asarray([len(v) if v.is_valid else 0 for v in vectors])
                for n, (own, m) in by_size.items():
                    at = np.flatnonzero(lengths == n)
                    if not len(at) or not len(own):
                        continue
                    x = np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), n).astype(float)
                    norm = np.linalg.norm(x, axis=1)
                    at, x = at[norm > 0], x[norm > 0] / norm[norm > 0][:, None]
                    some = ids.take(pa.array(at)).to_pylist()
                    step = max(1, MOST_SCORES // len(own))
                    for start in range(0, len(at), step):
                        scores = np.round(1 / (2 - x[start : start + step] @ m.T), 6)
                        for j in np.flatnonzero(scores.max(axis=0) >= best.least[own]).tolist():
                            best.add(own[j], scores[:, j], some[start : start + step])
            if types is not None:
                yield best.rows(names, types, kind)

        return score

    return _asked(rows.select("id", "vector"), queries, _blocks(asked, len), kernel, k)


def lexical_search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank; rows(id, text), queries(query_id, text); BM25 through 1 / (1 + exp(-s / 5)).

    The rows are indexed first; to ask the same rows again, build an index once and use
    ``indexed_search``. Rows without a word of the query are no hits. Where both have a ``space``,
    a query is asked of the rows of its own space alone, with that space's frequencies.
    """
    return indexed_search(postings.build(rows, places=False), queries, k)


def indexed_search(index: postings.Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """``lexical_search`` of a stored index."""
    asked = queries.select("query_id", F.array_distinct(postings.terms_of(queries)).alias("w"))
    kind = queries.schema["query_id"].dataType
    found = [top(postings.search_block(index, block, kind, k), k) for block in _blocks(asked, len)]
    if len(found) > 1:  # each block is asked and let go before the next
        found = [written(hits, "hits") for hits in found]
    if not found:
        id_type = index.documents().schema["id"].dataType.simpleString()
        return top(index.spark.createDataFrame([], f"query_id {kind.simpleString()}, id {id_type}, score double"), k)
    return reduce(DataFrame.union, found)


def lexical_fallback(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank of rows whose text or summaries hold the whole query; rows need ``meta``.

    The queries are a stated set; they meet each row beside its text, and only hits leave it.
    """
    from engramic.functions.scoring import lexical_hit
    from engramic.functions.text import trim

    low = {n: F.lower(F.coalesce(f, F.lit(""))) for n, f in (("text", F.col("text")), ("l0", F.col("meta.l0")), ("l1", F.col("meta.l1")), ("l2", F.col("meta.l2")))}
    # lowered once a row; a summary that repeats another field is not searched again, as the other one scores more
    told = rows.select("id", "timestamp", *[c.alias(f"_{n}") for n, c in low.items()])
    own = {"text": F.lit(True), "l0": F.col("_l0") != F.col("_text"), "l1": F.col("_l1") != F.concat(F.lit("- "), F.col("_l0")), "l2": F.col("_l2") != F.col("_text")}
    told = told.select("*", *[F.when(new, F.col(f"_{n}")).alias(f"_own_{n}") for n, new in own.items() if n != "text"])
    out = None
    for block in _blocks(queries.select("query_id", trim(F.lower(F.coalesce("text", F.lit("")))).alias("q")), len):
        asked = F.broadcast(rows.sparkSession.createDataFrame(block, f"query_id {queries.schema['query_id'].dataType.simpleString()}, q string"))
        score = F.greatest(*[lexical_hit(F.col("q"), F.col(f"_{n}"), w) for n, w in (("text", 1.0), ("l0", 0.98), ("l1", 0.92), ("l2", 0.96))])
        found = [F.contains(F.col(c), F.col("q")) for c in ("_text", "_own_l0", "_own_l1", "_own_l2")]
        # a query may also begin with the dash that an overview puts before the abstract
        pairs = told.join(asked, reduce(Column.__or__, [*found, F.startswith(F.col("_l1"), F.col("q"))]))
        hits = pairs.select("query_id", "id", "timestamp", F.round(score, 6).alias("score")).where("score > 0")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("timestamp"), "id")
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("timestamp")
        out = hits if out is None else out.union(hits)
    return out


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank, vector_score, lexical_score: the weighted sum, at least a share of a strong lexical score."""
    both = vector.select("query_id", "id", F.col("score").alias("v")).join(lexical.select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "full_outer")
    summed = VECTOR_WEIGHT * F.col("v") + LEXICAL_WEIGHT * F.coalesce("b", F.lit(0.0))
    score = F.when(F.col("v").isNull(), F.col("b")).when(F.col("b") >= STRONG, F.greatest(summed, STRONG_SHARE * F.col("b"))).otherwise(summed)
    scored = both.select("query_id", "id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(LEAST), score)), 6).alias("score"), F.col("v").alias("vector_score"), F.col("b").alias("lexical_score"))
    return top(scored, k).select("query_id", "id", "score", "rank", "vector_score", "lexical_score")
