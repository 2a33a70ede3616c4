"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import rules
from engramic.operators import recall, retrieval
from engramic.operators.stored import written
from engramic.plans import columns, documents, lines, memories, relations, store_tools, tools, upkeep
from engramic.plans.memories import NOW


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, vector of every row whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id", "left")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memory rows with typed metadata and the vectors of their numbers."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return memories.smart(spark, sf_dir).join(vectors, "doc_id", "left")


def _remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a recall of now may return, stored with what it reads of them, as a recall finds them."""
    return written(recall.narrowed(recall.searchable(_typed(spark, sf_dir), None, F.lit(NOW)), "doc_id"), "remembered")


def d1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_search(rows, _queries(spark, sf_dir))


def d2_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks with its text."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.lexical_search(rows, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def d3_lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as phrases."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_fallback(written(_typed(spark, sf_dir), "remembered"), asked)


def d4_hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.fuse(d1_vector_search(spark, sf_dir), retrieval.lexical_search(rows, _queries(spark, sf_dir)))


def d5_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits of rows that the store still has: here those of even numbers are gone."""
    hits = d2_lexical_search(spark, sf_dir)
    left = _table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"))
    return hits.join(left, "id", "left_semi").select("query_id", "id", "score", "rank")


def d6_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recall.searchable(_remembered(spark, sf_dir), None, F.lit(NOW))
    hits = _queries(spark, sf_dir).join(rows.select("id", "doc_id"), F.col("query_id") == F.col("doc_id")).select("query_id", "id")
    return recall.neighbors(rows, hits)


def h1_id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lexical = retrieval.lexical_search(rows, _queries(spark, sf_dir))
    return d1_vector_search(spark, sf_dir).select("query_id", "id").union(lexical.select("query_id", "id")).distinct()


def m3_hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.hybrid(_remembered(spark, sf_dir), _queries(spark, sf_dir), F.lit(NOW))


def m3_scoped_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.hybrid(_remembered(spark, sf_dir), _queries(spark, sf_dir), F.lit(NOW), scopes=["src:src0", "src:src1", "src:src2"], category="events")


def m4_vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.vector_only(_remembered(spark, sf_dir), _queries(spark, sf_dir), F.lit(NOW))


def m5_tagged_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("proj:p"), F.col("doc_id") % 3, F.lit(" "), F.col("text"))
    asked = _queries(spark, sf_dir).withColumn("text", F.concat(F.lit("Proj:P"), F.col("query_id") % 3, F.lit(" "), F.coalesce("text", F.lit(""))))
    return recall.lexical_only(_remembered(spark, sf_dir).withColumn("text", tag), asked, F.lit(NOW))


def m6_lexical_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return recall.lexical_arm(recall.searchable(_remembered(spark, sf_dir), None, F.lit(NOW)), asked, "events").select("query_id", "id", "score", "rank")


def _m3_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.hybrid_traced(_remembered(spark, sf_dir), _queries(spark, sf_dir), F.lit(NOW))


def m2_retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score ranges and dropped ids of every stage of m3, from one pass."""
    return recall.trace(_m3_traced(spark, sf_dir)).select("query_id", "stage", "input_count", "output_count", F.array_join("dropped_ids", ",").alias("dropped"), "least", "most")


def m13_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.summaries(recall.trace(_m3_traced(spark, sf_dir)))


def l13_explain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit of m3 with its score after every stage and the stage that it left at."""
    scores = [F.round(c, 4).alias(c) for c in ("reranked", "recent", "weighted", "normed")]
    return _m3_traced(spark, sf_dir).select("query_id", "id", *scores, "score", "left_at")


def e3_drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.drop_summary(recall.trace(_m3_traced(spark, sf_dir)))


def m1_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of which every third asks with a tag."""
    tag = F.concat(F.lit("proj:p"), F.col("doc_id") % 3, F.lit(" "), F.col("text"))
    tagged = F.when(F.col("query_id") % 300 == 0, F.concat(F.lit("Proj:P"), F.col("query_id") % 3, F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return recall.retrieve(_remembered(spark, sf_dir).withColumn("text", tag), _queries(spark, sf_dir).withColumn("text", tagged), F.lit(NOW))


def m7_expanded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person's query asks of the lexical search, where an automatic one asks with its text."""
    asked = memories.phrases(spark, sf_dir)
    return asked.select("id", rules.expand_query(F.col("text")).alias("by_hand"), F.col("text").alias("automatic"))


D1_SQL = """
SELECT query_id, id, score, rank FROM (
  SELECT v.vec_id AS query_id, e.vec_id AS id, round(1 / (2 - list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score,
         row_number() OVER (PARTITION BY v.vec_id ORDER BY round(1 / (2 - list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) DESC, e.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) v CROSS JOIN embeddings e
) WHERE score >= 0.3 AND rank <= 20
"""


def _lexical(rows: str, queries: str) -> str:
    """BM25 of queries(query_id, text) over rows(id, text), all hits."""
    return rf"""
  SELECT query_id, id, round(CASE WHEN raw > 0 THEN 1 / (1 + exp(-raw / 5)) ELSE 0.5 END, 6) AS score FROM (
    WITH s AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM ({rows})),
    t AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM s),
    q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM ({queries})),
    p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM s) GROUP BY 1, 2, 3),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
    SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS raw
    FROM q JOIN p USING (term) JOIN d USING (term) CROSS JOIN t GROUP BY 1, 2)"""


def _ranked(hits: str, k: int, by: str = "score DESC, id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank FROM ({hits})) WHERE rank <= {k}"


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_ASKED = "SELECT vec_id AS query_id, text, embedding::DOUBLE[] AS q FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0"
_DOCS = "SELECT doc_id AS id, text FROM documents"
D2_SQL = f"SELECT query_id, id, score, rank FROM ({_ranked(_lexical(_DOCS, _ITEMS), 20)})"
_FUSED = """SELECT query_id, id, vector_score, lexical_score, round(least(1, greatest(0.1, CASE WHEN vector_score IS NULL THEN lexical_score
    WHEN lexical_score >= 0.75 THEN greatest(0.7 * vector_score + 0.3 * lexical_score, 0.92 * lexical_score)
    ELSE 0.7 * vector_score + 0.3 * coalesce(lexical_score, 0) END)), 6) AS score FROM (
    SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, v.score AS vector_score, b.score AS lexical_score
    FROM ({v}) v FULL JOIN ({b}) b ON v.query_id = b.query_id AND v.id = b.id)"""
_B4 = _ranked(_lexical(_DOCS, _ASKED), 20)
D4_SQL = f"SELECT query_id, id, score, rank, vector_score, lexical_score FROM ({_ranked(_FUSED.format(v=D1_SQL, b=_B4), 20)})"
_HIT = "CASE WHEN contains(lower({f}), q) THEN least(0.95, 0.72 + length(q) * 0.02) * {w} ELSE 0 END"
_BEST = "round(greatest(" + ", ".join(_HIT.format(f=f, w=w) for f, w in (("text", 1.0), ("l0", 0.98), ("l1", 0.92), ("l2", 0.96))) + ")::DOUBLE, 6)"
D3_SQL = f"""WITH {memories.SMART_SQL}, a AS (SELECT item_id AS query_id, regexp_replace(lower(text), {memories.TRIM}) AS q FROM benchmark)
SELECT query_id, id, score, rank FROM ({_ranked(f"SELECT query_id, id, timestamp, {_BEST} AS score FROM smart, a WHERE q <> '' AND {_BEST} > 0", 20, "score DESC, timestamp DESC, id")})"""

_LIVE = f"live AS (SELECT smart.*, embedding::DOUBLE[] AS vector FROM smart LEFT JOIN embeddings ON vec_id = doc_id WHERE valid_from <= {NOW} AND coalesce(invalidated_at > {NOW}, true) {{also}})"
_VEC = "SELECT query_id, id, round(1 / (2 - list_cosine_similarity(vector, q)), 6) AS score FROM live, asked WHERE vector IS NOT NULL AND round(1 / (2 - list_cosine_similarity(vector, q)), 6) >= 0.3"
_NOT_NOISE = f"NOT (length(t) < 5 OR {columns._any(rules.DENIALS + rules.META_QUESTIONS + rules.FRUSTRATION + rules.BOILERPLATE + rules.DIAGNOSTICS)})"
_UNIT = lambda x: f"greatest(0, least(1, {x}))"


def _spread(kept: str) -> str:
    """Hits too like a better one that was taken are deferred, as ``diversity.diversified`` does it."""
    listed = f"SELECT query_id, list([struct_pack(id := id, v := vector)] ORDER BY score DESC, id) AS l FROM ({kept}) JOIN live USING (id) GROUP BY 1"
    taken = "list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda k: list_cosine_similarity(k.v, b[1].v) > 0.85)) > 0 THEN a ELSE list_concat(a, b) END)"
    return f"SELECT k.*, NOT list_contains(list_transform(t.taken, lambda x: x.id), k.id) AS deferred FROM ({kept}) k JOIN (SELECT query_id, {taken} AS taken FROM ({listed})) t USING (query_id)"


def _finish(hits: str, limit: int = 5, spread: bool = False) -> str:
    """Scores, filters, with ``spread`` the diversity step, and the limit."""
    s1 = f"SELECT query_id, l.*, {_UNIT(f'h.score + 0.1 * exp(-(({NOW} - timestamp) / {memories.DAY}.0::DOUBLE) / 14)')} AS s FROM ({hits}) h JOIN live l USING (id)"
    s2 = f"SELECT *, {_UNIT('s * (0.7 + 0.3 * importance)')} AS s2 FROM ({s1})"
    s3 = f"SELECT *, greatest(s2 * 0.3, {_UNIT('s2 / (1 + 0.5 * log2(greatest(length(text) / 500.0::DOUBLE, 1)))')}) AS s3 FROM ({s2})"
    s4 = f"SELECT query_id, id, text, round(greatest(s3 * 0.5, {_UNIT(f'''s3 * (0.5 + 0.5 * exp(-(({NOW} - timestamp) / {memories.DAY}.0::DOUBLE) / {columns._HALF}))''')}), 6) AS score FROM ({s3})"
    kept = f"SELECT query_id, id, score FROM (SELECT *, regexp_replace(text, {memories.TRIM}) AS t FROM ({s4})) WHERE score >= 0.35 AND {_NOT_NOISE}"
    best = _ranked(_spread(kept), limit, "deferred, score DESC, id") if spread else _ranked(kept, limit)
    return f"SELECT query_id, id, score, rank::INTEGER AS position FROM ({best})"


_ALIVE = "SELECT h.* FROM ({h}) h JOIN live USING (id) WHERE NOT coalesce(valid_until <= %d, false)" % NOW
_EVENTS = "AND CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 6 = 1 THEN false ELSE category = 'decision' END"


def _hybrid(category: str = "") -> str:
    own = f"JOIN (SELECT id FROM live WHERE true {category}) USING (id)"
    v = _ranked(f"SELECT query_id, id, score FROM ({_ranked(_VEC, 20)}) {own}", 20)
    b = _ranked(f"SELECT query_id, id, score FROM ({_ranked(_lexical('SELECT id, text FROM live', 'SELECT query_id, text FROM asked'), 20)}) {own}", 20)
    fused = f"SELECT query_id, id, score FROM ({_ranked(_FUSED.format(v=v, b=b), 40)}) WHERE score >= 0.3"
    best = _ranked(_ALIVE.format(h=fused), 10)
    return f"SELECT query_id, id, {_UNIT('0.7 * score + 0.3 * CASE WHEN vector IS NULL THEN 0 ELSE greatest(-1, least(1, list_cosine_similarity(vector, q))) END')} AS score FROM (SELECT query_id, id, score FROM ({best})) JOIN live USING (id) JOIN asked USING (query_id)"


def _recall(hits: str, also: str = "", smart: str = memories.SMART_SQL, asked: str = _ASKED, spread: bool = False) -> str:
    return f"WITH {smart}, {_LIVE.format(also=also)}, asked AS ({asked}) {_finish(hits, spread=spread)}"


M3_SQL = _recall(_hybrid())
M3S_SQL = _recall(_hybrid(_EVENTS), "AND scope IN ('src:src0', 'src:src1', 'src:src2')")
M4_SQL = _recall(_ALIVE.format(h=f"SELECT query_id, id, score FROM ({_ranked(_VEC, 20)})"), spread=True)
_TAGGED = memories.SMART_SQL + ", tagged AS (SELECT * REPLACE ('proj:p' || (doc_id % 3) || ' ' || text AS text) FROM smart)"
_M5_ASKED = "SELECT query_id, 'Proj:P' || (query_id % 3) || ' ' || coalesce(text, '') AS text, q FROM (" + _ASKED + ")"
_M5 = _ranked(_lexical("SELECT id, text FROM live", "SELECT query_id, text FROM asked"), 20)
_M5 = f"SELECT h.query_id, h.id, h.score FROM ({_M5}) h JOIN live l USING (id) JOIN asked a USING (query_id) WHERE contains(lower(l.text), 'proj:p' || (query_id % 3))"
M5_SQL = _recall(_ALIVE.format(h=_M5), smart=_TAGGED, asked=_M5_ASKED).replace("FROM smart LEFT JOIN embeddings", "FROM tagged smart LEFT JOIN embeddings")
_B6 = f"SELECT query_id, id, score FROM ({_ranked(_lexical('SELECT id, text FROM live', _ITEMS), 20)}) JOIN (SELECT id FROM live WHERE true {_EVENTS}) USING (id)"
M6_SQL = f"WITH {memories.SMART_SQL}, {_LIVE.format(also='')} SELECT query_id, id, score, rank FROM ({_ranked(_B6, 20)})"
M7_SQL = f"WITH {memories.PHRASE_SQL} SELECT id, {lines._expanded()} AS by_hand, text AS automatic FROM ph"


def _traced() -> str:
    """Hits of m3 with the score of every stage and the place of the stage that they leave at (12: none)."""
    v, b = _ranked(_VEC, 20), _ranked(_lexical("SELECT id, text FROM live", "SELECT query_id, text FROM asked"), 20)
    s1 = _UNIT(f"r + 0.1 * exp(-(({NOW} - timestamp) / {memories.DAY}.0::DOUBLE) / 14)")
    s3 = f"greatest(s2 * 0.3, {_UNIT('s2 / (1 + 0.5 * log2(greatest(length(text) / 500.0::DOUBLE, 1)))')})"
    s4 = f"round(greatest(s3 * 0.5, {_UNIT(f's3 * (0.5 + 0.5 * exp(-(({NOW} - timestamp) / {memories.DAY}.0::DOUBLE) / {columns._HALF}))')}), 6)"
    return f"""h1 AS (SELECT query_id, live.*, h.score AS s0, CASE WHEN h.score < 0.3 THEN 0 WHEN coalesce(valid_until <= {NOW}, false) THEN 1 END AS g FROM ({_ranked(_FUSED.format(v=v, b=b), 40)}) h JOIN live USING (id)),
h2 AS (SELECT * REPLACE (CASE WHEN g IS NULL AND row_number() OVER (PARTITION BY query_id, g IS NULL ORDER BY s0 DESC, id) > 10 THEN 2 ELSE g END AS g) FROM h1),
h3 AS (SELECT h2.*, {_UNIT('0.7 * s0 + 0.3 * CASE WHEN vector IS NULL THEN 0 ELSE greatest(-1, least(1, list_cosine_similarity(vector, q))) END')} AS r FROM h2 JOIN asked USING (query_id)),
h4 AS (SELECT *, {s1} AS s1 FROM h3), h5 AS (SELECT *, {_UNIT('s1 * (0.7 + 0.3 * importance)')} AS s2 FROM h4), h6 AS (SELECT *, {s3} AS s3 FROM h5), h7 AS (SELECT *, {s4} AS s4, regexp_replace(text, {memories.TRIM}) AS t FROM h6),
h8 AS (SELECT * REPLACE (CASE WHEN g IS NOT NULL THEN g WHEN s4 < 0.35 THEN 8 WHEN NOT ({_NOT_NOISE}) THEN 9 END AS g) FROM h7),
h9 AS (SELECT * REPLACE (CASE WHEN g IS NULL AND row_number() OVER (PARTITION BY query_id, g IS NULL ORDER BY s4 DESC, id) > 5 THEN 11 ELSE coalesce(g, 12) END AS g) FROM h8),
st(place, stage) AS (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(recall.STAGES))}),
tr AS (SELECT query_id, place, stage, count(*) AS input_count, count_if(g > place) AS output_count, coalesce(string_agg(id, ',' ORDER BY id) FILTER (g = place), '') AS dropped, round(min(x) FILTER (g > place), 6) AS least, round(max(x) FILTER (g > place), 6) AS most
  FROM (SELECT h9.query_id, id, g, place, stage, CASE WHEN place < 3 THEN s0 WHEN place = 3 THEN r WHEN place = 4 THEN s1 WHEN place = 5 THEN s2 WHEN place = 6 THEN s3 ELSE s4 END AS x FROM h9, st WHERE g >= place) GROUP BY 1, 2, 3)"""


_TRACE = f"WITH {memories.SMART_SQL}, {_LIVE.format(also='')}, asked AS ({_ASKED}), {_traced()}"
M2_SQL = f"{_TRACE} SELECT query_id, stage, input_count, output_count, dropped, least, most FROM tr"
L13_SQL = f"{_TRACE} SELECT query_id, id, round(r, 4) AS reranked, round(s1, 4) AS recent, round(s2, 4) AS weighted, round(s3, 4) AS normed, s4 AS score, stage AS left_at FROM h9 LEFT JOIN st ON place = g"
D6_SQL = rf"""WITH {memories.SMART_SQL}, {_LIVE.format(also='')}, asked AS ({_ASKED}), hit AS (SELECT a.query_id, l.id, l.text, l.scope FROM asked a JOIN live l ON a.query_id = l.doc_id),
w AS (SELECT id, scope, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM live), z AS (SELECT scope, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY 1),
p AS (SELECT id, scope, n, term, count(*) AS tf FROM (SELECT id, scope, len(w) AS n, unnest(w) AS term FROM w) GROUP BY 1, 2, 3, 4), df AS (SELECT scope, term, count(*) AS df FROM p GROUP BY 1, 2),
q AS (SELECT DISTINCT query_id, id, scope, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM hit),
s AS (SELECT query_id, q.id, p.id AS neighbor, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS raw FROM q JOIN p ON p.scope = q.scope AND p.term = q.term JOIN df ON df.scope = p.scope AND df.term = p.term JOIN z ON z.scope = p.scope GROUP BY 1, 2, 3),
t AS (SELECT *, round(CASE WHEN raw > 0 THEN 1 / (1 + exp(-raw / 5)) ELSE 0.5 END, 6) AS score FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, neighbor) AS r FROM t),
v AS (SELECT u.*, regexp_replace(w.text, {memories.TRIM}) AS t FROM u JOIN w ON w.id = neighbor WHERE r <= 50 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = u.query_id AND h.id = neighbor))
SELECT query_id, id, neighbor, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, neighbor)::INTEGER AS position FROM v WHERE {_NOT_NOISE}) WHERE position <= 2"""
E3_SQL = f"{_TRACE} SELECT query_id, stage, input_count AS before, output_count AS after, input_count - output_count AS dropped, row_number() OVER (PARTITION BY query_id ORDER BY input_count - output_count DESC, place)::INTEGER AS nth FROM tr WHERE input_count > output_count"
_ALL = {
    "d1_vector_search": D1_SQL, "d2_lexical_search": D2_SQL, "d3_lexical_fallback": D3_SQL, "d4_hybrid_fusion": D4_SQL,
    "d5_ghosts": f"SELECT query_id, id, score, rank FROM ({D2_SQL}) WHERE id % 2 = 1",
    "h1_id_union": f"SELECT query_id, id FROM ({D1_SQL}) UNION SELECT query_id, id FROM ({_B4})",
    "m2_retrieval_trace": M2_SQL, "e3_drop_summary": E3_SQL, "l13_explain_rank": L13_SQL, "d6_neighbors": D6_SQL, "m3_hybrid_recall": M3_SQL, "m3_scoped_recall": M3S_SQL, "m4_vector_recall": M4_SQL, "m5_tagged_recall": M5_SQL, "m6_lexical_arm": M6_SQL, "m7_expanded_query": M7_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (m1_retrieve, m2_retrieval_trace, m13_trace_summary, e3_drop_summary, l13_explain_rank, d1_vector_search, d2_lexical_search, d3_lexical_fallback, d4_hybrid_fusion, d5_ghosts, d6_neighbors, h1_id_union, m3_hybrid_recall, m3_scoped_recall, m4_vector_recall, m5_tagged_recall, m6_lexical_arm, m7_expanded_query)
    return {f.__name__: f for f in own} | columns.queries() | lines.queries() | tools.queries() | documents.queries() | relations.queries() | upkeep.queries() | store_tools.queries()


def oracle_sql() -> dict[str, str]:
    return _ALL | columns.oracle_sql() | lines.oracle_sql() | tools.oracle_sql() | documents.oracle_sql() | relations.oracle_sql() | upkeep.oracle_sql() | store_tools.oracle_sql()
