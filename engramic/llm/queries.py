"""The registered query of each operator, over its whole table, and DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat, decontamination, exact_dedup, langid, near_dedup, packing, periodic_runs, pii, sharding, spelling, toxicity, url_filter
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer()).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), key="surrogates-1").select("doc_id", "text", "n_entities")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), spelling.planted)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer(), keep_ids=False).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_chat_formatting, op4_minhash_near_dedup, op5_packing, op6_toxicity, op7_pii_surrogates, op8_url_filters, op9_exact_dedup, op10_language_id, op11_periodic_runs, op12_spelling_variants, op13_best_fit_packing)}


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations
), p AS (
  SELECT conv_id, pos, max(pos) OVER (PARTITION BY conv_id) AS n,
         string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|')
           OVER (PARTITION BY conv_id ORDER BY pos) AS body FROM t
), f AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, n, body FROM p WHERE pos = n GROUP BY n, body),
m AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = f.n AND p.body = f.body))
SELECT m.conv_id, m.n AS n_turns, m.copies,
       string_agg('<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY m.conv_id, m.n, m.copies
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), g AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id JOIN r ON r.g = a.g GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT c.doc_id, u.b FROM c JOIN u ON u.a = c.r)
SELECT n.doc_id, n.n AS n_shingles, m.m AS component_id, n.doc_id = m.m AS kept
FROM n JOIN (SELECT doc_id, min(r) AS m FROM c GROUP BY doc_id) m USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op8_url_filters": url_filter.SQL, "op9_exact_dedup": OP9_SQL}
