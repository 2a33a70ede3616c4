"""Queries of many rows: the store, statistics, facts, windows and selections, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import rules, scoring
from engramic.operators import analytics, diversity, store
from engramic.plans import columns
from engramic.plans.memories import ACTIVE_SQL, BASE, DAY, HOUR, MEM_SQL, NOW, PHRASE_SQL, SMART_SQL, memories, phrases, smart, table
from engramic.functions.metadata import active_at
from engramic.streaming import access

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
EARLY = BASE + 10 * DAY


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_BRIEF = ("id", "scope", "category", "importance", "timestamp")
_B = ", ".join(_BRIEF)


@query(f"WITH {MEM_SQL} SELECT {_B} FROM mem WHERE scope IN ('src:src1', 'src:src2') AND category IN ('fact', 'decision') ORDER BY timestamp DESC, id LIMIT 20 OFFSET 5")
def a4_list(spark, sf_dir):
    return store.listed(memories(spark, sf_dir), ["src:src1", "src:src2"], ["fact", "decision"], 20, 5).select(*_BRIEF)


@query(f"WITH {MEM_SQL} SELECT {_B} FROM mem WHERE timestamp < {NOW} ORDER BY timestamp DESC, id LIMIT 200")
def a6_compaction_scan(spark, sf_dir):
    return store.listed(memories(spark, sf_dir).where(F.col("timestamp") < NOW), None, None, 200).select(*_BRIEF)


@query(f"WITH {MEM_SQL} SELECT {_B} FROM mem WHERE id = 'doc:17' AND scope IN ('src:src17', 'src:src0')")
def a7_point_get(spark, sf_dir):
    return store.scoped(memories(spark, sf_dir).where(F.col("id") == "doc:17"), ["src:src17", "src:src0"]).select(*_BRIEF)


@query(f"WITH {MEM_SQL} SELECT {_B} FROM mem WHERE id LIKE 'doc:12%'")
def a8_prefix_lookup(spark, sf_dir):
    return store.by_prefix(memories(spark, sf_dir), "doc:12").select(*_BRIEF)


def _new_rows(spark, sf_dir):
    """Every third row again, some with blank scope or text."""
    rows = memories(spark, sf_dir).where(F.col("doc_id") % 3 == 0)
    scope = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "scope")).otherwise(F.lit("\t "))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return rows.withColumns({"scope": scope, "text": text, "id": F.concat(F.lit("new:"), "doc_id"), "importance": F.col("importance") * 2})


_NEW = f"""{MEM_SQL}, nw AS (SELECT 'new:' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, category,
  CASE WHEN doc_id % 2 = 0 THEN scope ELSE '' END AS scope, least(1, importance * 2) AS importance, timestamp FROM mem WHERE doc_id % 3 = 0)"""


@query(f"WITH {_NEW} SELECT {_B} FROM mem UNION ALL SELECT {_B} FROM nw WHERE text <> '' AND scope <> ''")
def a13_bulk_append(spark, sf_dir):
    return store.appended(memories(spark, sf_dir), _new_rows(spark, sf_dir))[0].select(*_BRIEF)


@query(f"WITH {_NEW} SELECT id, CASE WHEN text = '' THEN 'empty text' ELSE 'blank scope' END AS reason FROM nw WHERE text = '' OR scope = ''")
def a13_rejected_rows(spark, sf_dir):
    return store.appended(memories(spark, sf_dir), _new_rows(spark, sf_dir))[1].select("id", "reason")


@query(f"WITH {MEM_SQL} SELECT id, scope, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE category END AS category, CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE importance END AS importance, timestamp FROM mem")
def a16_upsert(spark, sf_dir):
    rows = memories(spark, sf_dir)
    new = rows.where(F.col("doc_id") % 4 == 0).withColumns({"category": F.lit("other"), "importance": F.lit(1.0)})
    return store.upserted(rows, new).select(*_BRIEF)


@query(f"WITH {MEM_SQL} SELECT {_B} FROM mem WHERE NOT coalesce(scope IN ('src:src1', 'src:src3') AND timestamp < {EARLY}, false)")
def a20_bulk_delete(spark, sf_dir):
    return store.deleted(memories(spark, sf_dir), ["src:src1", "src:src3"], EARLY).select(*_BRIEF)


@query(f"WITH {MEM_SQL} SELECT id, scope, category, CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE importance END AS importance, timestamp FROM mem")
def a22_bulk_update(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return store.updated(rows, rows.where(F.col("doc_id") % 10 == 0).select("id", F.lit(0.5).alias("importance")), ["importance"]).select(*_BRIEF)


@query("SELECT user_id AS id, count(*) AS accesses, max(epoch_us(ts)) AS last_at FROM events GROUP BY 1")
def e13_access_coalescing(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return store.access_merged(events.select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


@query(f"WITH {MEM_SQL} SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'global' ELSE scope END AS scope FROM mem")
def a33_scope_repair(spark, sf_dir):
    blank = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.col("scope"))
    return store.scope_repaired(memories(spark, sf_dir).withColumn("scope", blank), "global").select("id", "scope")


@query(f"""WITH {MEM_SQL}, k AS (SELECT coalesce(scope, 'global') AS scope, category FROM mem)
SELECT 'scope' AS kind, scope AS key, count(*) AS rows FROM k GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM k""")
def e1_store_stats(spark, sf_dir):
    return analytics.scope_category_counts(memories(spark, sf_dir))


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def e2_retrieval_stats(spark, sf_dir):
    return analytics.latency_stats(table(spark, sf_dir, "events"), "event_type", "value")


@query(r"""WITH r AS (SELECT event_id AS seq, 'Rejected ' || event_type || ' at ' || (event_id % 10)::VARCHAR || '.5 of ' || (event_id % 3)::VARCHAR AS reason FROM events)
SELECT regexp_replace(lower(reason), '\d+(?:\.\d+)?', '#', 'g') AS reason_key, min_by(reason, seq) AS label, count(*) AS rejections FROM r GROUP BY 1 ORDER BY rejections DESC, label LIMIT 5""")
def e4_rejection_reasons(spark, sf_dir):
    parts = [F.lit("Rejected "), "event_type", F.lit(" at "), (F.col("event_id") % 10).cast("string"), F.lit(".5 of "), (F.col("event_id") % 3).cast("string")]
    return analytics.rejection_reasons(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(*parts).alias("reason")))


@query(f"""WITH {MEM_SQL}, s(w, ms) AS (VALUES ('last24h', {DAY}), ('last7d', {7 * DAY}))
SELECT w AS "window", count_if(importance >= 0.7) AS admitted, count_if(importance < 0.7) AS rejected, round(count_if(importance < 0.7) / count(*), 6) AS reject_rate
FROM mem, s WHERE timestamp >= {BASE + 20 * DAY} - ms GROUP BY 1""")
def e5_admission_windows(spark, sf_dir):
    rows = memories(spark, sf_dir).select(F.col("timestamp").alias("at"), "importance")
    return analytics.window_counts(rows.where("importance >= 0.7"), rows.where("importance < 0.7"), BASE + 20 * DAY, {"last24h": DAY, "last7d": 7 * DAY})


_LINES = f"""{MEM_SQL}, ln AS (
  SELECT category AS kind, CASE WHEN doc_id % 2 = 0 THEN 'Line  ' ELSE 'line ' END || (doc_id % 23) AS line, timestamp, importance FROM mem)"""


@query(f"""WITH {_LINES}, g AS (
  SELECT kind, regexp_replace(lower(line), '\\s+', ' ', 'g') AS key, round(sum(1 / (1 + exp(0.25 * (greatest(0, ({NOW} - timestamp) / {DAY}.0::DOUBLE) - 45))) * importance * 0.8), 6) AS score,
    max(timestamp) AS newest, max_by(line, timestamp) AS line FROM ln GROUP BY 1, 2
), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, newest DESC, line) AS rank FROM g)
SELECT kind, line, score, rank FROM n WHERE rank <= 10""")
def e8_reflection_ranking(spark, sf_dir):
    line = F.concat(F.when(F.col("doc_id") % 2 == 0, "Line  ").otherwise("line "), (F.col("doc_id") % 23).cast("string"))
    lines = memories(spark, sf_dir).select(F.col("category").alias("kind"), line.alias("line"), "timestamp", F.lit(45.0).alias("midpoint"), F.lit(0.25).alias("k"), F.col("importance").alias("weight"), F.lit(0.8).alias("quality"), F.lit(False).alias("fallback"))
    return analytics.ranked_lines(lines, F.lit(NOW))


_WORDS = r"list_distinct(list_filter(list_transform(regexp_extract_all(lower(l0 || ' ' || text), '[\p{L}\p{N}_-]{4,}'), lambda w: regexp_replace(w, '^[-_]+|[-_]+$', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "], w)))"


@query(f"""WITH {SMART_SQL}, w AS (SELECT unnest({_WORDS}) AS key FROM smart),
a AS (SELECT 'term' AS kind, key, count(*) AS rows FROM w GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM smart GROUP BY 2 UNION ALL SELECT 'memory_category', memory_category, count(*) FROM smart GROUP BY 2)
SELECT kind, key, rows, round(rows / (SELECT count(*) FROM smart), 6) AS strength FROM a WHERE rows >= 2 AND round(rows / (SELECT count(*) FROM smart), 6) >= 0.2 ORDER BY CASE kind WHEN 'category' THEN 0 WHEN 'memory_category' THEN 1 ELSE 2 END, rows DESC, key LIMIT 6""")
def e10_pattern_mining(spark, sf_dir):
    return analytics.patterns(smart(spark, sf_dir), 0.2)


@query(rf"""WITH {SMART_SQL}
SELECT sha256(memory_category || ':' || lower(regexp_replace(l0, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))) AS key, max_by(id, timestamp) AS id, count(*) AS copies FROM smart GROUP BY 1""")
def e11_exact_compaction(spark, sf_dir):
    return analytics.compacted(smart(spark, sf_dir))


@query(f"WITH {SMART_SQL} SELECT category, count(*) AS rows, count_if(NOT (doc_id % 6 = 1 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0) AND coalesce(row_type, '') NOT LIKE 'memory-reflection%') AS legacy FROM smart GROUP BY 1")
def e12_legacy_counts(spark, sf_dir):
    return analytics.legacy_counts(smart(spark, sf_dir))


@query("WITH p AS (SELECT label AS key, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) SELECT key, pos::INTEGER AS pos, round(avg(x), 6) AS value FROM p GROUP BY 1, 2")
def e15_mean_pooling(spark, sf_dir):
    return analytics.mean_pooled(table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("embedding").alias("vector")))


_T = "coalesce(text, '')"
_ANYWHERE, _FIRST = [p for p in rules.CORRECTIONS if not p.startswith("^")], [p for p in rules.CORRECTIONS if p.startswith("^")]


_EITHER = lambda p: f"max(({columns._any(p, 'text')} OR {columns._any(p, 'seam')})::INT)"


@query(f"""WITH t AS (SELECT conv_id, turn, {_T} AS text FROM conversations), s AS (SELECT *, coalesce(string_split(text, chr(10))[-1] || ' ' || string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), chr(10))[1], '') AS seam FROM t)
SELECT conv_id, round(least(1, 0.5 * {_EITHER(rules.REMEMBER)} + 0.4 * {_EITHER(rules.TOOL_CALLS)}
  + 0.3 * greatest({_EITHER(_ANYWHERE)}, min_by({columns._any(_FIRST, "(CASE WHEN contains(text, chr(10)) OR seam = '' THEN text ELSE seam END)")}::INT, turn), {_EITHER(rules.DECISIONS)})
  + CASE WHEN sum(CASE WHEN length(trim(text)) > 20 THEN length(text) ELSE 0 END) > 200 THEN 0.2 ELSE 0 END + CASE WHEN count(*) > 6 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS value
  FROM s GROUP BY 1""")
def e16_conversation_value(spark, sf_dir):
    return analytics.conversation_value(table(spark, sf_dir, "conversations"))


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer:"), "o_custkey").alias("fact_key"), F.col("o_orderkey").cast("string").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("valid_from")
    )


_FACTS = "f AS (SELECT 'customer:' || o_custkey AS fact_key, o_orderkey::VARCHAR AS id, epoch_us(o_orderdate) AS valid_from FROM orders)"


@query(f"WITH {_FACTS} SELECT fact_key, id, valid_from, lead(valid_from) OVER w AS invalidated_at, lead(id) OVER w AS superseded_by FROM f WINDOW w AS (PARTITION BY fact_key ORDER BY valid_from, id)")
def f9_version_chain(spark, sf_dir):
    return analytics.fact_versions(_facts(spark, sf_dir))


@query(f"""WITH {_FACTS}, q AS (SELECT 'customer:' || c_custkey AS fact_key, (epoch_us(TIMESTAMP '1995-01-01') + c_custkey * 86400000000)::BIGINT AS at_ms FROM customer)
SELECT q.fact_key, q.at_ms, (SELECT max_by(id, (valid_from, id)) FROM f WHERE f.fact_key = q.fact_key AND valid_from <= q.at_ms) AS id FROM q""")
def d7_facts_as_of(spark, sf_dir):
    at = F.lit(788_918_400_000_000) + F.col("c_custkey") * 86_400_000_000
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("fact_key"), at.alias("at_ms"))
    return analytics.facts_as_of(_facts(spark, sf_dir), asked)


@query(f"WITH {SMART_SQL} SELECT fact_key, id, memory_category FROM smart WHERE {ACTIVE_SQL} AND fact_key LIKE 'preferences:editor%'")
def d8_active_fact_keys(spark, sf_dir):
    rows = smart(spark, sf_dir).where(active_at(F.lit(NOW)) & F.col("meta.fact_key").startswith("preferences:editor"))
    return rows.select(F.col("meta.fact_key").alias("fact_key"), "id", F.col("meta.memory_category").alias("memory_category"))


@query("SELECT conv_id, turn, kept FROM (SELECT conv_id, turn, least(n, 500 - (upto - n))::INTEGER AS kept, upto - n AS before FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations))) WHERE before < 500")
def f2_char_budget(spark, sf_dir):
    return analytics.char_budget(table(spark, sf_dir, "conversations"), 500)


@query("SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 6")
def f3_recent_turns(spark, sf_dir):
    return analytics.newest_turns(table(spark, sf_dir, "conversations"), 6)


@query("SELECT event_id, user_id, recent, recent > 2 AS limited FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events)")
def f5_rate_limit(spark, sf_dir):
    return analytics.rate_limited(table(spark, sf_dir, "events"), 2).select("event_id", "user_id", "recent", "limited")


@query(f"WITH {SMART_SQL}, c AS (SELECT id, round({columns._TOTAL}, 6) AS composite FROM smart) SELECT * FROM c WHERE composite < 0.3")
def g5_stale_rows(spark, sf_dir):
    return smart(spark, sf_dir).select("id", F.round(columns.Row().total, 6).alias("composite")).where(F.col("composite") < scoring.STALE_BELOW)


@query(f"""WITH {SMART_SQL} SELECT id, round({columns._DEEP}, 6) AS score FROM smart WHERE tier <> 'core' AND layer <> 'durable' AND access_count >= 3 AND round({columns._DEEP}, 6) >= 0.6
ORDER BY timestamp DESC, id LIMIT 10""")
def g11_deep_promotion(spark, sf_dir):
    meta = F.col("meta")
    score = F.round(scoring.deep_score(F.col("importance"), meta["confidence"], meta["access_count"], F.col("timestamp"), F.lit(NOW)), 6)
    able = smart(spark, sf_dir).where((meta["tier"] != "core") & (meta["layer"] != "durable") & (meta["access_count"] >= 3)).withColumn("score", score)
    return able.where(F.col("score") >= 0.6).orderBy(F.desc("timestamp"), "id").limit(10).select("id", "score")


@query(f"WITH {PHRASE_SQL} SELECT id FROM ph WHERE length(t) < 5 OR {columns._any(rules.DENIALS + rules.META_QUESTIONS + rules.FRUSTRATION + rules.BOILERPLATE + rules.DIAGNOSTICS)}")
def m11_dropped_by_noise(spark, sf_dir):
    rows = phrases(spark, sf_dir)
    return analytics.dropped_between(rows, rows.where(~rules.is_noise(F.col("text"))))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS events FROM s GROUP BY user_id, n""")
def j2_session_flush(spark, sf_dir):
    return access.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query()
def g1_mmr_diversity(spark, sf_dir):
    from engramic.plans import catalog  # the search whose hits are reordered

    hits = catalog.d1_vector_search(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return diversity.diversified(hits.join(vectors, "id"), 0.3)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
