"""Queries of the tools' writes, of parsers of what rows hold, and of exports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import identity, metadata, rules
from engramic.operators import reflections, writes
from engramic.plans import columns
from engramic.plans.memories import ACTIVE_SQL, MEM_SQL, NOW, SMART_SQL, TRIM, memories, smart, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_PARTS = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
_SHA = lambda x: " || '-' || ".join(f"substr(sha256({x}), {a}, {n})" for a, n in _PARTS)
_ID = _SHA("doc_id::VARCHAR")
_FIELD = lambda f: f"json_extract_string(CASE WHEN json_valid(metadata) THEN metadata::JSON ELSE '{{}}'::JSON END, '$.{f}')"


def _named(rows: DataFrame) -> DataFrame:
    """Rows with ids of the form that the tools take."""
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    return rows.withColumn("id", F.concat_ws("-", *[F.substring(digest, a, n) for a, n in _PARTS]))


def _field(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}").alias(name)


# --- building and reading metadata
_PATCH = {
    "l0_abstract": ("CASE doc_id % 4 WHEN 0 THEN '  new ' || doc_id WHEN 1 THEN ' ' END", "CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE l0 END"),
    "tier": ("CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'none' END", "CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'working' ELSE tier END"),
    "access_count": ("CASE doc_id % 3 WHEN 0 THEN '7.9' WHEN 1 THEN '-1' END", "CASE WHEN doc_id % 3 = 0 THEN 7 ELSE access_count END"),
    "confidence": ("CASE doc_id % 3 WHEN 0 THEN '2' WHEN 1 THEN 'x' END", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE confidence END"),
    "invalidated_at": (f"CASE doc_id % 5 WHEN 0 THEN '{NOW}' WHEN 1 THEN '5' WHEN 2 THEN '0' END", f"CASE doc_id % 5 WHEN 0 THEN CASE WHEN {NOW} >= valid_from THEN {NOW} END WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE invalidated_at END"),
    "suppressed_until_ms": ("CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '-3' WHEN 2 THEN '12.5' END", "CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 12 ELSE suppressed_until_ms END"),
    "state": ("CASE doc_id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'odd' END", "CASE doc_id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'confirmed' ELSE state END"),
    "source": ("CASE doc_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'odd' END", "CASE doc_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'legacy' ELSE source END"),
    "memory_temporal_type": ("CASE doc_id % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'odd' END", "CASE doc_id % 4 WHEN 0 THEN 'static' WHEN 1 THEN NULL ELSE temporal_type END"),
    "custom": ("CASE WHEN doc_id % 2 = 0 THEN 'kept' END", "CASE WHEN doc_id % 2 = 0 THEN 'kept' END"),
}


@query(f"WITH {SMART_SQL} SELECT id, {', '.join(f'{sql}::{kind} AS {f}' for (f, (_, sql)), kind in zip(_PATCH.items(), ['VARCHAR', 'VARCHAR', 'BIGINT', 'DOUBLE', 'BIGINT', 'BIGINT', 'VARCHAR', 'VARCHAR', 'VARCHAR', 'VARCHAR'], strict=True))}, {_FIELD('type')} AS type FROM smart")
def b5_built_metadata(spark, sf_dir):
    """Rows with patches of usable, unusable and missing values."""
    rows = smart(spark, sf_dir)
    patch = {f: F.expr(raw) for f, (raw, _) in _PATCH.items()}
    new = rows.withColumn("metadata", metadata.built(F.col("metadata"), F.col("meta"), patch, F.col("timestamp")))
    kinds = {"access_count": "long", "confidence": "double", "invalidated_at": "long", "suppressed_until_ms": "long"}
    return new.select("id", *[_field(f).cast(kinds.get(f, "string")).alias(f) for f in [*_PATCH, "type"]])


_SUPPORT = "CASE doc_id % 4 WHEN 0 THEN '{\"confirmations\": ' || (doc_id % 5) || ', \"contradictions\": ' || (doc_id % 3) || '}' WHEN 1 THEN '{\"global_strength\": 0.8, \"total_observations\": 5, \"slices\": [{\"context\": \"work\", \"confirmations\": ' || (doc_id % 7) || ', \"contradictions\": -1, \"strength\": 3}, {\"confirmations\": 2}]}' WHEN 2 THEN 'no json' END"


@query(f"""WITH s AS (SELECT doc_id, doc_id % 5 AS y, doc_id % 3 AS n FROM documents)
SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 AND y + n > 0 THEN y / (y + n)::DOUBLE WHEN doc_id % 4 = 1 THEN 0.8 ELSE 0.5 END, 6) AS strength, (CASE WHEN doc_id % 4 = 0 THEN y + n WHEN doc_id % 4 = 1 THEN 5 ELSE 0 END)::BIGINT AS total,
CASE WHEN doc_id % 4 = 0 AND y + n > 0 THEN 'general:' || y || ':' || n WHEN doc_id % 4 = 1 THEN 'work:' || (doc_id % 7) || ':0' ELSE '' END AS slices FROM s""")
def b15_support_info(spark, sf_dir):
    """Support in the flat form, by contexts, unreadable and missing."""
    got = metadata.support_info(F.expr(_SUPPORT), F.lit(NOW))
    rows = table(spark, sf_dir, "documents").select("doc_id", got.alias("s"))
    return rows.select("doc_id", F.round("s.global_strength", 6).alias("strength"), F.col("s.total_observations").alias("total"), F.array_join(F.transform("s.slices", lambda x: F.concat_ws(":", x.context, x.confirmations, x.contradictions)), ",").alias("slices"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE len(embedding) END::INTEGER AS n, round(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE list_sum(embedding::DOUBLE[]) END, 4) AS total FROM embeddings""")
def i65_number_vector(spark, sf_dir):
    """Vectors read from text, every fifth with a word among its numbers."""
    raw = F.transform("embedding", lambda x: x.cast("string"))
    read = metadata.number_vector(F.when(F.col("vec_id") % 5 == 0, F.concat(raw, F.array(F.lit("NaN")))).otherwise(raw))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", read.alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- writes
@query(f"""WITH {MEM_SQL}, n AS (SELECT doc_id AS seq, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ok' ELSE text END AS text, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' ' || scope END AS scope, doc_id FROM mem),
o AS (SELECT *, regexp_replace(text, {TRIM}) AS t FROM n), q AS (SELECT *, CASE WHEN doc_id % 4 IN (0, 1) THEN 'no scope' WHEN t = '' THEN 'empty' WHEN length(t) < 5 OR {columns._any(rules.DENIALS + rules.META_QUESTIONS + rules.FRUSTRATION + rules.BOILERPLATE + rules.DIAGNOSTICS)} THEN 'noise' WHEN doc_id % 7 = 0 THEN 'wrong vector' ELSE 'stored' END AS outcome FROM o)
SELECT seq, CASE WHEN outcome = 'stored' THEN {_SHA("text || chr(31) || scope || chr(31) || seq")} END AS id, outcome FROM q""")
def a12_store(spark, sf_dir):
    """New rows of the store tool: some without a scope, empty, noise, or with a wrong vector."""
    rows = memories(spark, sf_dir).withColumn("vector", F.array().cast("array<double>"))
    n = F.col("doc_id")
    new = rows.select(n.alias("seq"), F.when(n % 6 == 0, "").when(n % 6 == 1, "ok").otherwise(F.col("text")).alias("text"), F.when(n % 7 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vector"), "category", F.when(n % 4 == 0, " ").when(n % 4 == 1, None).otherwise(F.concat(F.lit(" "), "scope")).alias("scope"), "importance", F.lit(None).cast("string").alias("metadata"))
    return writes.stored(rows, new, NOW, 2)[1]


@query(f"""WITH {MEM_SQL}, n AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'old:' || doc_id END AS new_id, doc_id % 6 AS old, doc_id % 4 AS k FROM mem WHERE doc_id % 2 = 0)
SELECT id, scope, round(importance, 6) AS importance, timestamp FROM mem UNION ALL
SELECT new_id, scope, round(CASE old WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 WHEN 3 THEN 0.6 WHEN 4 THEN 0.8 WHEN 5 THEN 0.95 ELSE 0 END, 6), timestamp // 1000 * 1000 FROM n WHERE new_id <> '' AND doc_id % 5 <> 0 AND doc_id % 8 <> 4""")
def a17_import(spark, sf_dir):
    """Rows of an old store with a scale of 1 to 5 and times in seconds; some without id, vector or scope."""
    rows = memories(spark, sf_dir).withColumn("vector", F.array(F.lit(0.0)))
    n = F.col("doc_id")
    new = rows.where("doc_id % 2 = 0").withColumns({"id": F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("old:"), n)), "importance": n % 6, "timestamp": F.floor(F.col("timestamp") / 1000), "vector": F.when(n % 5 == 0, None).otherwise(F.col("vector")), "scope": F.when(n % 8 == 4, " ").otherwise(F.col("scope"))})
    return writes.imported(rows, new, 1, legacy=True)[0].select("id", "scope", F.round("importance", 6).alias("importance"), "timestamp")


_ASKS = f"CASE doc_id % 5 WHEN 0 THEN {_ID} WHEN 1 THEN substr(sha256(doc_id::VARCHAR), 1, 8) WHEN 2 THEN 'not an id' WHEN 3 THEN {_SHA("'gone' || doc_id")} ELSE substr(sha256((doc_id - 4)::VARCHAR), 1, 8) END"


def _asks() -> Column:
    sha = lambda x: F.sha2(x, 256)
    whole = lambda x: F.concat_ws("-", *[F.substring(sha(x), a, n) for a, n in _PARTS])
    n = F.col("doc_id")
    return F.when(n % 5 == 0, whole(n.cast("string"))).when(n % 5 == 1, F.substring(sha(n.cast("string")), 1, 8)).when(n % 5 == 2, "not an id").when(n % 5 == 3, whole(F.concat(F.lit("gone"), n))).otherwise(F.substring(sha((n - 4).cast("string")), 1, 8))


_NAMED_SQL = "h AS (SELECT seq, r.id, any_value(r.doc_id) AS doc_id, count(m.id) AS n, min(m.id) AS target, min(m.scope) AS scope FROM r LEFT JOIN m ON r.doc_id % 5 <> 2 AND substr(m.id, 1, 8) = substr(r.id, 1, 8) AND starts_with(m.id, r.id) GROUP BY 1, 2),"
_RESOLVED_SQL = f"""WITH {SMART_SQL}, m AS (SELECT * REPLACE ({_ID} AS id) FROM smart), r AS (SELECT doc_id AS seq, {_ASKS} AS id, doc_id FROM smart),
h AS (SELECT seq, r.id, r.doc_id, m.id AS target, m.scope FROM r LEFT JOIN m ON r.doc_id % 5 IN (0, 1, 4) AND m.doc_id = CASE WHEN r.doc_id % 5 = 4 THEN r.doc_id - 4 ELSE r.doc_id END),
p AS (SELECT seq, id, doc_id, CASE WHEN doc_id % 5 = 2 THEN 'invalid' WHEN target IS NULL THEN 'missing' WHEN scope = 'src:src3' THEN 'forbidden' @more END AS problem, target FROM h),
o AS (SELECT seq, id, doc_id, CASE WHEN problem IS NULL OR problem = 'unchanged' THEN target END AS target, CASE WHEN problem IS NOT NULL THEN problem WHEN row_number() OVER (PARTITION BY CASE WHEN problem IS NULL OR problem = 'unchanged' THEN target END ORDER BY seq) > 1 THEN 'superfluous' ELSE '@done' END AS outcome FROM p)"""


def _resolved_sql(more: str, done: str) -> str:
    return _RESOLVED_SQL.replace("@more", more).replace("@done", done)


def _scopes() -> list[str]:
    return [f"src:src{i}" for i in range(1000) if i != 3]


def _named_sql(done: str) -> str:
    """As ``_resolved_sql``, where a prefix may be that of several rows."""
    start, _, rest = _resolved_sql("", done).partition("\nh AS ")
    told = "CASE WHEN doc_id % 5 = 2 THEN 'invalid' WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN scope = 'src:src3' THEN 'forbidden' END"
    return f"{start}\n{_NAMED_SQL}\np AS (SELECT seq, id, doc_id, {told} AS problem, target FROM h),\no AS {rest.partition('o AS ')[2]}"


@query(f"{_named_sql('deleted')} SELECT seq, id, target, outcome FROM o")
def a18_forget(spark, sf_dir):
    """Requests by whole ids and prefixes: two of one row, invalid ones, missing and forbidden rows."""
    rows = memories(spark, sf_dir)
    asked = rows.select(F.col("doc_id").alias("seq"), _asks().alias("id"))
    return writes.forgotten(_named(rows), asked, _scopes())[1]


@query(f"""WITH {MEM_SQL} SELECT id, CASE WHEN doc_id % 6 = 0 AND doc_id % 13 <> 0 THEN 'core' ELSE {_FIELD('tier')} END AS tier, {_FIELD('access_count')} AS access_count, {_FIELD('memory_category')} AS memory_category, doc_id % 13 = 0 AS broken FROM mem""")
def a24_transform(spark, sf_dir):
    """One key of some rows; broken metadata and all other keys stay as they are, and no key appears that was not there."""
    rows = memories(spark, sf_dir)
    patch = F.create_map(F.lit("tier"), F.when(F.col("doc_id") % 6 == 0, "core"))
    after, _ = writes.transformed(rows, rows.where("doc_id % 2 = 0").select("id", patch.alias("patch")))
    return after.select("id", _field("tier"), _field("access_count"), _field("memory_category"), (F.col("metadata") == "{bad").alias("broken"))


@query(f"""{_resolved_sql("WHEN doc_id % 20 = 15 THEN 'unchanged'", 'updated')},
u AS (SELECT o.*, m.memory_category IN ('preferences', 'entities') AND {ACTIVE_SQL.replace('valid_from', 'm.valid_from').replace('invalidated_at', 'm.invalidated_at').replace('valid_until', 'm.valid_until')} AND 'text ' || seq <> m.text AS ends FROM o LEFT JOIN m ON m.id = o.target)
SELECT seq, id, target, CASE WHEN outcome = 'updated' AND ends THEN 'superseded' ELSE outcome END AS outcome FROM u""")
def l5_update_outcomes(spark, sf_dir):
    """What becomes of new texts: in place, or as a new version of a fact in force."""
    return _revised(spark, sf_dir)[1]


def _revised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = smart(spark, sf_dir)
    n = F.col("doc_id")
    asked = rows.select(n.alias("seq"), _asks().alias("id"), F.when(n % 20 != 15, F.concat(F.lit("text "), n)).alias("text"), F.when(n % 20 != 15, F.lit(0.25)).alias("importance"), F.lit(None).cast("string").alias("category"))
    return writes.revised(_named(rows), asked, NOW, _scopes())


@query(f"""{_resolved_sql("WHEN doc_id % 20 = 15 THEN 'unchanged'", 'updated')},
u AS (SELECT o.seq, m.*, m.memory_category IN ('preferences', 'entities') AND {ACTIVE_SQL.replace('valid_from', 'm.valid_from').replace('invalidated_at', 'm.invalidated_at').replace('valid_until', 'm.valid_until')} AND 'text ' || seq <> m.text AS ends FROM o JOIN m ON m.id = o.target WHERE outcome = 'updated')
SELECT m.id, sha256(CASE WHEN u.seq IS NULL OR ends THEN m.text ELSE 'text ' || u.seq END) AS text, CASE WHEN u.seq IS NULL OR ends THEN m.importance ELSE 0.25 END AS importance, CASE WHEN ends THEN '{NOW}' WHEN u.seq IS NULL THEN {_FIELD('invalidated_at').replace('metadata', 'm.metadata')} ELSE m.invalidated_at::VARCHAR END AS invalidated_at, NULL AS supersedes FROM m LEFT JOIN u USING (id)
UNION ALL SELECT 'mem-' || substr(sha256(id || chr(31) || 'text ' || seq || chr(31) || seq), 1, 32), sha256('text ' || seq), 0.25, NULL, id FROM u WHERE ends""")
def l5_update_store(spark, sf_dir):
    """The store after the updates: rows in place, ended facts and their successors."""
    return _revised(spark, sf_dir)[0].select("id", F.sha2("text", 256).alias("text"), "importance", _field("invalidated_at"), _field("supersedes"))


# --- identity
_SAYS = "CASE doc_id % 6 WHEN 0 THEN '我叫老王' || doc_id WHEN 1 THEN '以后请叫我Kit' || doc_id WHEN 2 THEN 'name is \"Ana' || doc_id || '\"' WHEN 3 THEN '我叫Bo，以后请叫我Captain' ELSE substr(coalesce(text, ''), 1, 40) END"


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'entities' ELSE 'preferences' END AS category, {_SAYS} AS said FROM documents WHERE doc_id % 6 < 4),
v AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN '老王' || doc_id WHEN 2 THEN 'Ana' || doc_id WHEN 3 THEN 'Bo' END AS name, CASE doc_id % 6 WHEN 1 THEN 'Kit' || doc_id WHEN 3 THEN 'Captain' END AS address FROM c),
k AS (SELECT *, CASE WHEN category = 'entities' THEN name IS NOT NULL ELSE address IS NULL END AS by_name FROM v)
SELECT doc_id, CASE WHEN by_name THEN 'entities' ELSE 'preferences' END AS category, CASE WHEN by_name THEN '姓名：' || name ELSE '称呼偏好：' || address END AS abstract, CASE WHEN by_name THEN '用户当前姓名/自称为“' || name ELSE '用户希望以后被称呼为“' || address END || '”。原始表述：' || said AS content FROM k""")
def i60_identity_candidates(spark, sf_dir):
    """Candidates that state names and forms of address, of both categories."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 6 < 4").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "entities").otherwise("preferences").alias("category"), F.expr(_SAYS).alias("said"))
    return rows.select("doc_id", identity.canonical(F.col("category"), F.lit("a fact"), F.lit("- o"), F.col("said")).alias("c")).select("doc_id", "c.category", "c.abstract", "c.content")


@query(f"""WITH {SMART_SQL}, x AS (SELECT id, memory_category, CASE doc_id % 5 WHEN 0 THEN 'my timezone is UTC. ' || text WHEN 1 THEN '我叫老王 ' || text WHEN 2 THEN '请叫我老王 ' || text ELSE text END AS x FROM smart),
h AS (SELECT id, memory_category = 'profile' OR {columns._any(identity.PROFILE_HINTS, 'x')} AS p, {columns._any(identity.NAMES + identity.NAME_HINTS, 'x')} AS n, {columns._any(identity.ADDRESSES + identity.ADDRESS_HINTS, 'x')} AS a FROM x)
SELECT id, p OR n OR a AS every, n OR a AS no_profile, p OR a AS no_name, p OR n AS no_addressing FROM h""")
def c18_boundary_flags(spark, sf_dir):
    """Which rows a profile file holds, with all routes and with each of them off."""
    x = F.expr("CASE doc_id % 5 WHEN 0 THEN 'my timezone is UTC. ' || text WHEN 1 THEN '我叫老王 ' || text WHEN 2 THEN '请叫我老王 ' || text ELSE text END")
    rows = smart(spark, sf_dir)
    routes = identity.profile_routes(F.col("meta.memory_category"), F.lit(None).cast("string"), x)
    told = lambda **off: identity.kept_by(F.col("routes"), **off)
    return rows.select("id", routes.alias("routes")).select("id", told().alias("every"), told(profile=False).alias("no_profile"), told(name=False).alias("no_name"), told(addressing=False).alias("no_addressing"))


# --- exports
@query(f"""WITH {MEM_SQL} SELECT id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day, '- ' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((timestamp % 1000)::VARCHAR, 3, '0') || 'Z [' || category || ':' || scope || '] agent=main source=auto ' || substr(replace(text, chr(10), ' '), 1, 500) AS line FROM mem""")
def a47_mirror_lines(spark, sf_dir):
    """The lines of the daily Markdown mirror."""
    from engramic.sources.files import mirror_lines

    return mirror_lines(memories(spark, sf_dir), F.lit("main"), F.lit("auto")).select("id", "day", "line")


# --- reflections
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,12}')"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each document, its lines made of the document's words; every sixth holds none."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,12}"), F.lit(0))
    always = F.transform(F.slice("w", 1, 3), lambda x: F.concat(F.lit("- Always check "), x))
    derived = F.transform(F.slice("w", 4, 2), lambda x: F.concat(F.lit("- This run showed "), x))
    body = F.concat(F.lit("## Invariants\n"), F.array_join(always, "\n"), F.lit("\n## Derived\n"), F.array_join(derived, "\n"))
    rows = table(spark, sf_dir, "documents").withColumn("w", w)
    n = F.col("doc_id")
    return rows.select("doc_id", n.cast("string").alias("session_id"), F.lit("agent:main").alias("session_key"), F.lit("main").alias("agent"), F.lit("new").alias("command"), F.concat(F.lit("src:"), "source").alias("scope"), (F.lit(NOW) + n * 1000).alias("run_at"), (n % 4 == 0).alias("used_fallback"), F.when(n % 6 == 0, None).otherwise(body).alias("markdown"))


_PAYLOADS_SQL = f"""WITH d AS (SELECT doc_id, 'src:' || source AS scope, {NOW} + doc_id * 1000 AS ms, CASE WHEN doc_id % 6 = 0 THEN [] ELSE {_WORDS}[1:3] END AS inv, CASE WHEN doc_id % 6 = 0 THEN [] ELSE {_WORDS}[4:5] END AS der FROM documents),
e AS (SELECT *, 'refl-' || strftime(make_timestamp(ms * 1000), '%Y%m%d%H%M%S') || '-' || substr(sha1(ms || '|agent:main|' || doc_id || '|main|new'), 1, 8) AS event_id FROM d),
i AS (SELECT event_id, unnest(inv) AS x, generate_subscripts(inv, 1) - 1 AS n FROM e), j AS (SELECT event_id, unnest(der) AS x, generate_subscripts(der, 1) - 1 AS n FROM e),
p AS (SELECT event_id, 'event' AS kind, 0 AS ordinal, 'reflection-event · ' || scope || chr(10) || 'eventId=' || event_id || chr(10) || 'session=' || doc_id || chr(10) || 'agent=main' || chr(10) || 'command=new' || chr(10) || 'usedFallback=' || (doc_id % 4 = 0) AS text FROM e
UNION ALL SELECT event_id, 'item-invariant', n, 'Always check ' || x FROM i UNION ALL SELECT event_id, 'item-derived', n, 'This run showed ' || x FROM j
UNION ALL SELECT event_id, 'combined-legacy', 0, 'reflection · ' || scope || ' · ' || strftime(make_timestamp(ms * 1000), '%Y-%m-%d') || chr(10) || 'Session Reflection (' || strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || 'Z)' || chr(10) || 'Session Key: agent:main' || chr(10) || 'Session ID: ' || doc_id || chr(10) || chr(10) || 'Invariants:' || chr(10) ||
  CASE WHEN len(inv) = 0 THEN '- (none captured)' ELSE array_to_string(list_transform(inv, lambda x: '- Always check ' || x), chr(10)) END || chr(10) || chr(10) || 'Derived:' || chr(10) || CASE WHEN len(der) = 0 THEN '- (none captured)' ELSE array_to_string(list_transform(der, lambda x: '- This run showed ' || x), chr(10)) END FROM e WHERE len(inv) + len(der) > 0)"""


@query(f"{_PAYLOADS_SQL} SELECT event_id, kind, ordinal::INTEGER AS ordinal, text FROM p")
def h5_reflection_payloads(spark, sf_dir):
    """All rows that a report becomes."""
    return reflections.payloads(_reports(spark, sf_dir)).select("event_id", "kind", "ordinal", "text")


@query(f"{_PAYLOADS_SQL}, s AS (SELECT event_id, kind, count(*) AS n FROM p GROUP BY 1, 2) SELECT event_id, kind, ordinal::INTEGER AS ordinal, substr(kind, 6) AS item_kind, n AS group_size, CASE kind WHEN 'item-invariant' THEN 45 ELSE 7 END::INTEGER AS middle, CASE kind WHEN 'item-invariant' THEN 1.1 ELSE 1 END::DOUBLE AS weight, '## ' || CASE kind WHEN 'item-invariant' THEN 'Invariants' ELSE 'Derived' END || chr(10) || '- ' || text AS l1 FROM p JOIN s USING (event_id, kind) WHERE kind LIKE 'item-%'")
def b23_item_payloads(spark, sf_dir):
    """What the metadata of the lines' rows says."""
    items = reflections.payloads(_reports(spark, sf_dir), combined=False).where(F.col("kind").startswith("item-"))
    return items.select("event_id", "kind", "ordinal", _field("itemKind").alias("item_kind"), _field("groupSize").cast("long").alias("group_size"), _field("decayMidpointDays").cast("int").alias("middle"), _field("baseWeight").cast("double").alias("weight"), _field("l1_overview").alias("l1"))


_MAPPED_META = "CASE WHEN doc_id % 3 = 0 THEN '{\"type\":\"memory-reflection-mapped\",\"mappedKind\":\"' || CASE doc_id % 5 WHEN 0 THEN 'user-model' WHEN 1 THEN 'agent-model' WHEN 2 THEN 'lesson' WHEN 3 THEN 'decision' ELSE 'odd' END || '\",\"memory_category\":\"' || CASE doc_id % 2 WHEN 0 THEN 'preferences' ELSE 'cases' END || '\"}' ELSE metadata END"
_MAPPED_SQL = f"""WITH {MEM_SQL}, m AS (SELECT *, {_MAPPED_META} AS raw, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 5 WHEN 0 THEN 'preferences' WHEN 1 THEN 'patterns' WHEN 2 THEN 'cases' WHEN 3 THEN 'cases' END END AS due FROM mem),
r AS (SELECT *, CASE due WHEN 'preferences' THEN 'preference' WHEN 'patterns' THEN 'other' WHEN 'cases' THEN 'fact' END AS stored, CASE doc_id % 2 WHEN 0 THEN 'preferences' ELSE 'cases' END AS stamped FROM m), k AS (SELECT *, due IS NOT NULL AND NOT (stamped = due AND category = stored) AS changed FROM r)"""


@query(f"{_MAPPED_SQL} SELECT id, CASE WHEN changed THEN stored ELSE category END AS category, CASE WHEN changed THEN due WHEN doc_id % 3 = 0 THEN stamped ELSE {_FIELD('memory_category')} END AS memory_category FROM k")
def k29_mapped_restamp(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("metadata", F.expr(_MAPPED_META))
    return reflections.restamped(rows)[0].select("id", "category", _field("memory_category"))


@query(f"{_MAPPED_SQL} SELECT count(due) AS total_mapped, count_if(changed) AS normalized, count_if(due IS NOT NULL AND NOT changed) AS already_correct FROM k")
def k29_restamp_stats(spark, sf_dir):
    return reflections.restamped(memories(spark, sf_dir).withColumn("metadata", F.expr(_MAPPED_META)))[1]


_AUDITED = "CASE doc_id % 4 WHEN 0 THEN '{\"admission_control\":{\"decision\":\"pass_to_dedup\",\"evaluated_at\":' || (timestamp + 5) || '}}' WHEN 1 THEN '{\"admission_control\":{\"decision\":\"reject\"}}' WHEN 2 THEN '{\"admission_control\":{\"decision\":\"pass_to_dedup\"}}' ELSE metadata END"


@query(f"""WITH {MEM_SQL}, m AS (SELECT * FROM mem WHERE scope IN ('src:src0', 'src:src1', 'src:src2')), r AS (SELECT count(*) AS rejected, max(epoch_us(ts) // 1000) AS latest FROM events WHERE event_type = 'error' AND 'src:src' || (user_id % 5) IN ('src:src0', 'src:src1', 'src:src2')),
a AS (SELECT count_if(doc_id % 4 IN (0, 2)) AS admitted, count_if(doc_id % 4 < 3) AS observed, max(CASE doc_id % 4 WHEN 0 THEN timestamp + 5 WHEN 2 THEN timestamp END) AS last_admitted_at FROM m)
SELECT rejected, admitted, rejected + admitted AS total, CASE WHEN rejected + admitted > 0 THEN round(rejected / (rejected + admitted)::DOUBLE, 6) END AS reject_rate, latest AS latest_rejected_at, observed, last_admitted_at FROM r, a""")
def e6_admission_stats(spark, sf_dir):
    """Audits in rows, and error events as rejections, of three scopes."""
    rejected = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("rejected_at"), F.concat(F.lit("src:src"), F.col("user_id") % 5).alias("target_scope"))
    return reflections.admission_stats(memories(spark, sf_dir).withColumn("metadata", F.expr(_AUDITED)), rejected, ["src:src0", "src:src1", "src:src2"])


# --- code
def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as functions of a program, two at least: Python or a script, by turns."""
    text = F.lower(F.coalesce("text", F.lit("")))
    # two words are looked for by themselves, so that the words are taken out once
    several = table(spark, sf_dir, "documents").where(text.rlike("(?<![a-z])[a-z]{3,}+[^a-z](?s:.*?)[a-z]{3}"))
    rows = several.select(F.col("doc_id").alias("id"), F.slice(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)), 1, 400).alias("w"))
    python = F.array_join(F.transform("w", lambda w, i: F.concat(F.lit("def f"), i.cast("string"), F.lit("_"), w, F.lit("():\n    return '"), w, F.lit("'\n"))), "\n")
    script = F.array_join(F.transform("w", lambda w, i: F.concat(F.lit("export function f"), i.cast("string"), F.lit("_"), w, F.lit("() {\n  return '} "), w, F.lit("'\n}\n"))), "\n")
    return rows.select("id", F.when(F.col("id") % 2 == 0, python).otherwise(script).alias("text"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')[1:400] AS w FROM documents)
SELECT doc_id AS id, len(w)::BIGINT AS functions, len(w) > 1 AS starts_whole FROM w WHERE len(w) > 1""")
def k9_code_chunks(spark, sf_dir):
    """Chunks of programs within a model's limit: no function is lost or cut, and each chunk begins with one."""
    from engramic.sources import code

    begins = F.col("text").rlike("^(?:def|export function) f[0-9]+_") & (F.endswith("text", F.lit("'")) | F.endswith("text", F.lit("}")))
    found = code.chunked(_functions(spark, sf_dir), "all-MiniLM-L6-v2").where(F.length("text") <= 358)
    return found.groupBy("id").agg(F.sum(F.regexp_count("text", F.lit("(?m)^(?:def|export function) f[0-9]+_"))).alias("functions"), F.bool_and(begins).alias("starts_whole"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
