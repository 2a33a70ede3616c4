"""Queries of the index, recall accesses, corpus sync, verdicts, compaction, compression and traces, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions import envelope
from engramic.functions.metadata import with_smart_metadata
from engramic.functions.text import trim
from engramic.operators import compaction, compression, corpus, ingress, postings, recall_updates, verdicts
from engramic.operators.stored import shared_folder, written
from engramic.plans import columns
from engramic.plans.memories import DAY, MEM_SQL, NOW, SMART_SQL, TRIM, memories, smart, table

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


# --- the inverted index
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _index_sql(rows: str) -> str:
    return rf"""WITH s AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM ({rows})),
p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place FROM s), t AS (SELECT id, term, count(*) AS tf, min(place) AS place FROM p GROUP BY 1, 2)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS uses, sum(place)::BIGINT AS first_places FROM t GROUP BY 1"""


def _listed(index: postings.Index) -> DataFrame:
    found = index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"), F.sum(F.col("positions")[0]).alias("first_places"))
    return found.join(index.terms().withColumnRenamed("df", "told"), "term").where("df = told").drop("told")


@query(_index_sql("SELECT doc_id AS id, text FROM documents"))
def a27_index_postings(spark, sf_dir):
    """Terms of the stored index with their documents, uses and first places; the stored frequencies must agree."""
    return _listed(postings.build(_texts(spark, sf_dir)))


@query(_index_sql("SELECT doc_id AS id, text FROM documents"))
def a28_index_rebuild(spark, sf_dir):
    """An index of every second document, built anew from all, as a later session finds it."""
    rows = _texts(spark, sf_dir)
    index = postings.rebuilt(postings.build(rows.where("id % 2 = 0")), rows)
    return _listed(postings.opened(spark, index.folder))


@query(_index_sql("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'changed words ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2"))
def a29_index_fold(spark, sf_dir):
    """New, changed and removed documents in the tail of an index, folded into it."""
    rows = _texts(spark, sf_dir)
    index = postings.build(rows.where("id % 10 != 0"))
    index = postings.appended(index, rows.where("id % 10 = 0"))
    index = postings.appended(index, rows.where("id % 10 = 1").withColumn("text", F.concat(F.lit("changed words "), "id")), rows.where("id % 10 = 2"))
    return _listed(postings.folded(index))


@query(_index_sql("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'changed words ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2"))
def a29_index_tail(spark, sf_dir):
    """The same before the fold: later segments hide the rows of earlier ones."""
    rows = _texts(spark, sf_dir)
    index = postings.appended(postings.build(rows), rows.where("id % 10 = 1").withColumn("text", F.concat(F.lit("changed words "), "id")), rows.where("id % 10 = 2"))
    return _listed(index)


# --- accesses of recalled rows
@query("""WITH a AS (SELECT user_id::VARCHAR AS id, event_type AS expected_scope, event_id % 3 AS delta, epoch_us(ts) // 1000 AS "at", event_id FROM events)
SELECT id, expected_scope, sum(delta)::BIGINT AS delta, max("at") AS accessed_at, arg_max(event_id % 5, "at" * 1000000 + event_id) AS strikes FROM a WHERE delta > 0 GROUP BY 1, 2""")
def j6_recall_queue(spark, sf_dir):
    """Events as accesses of users, coalesced by user and type."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    accesses = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("expected_scope"), (F.col("event_id") % 3).alias("delta"), at.alias("accessed_at"), F.struct((F.col("event_id") % 5).alias("bad_recall_count")).alias("snapshot"), F.col("event_id").alias("seq"))
    return recall_updates.coalesced(accesses).select("id", "expected_scope", "delta", "accessed_at", F.col("snapshot.bad_recall_count").alias("strikes"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update for every user that events name, for half of them with what a recall would have seen."""
    seen = F.struct((F.col("n") % 4).alias("bad_recall_count"), F.lit(0).cast("long").alias("suppressed_until_turn"), F.lit(None).cast("long").alias("suppressed_until_ms"))
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("n")).agg(F.count(F.lit(1)).alias("delta"))
    return users.select(
        F.when(F.col("n") % 17 == 5, F.concat(F.lit("?"), "n")).otherwise(F.concat(F.lit("doc:"), "n")).alias("id"), F.concat(F.lit("src:src"), F.col("n") % 4).alias("expected_scope"),
        F.when(F.col("n") % 19 == 3, 0).otherwise(F.col("delta")).alias("delta"), (F.lit(NOW) + F.col("n")).alias("accessed_at"), F.when(F.col("n") % 2 == 0, seen).alias("snapshot"),
    )


_UPDATES_SQL = f"""u AS (SELECT CASE WHEN n % 17 = 5 THEN '?' || n ELSE 'doc:' || n END AS id, 'src:src' || (n % 4) AS expected_scope, CASE WHEN n % 19 = 3 THEN 0 ELSE delta END AS delta, {NOW} + n AS accessed_at, n
  FROM (SELECT user_id AS n, count(*) AS delta FROM events GROUP BY 1)),
o AS (SELECT u.*, s.access_count, s.last_confirmed_use_at, s.last_accessed_at, s.bad_recall_count, s.suppressed_until_ms, CASE WHEN u.n % 17 = 5 THEN 'invalid id' WHEN delta <= 0 THEN 'invalid delta' WHEN s.id IS NULL THEN 'missing' WHEN s.scope <> expected_scope THEN 'moved' ELSE 'updated' END AS outcome FROM u LEFT JOIN smart s USING (id))"""


@query(f"""WITH {SMART_SQL}, {_UPDATES_SQL}, r AS (SELECT *, outcome = 'updated' AS hit, outcome = 'updated' AND n % 2 = 0 AND bad_recall_count = n % 4 AND suppressed_until_ms IS NULL AS released FROM o)
SELECT id, outcome, CASE WHEN hit THEN (access_count + delta)::BIGINT END AS access_count, CASE WHEN hit THEN greatest(last_accessed_at, accessed_at) END AS last_accessed_at, CASE WHEN hit THEN accessed_at END AS last_confirmed_use_at,
CASE WHEN released THEN 0 WHEN hit THEN bad_recall_count END AS bad_recall_count, CASE WHEN released THEN 0 WHEN hit THEN suppressed_until_ms END AS suppressed_until_ms FROM r""")
def a26_recall_merge(spark, sf_dir):
    """Updates merged through the ledger, and the same batch once more."""
    ledger = recall_updates.opened(memories(spark, sf_dir), f"{shared_folder(spark)}/store-{spark.range(1).select(F.expr('uuid()')).first()[0]}")
    updates = _updates(spark, sf_dir)
    ledger.apply(updates, 1)
    outcomes = ledger.apply(updates, 1)
    ledger.fold()
    after = with_smart_metadata(ledger.current()).select("id", "meta")
    told = outcomes.join(after, "id", "left")
    value = lambda c: F.when(F.col("outcome") == "updated", F.col(f"meta.{c}")).alias(c)
    return told.select("id", "outcome", *map(value, ["access_count", "last_accessed_at", "last_confirmed_use_at", "bad_recall_count", "suppressed_until_ms"]))


# --- corpus sync
def _chunks(docs: DataFrame) -> DataFrame:
    """Lines of documents as chunks of Markdown files."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "text"))
    place = {"workspace": F.concat(F.lit("w"), F.col("doc_id") % 2), "agent": F.concat(F.lit("a"), F.col("doc_id") % 3), "source": F.lit("memory"), "path": F.concat(F.lit("memory/"), "doc_id", F.lit(".md"))}
    return corpus.with_ids(lines.select(*[c.alias(n) for n, c in place.items()], (F.col("n") + 1).alias("first_line"), (F.col("n") + 1).alias("last_line"), "text"))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the files, stored chunks of an earlier state, and the plan between them."""
    docs = table(spark, sf_dir, "documents")
    now = _chunks(docs.where("doc_id % 7 != 0"))
    before = docs.where("doc_id % 7 != 1").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" old"))).otherwise(F.col("text")))
    stored = written(_chunks(before).select("id", "text", "metadata"), "corpus")
    active = now.where("agent != 'a2'").select("workspace", "agent").distinct()
    failed = now.where(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 11 == 3).select(*corpus.DOCUMENT).distinct()
    return now, stored, corpus.sync_plan(now, corpus.stored_refs(stored), active, failed)


_CORPUS_SQL = """lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(t, chr(10)) AS l, * FROM ({rows}) q) z),
{name} AS (SELECT 'corpus:' || substr(sha256('w' || (doc_id % 2) || chr(31) || 'a' || (doc_id % 3) || chr(31) || 'memory' || chr(31) || 'memory/' || doc_id || '.md' || chr(31) || n || chr(31) || n), 1, 48) AS id, doc_id, text FROM lines)"""
_OLD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' old' ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 7 <> 1"
_NEW = "SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 7 <> 0"
_PLAN_SQL = f"""WITH {_CORPUS_SQL.format(rows=_OLD, name="o").replace("lines", "old_lines")}, {_CORPUS_SQL.format(rows=_NEW, name="c")},
plan AS (SELECT coalesce(c.id, o.id) AS id, CASE WHEN c.id IS NULL THEN CASE WHEN o.doc_id % 3 <> 2 AND (o.doc_id % 11 <> 3 OR o.doc_id % 7 = 0) THEN 'remove' ELSE 'keep' END
  WHEN c.doc_id % 11 = 3 THEN CASE WHEN o.id IS NULL THEN 'skip' ELSE 'keep' END WHEN o.id IS NULL THEN 'add' WHEN c.text = o.text THEN 'keep' ELSE 'replace' END AS action FROM c FULL JOIN o ON c.id = o.id)"""


@query(f"{_PLAN_SQL} SELECT id, action FROM plan")
def a37_corpus_sync(spark, sf_dir):
    """Lines of files against an older store: some files new, some gone, some with changed last lines, some unreadable."""
    return _corpus(spark, sf_dir)[2]


@query(f"""{_PLAN_SQL} SELECT o.id, sha256(o.text) AS fingerprint FROM o JOIN plan USING (id) WHERE action = 'keep' UNION ALL SELECT c.id, sha256(c.text) FROM c JOIN plan USING (id) WHERE action IN ('add', 'replace')""")
def a38_synced_store(spark, sf_dir):
    """The store after the sync, without what is stale."""
    chunks, stored, plan = _corpus(spark, sf_dir)
    return corpus.synced(stored, chunks, plan).select("id", F.sha2("text", 256).alias("fingerprint"))


@query(f"""{_PLAN_SQL} SELECT (SELECT count(DISTINCT doc_id) FROM c) AS documents, (SELECT count(*) FROM c) AS chunks, count_if(action IN ('add', 'replace')) AS indexed, count_if(action = 'skip') AS skipped, count_if(action = 'remove') AS stale_deleted FROM plan""")
def a37_sync_stats(spark, sf_dir):
    chunks, _, plan = _corpus(spark, sf_dir)
    return corpus.sync_stats(chunks, plan)


# --- compaction
def _alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory rows of which every twentieth has the same vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    return smart(spark, sf_dir).withColumn("v", F.col("doc_id") % 20).join(vectors, "v", "left")


_YOUNG = f"timestamp < {NOW - 40 * DAY}"
_CLUSTERS_SQL = f"""WITH {SMART_SQL}, m AS (SELECT *, first_value(id) OVER (PARTITION BY scope, doc_id % 20 ORDER BY importance DESC, id) AS seed, count(*) OVER (PARTITION BY scope, doc_id % 20) AS n FROM smart WHERE {_YOUNG}),
k AS (SELECT *, id <> seed AS other, row_number() OVER (PARTITION BY seed ORDER BY id <> seed, id) AS place FROM m WHERE n >= 2)"""


@query(f"{_CLUSTERS_SQL} SELECT seed, id, other FROM k")
def g4_compaction_clusters(spark, sf_dir):
    return compaction.compacted(_alike(spark, sf_dir), NOW, least_days=40, dry_run=True)[1]


@query(f"""{_CLUSTERS_SQL}, l AS (SELECT seed, place, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT seed, place, string_split(l2, chr(10)) AS ls FROM k)),
d AS (SELECT seed, t, place, n, row_number() OVER (PARTITION BY seed, lower(t) ORDER BY place, n) AS nth FROM (SELECT *, regexp_replace(line, {TRIM}) AS t FROM l) WHERE t <> ''),
x AS (SELECT seed, string_agg(t, chr(10) ORDER BY place, n) AS text FROM d WHERE nth = 1 GROUP BY 1),
b AS (SELECT seed, t, place, row_number() OVER (PARTITION BY seed, lower(t) ORDER BY place) AS nth FROM (SELECT seed, place, regexp_replace(regexp_replace(l0, '^\\s*[-*]\\s+', ''), {TRIM}) AS t FROM k) WHERE t <> ''),
y AS (SELECT seed, string_agg('- ' || t, chr(10) ORDER BY place) AS overview FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place) AS r FROM b WHERE nth = 1) WHERE r <= 8 GROUP BY 1),
c AS (SELECT seed, category FROM (SELECT seed, category, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, min(place)) AS r FROM k GROUP BY 1, 2) WHERE r = 1),
a AS (SELECT seed, max(importance) AS importance, arg_min(l0, -importance * 1000000 + place) AS l0, max(CASE tier WHEN 'core' THEN 2 WHEN 'working' THEN 1 ELSE 0 END) AS rank, max(access_count) AS access_count, greatest(0.7, max(confidence)) AS confidence, count(*) AS sources FROM k GROUP BY 1)
SELECT 'compacted:' || seed AS id, sha256(coalesce(text, '')) AS text, category, importance, sha256(regexp_replace(substr(l0, 1, 180), {TRIM})) AS l0, sha256(overview) AS l1, (['peripheral', 'working', 'core'])[rank + 1] AS tier, access_count, confidence::DOUBLE AS confidence, sources
FROM a LEFT JOIN x USING (seed) LEFT JOIN y USING (seed) JOIN c USING (seed)""")
def e9_cluster_merge(spark, sf_dir):
    """What becomes of each cluster; long texts as checksums."""
    rows = _alike(spark, sf_dir).where(_YOUNG)
    new = compaction.merged(rows, written(compaction.clusters(rows), "clusters"), NOW)
    field = lambda f: F.get_json_object("metadata", f"$.{f}")
    return new.select("id", F.sha2("text", 256).alias("text"), "category", "importance", F.sha2(field("l0_abstract"), 256).alias("l0"), F.sha2(field("l1_overview"), 256).alias("l1"), field("tier").alias("tier"), field("access_count").cast("long").alias("access_count"), field("confidence").cast("double").alias("confidence"), field("sourceCount").cast("long").alias("sources"))


@query(f"""{_CLUSTERS_SQL} SELECT id FROM smart WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT DISTINCT 'compacted:' || seed FROM k""")
def g4_compaction_run(spark, sf_dir):
    """Ids of the store after the run."""
    return compaction.compacted(_alike(spark, sf_dir), NOW, least_days=40)[0].select("id")


@query(f"""{_CLUSTERS_SQL} SELECT (SELECT count(*) FROM m) AS scanned, count(DISTINCT seed) AS clusters, count(*) AS deleted, count(DISTINCT seed) AS created FROM k""")
def g4_compaction_stats(spark, sf_dir):
    return compaction.compacted(_alike(spark, sf_dir), NOW, least_days=40)[2]


# --- compression
BUDGET = 1200
_SCORED = f"""s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, length(text) AS size, {columns._VALUE} AS reason FROM (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), {TRIM}) AS t FROM (SELECT * FROM conversations))),
v AS (SELECT *, CASE reason WHEN 'empty' THEN 0 WHEN 'tool_call' THEN 1 WHEN 'correction' THEN 0.95 WHEN 'decision' THEN 0.85 WHEN 'acknowledgment' THEN 0.1 WHEN 'system_xml' THEN 0.3 WHEN 'substantive' THEN 0.7 WHEN 'short_question' THEN 0.5 ELSE 0.4 END AS score, max(pos) OVER (PARTITION BY conv_id) AS last, sum(size) OVER (PARTITION BY conv_id) AS total FROM s),
g AS (SELECT *, max(CASE WHEN reason <> 'tool_call' THEN pos END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other FROM v),
o AS (SELECT *, reason = 'tool_call' AND (pos - coalesce(other, -1) - 1) % 2 = 0 AND pos < last AS opens FROM g),
p AS (SELECT *, CASE WHEN opens THEN pos + 1 WHEN lag(opens) OVER w THEN pos - 1 END AS partner, CASE WHEN opens THEN lead(size) OVER w WHEN lag(opens) OVER w THEN lag(size) OVER w END AS psize FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN pos = 0 THEN 0 WHEN pos = last THEN 1 ELSE 2 END, score DESC, pos) AS step FROM p WHERE total > {BUDGET}),
r AS (SELECT conv_id, 0::BIGINT AS step, 0::BIGINT AS used, []::BIGINT[] AS kept FROM q WHERE step = 1 UNION ALL
  SELECT conv_id, step, used + CASE WHEN own THEN size ELSE 0 END + CASE WHEN own AND mate THEN psize ELSE 0 END, list_concat(kept, CASE WHEN own AND mate THEN [pos, partner] WHEN own THEN [pos] ELSE [] END)
  FROM (SELECT *, own AND ends = 0 AND partner IS NOT NULL AND NOT list_contains(kept, partner) AND used + size + psize <= {BUDGET} AS mate
    FROM (SELECT q.conv_id, q.step, r.used, r.kept, q.pos, q.size, q.partner, q.psize, (pos = 0 OR pos = last)::INT AS ends, NOT list_contains(r.kept, q.pos) AND r.used + q.size <= {BUDGET} AND (r.used < {BUDGET} OR pos = 0 OR pos = last) AS own
      FROM r JOIN q ON q.conv_id = r.conv_id AND q.step = r.step + 1)))"""


@query(f"""WITH RECURSIVE {_SCORED}, f AS (SELECT conv_id, arg_max(kept, step) AS kept FROM r GROUP BY 1)
SELECT conv_id, turn, pos, size FROM p JOIN f USING (conv_id) WHERE list_contains(kept, pos) UNION ALL SELECT conv_id, turn, pos, size FROM v WHERE total <= {BUDGET}""")
def g8_compression(spark, sf_dir):
    """Conversations within a budget of characters."""
    return compression.compressed(table(spark, sf_dir, "conversations"), BUDGET)


# --- ingress correlation
def _ingress(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.where("session IS NOT NULL")
    own = turns.where((F.col("session") % 3 != 0) | (F.col("role") == "user"))
    eligible = own.select("session", F.when(F.col("session") % 3 != 0, F.col("pos")).otherwise(F.floor(F.col("pos") / 2)).alias("pos"), "text")
    sizes = eligible.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    tail = eligible.join(sizes, "session").where(F.col("pos") >= F.floor(F.col("n") / 2)).select("session", (F.col("pos") - F.floor(F.col("n") / 2)).alias("pos"), "text")
    return turns, eligible, tail.withColumn("text", F.when(F.col("session") % 5 == 1, F.concat(F.lit("again "), "text")).otherwise(F.col("text")))


@query("""WITH t AS (SELECT conv_id AS session, turn AS pos, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT session, CASE WHEN session % 3 <> 0 THEN pos ELSE pos // 2 END AS pos, text FROM t WHERE session % 3 <> 0 OR role = 'user'), n AS (SELECT session, count(*) AS n FROM e GROUP BY 1),
a AS (SELECT session, pos - n // 2 AS pos, CASE WHEN session % 5 = 1 THEN 'again ' || text ELSE text END AS text FROM e JOIN n USING (session) WHERE pos >= n // 2), c AS (SELECT session, count(*) AS turns FROM t GROUP BY 1),
w AS (SELECT session, turns, n, n // 2 AS skip FROM c JOIN n USING (session)), u AS (SELECT t.*, count_if(role = 'user') OVER (PARTITION BY session ORDER BY pos) AS users FROM t)
SELECT session, pos, 'user' AS role, text FROM a WHERE session % 5 = 1 UNION ALL
SELECT u.session, u.pos, u.role, u.text FROM u JOIN w USING (session) WHERE session % 5 <> 1 AND CASE WHEN turns = n THEN pos >= skip ELSE users > skip END""")
def d19_ingress_turns(spark, sf_dir):
    """Sessions whose second half is new: lined up with all turns, with user turns alone, or from elsewhere."""
    return ingress.turns_for_extraction(*_ingress(spark, sf_dir))


# --- verdicts
_KINDS = ["create", "Merge", "skip", "support", "contextualize", "contradict", "supersede", "rename"]
_CATEGORY = "(['profile', 'preferences', 'entities', 'events', 'cases', 'patterns'])[doc_id % 6 + 1]"


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = smart(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    candidates = docs.select(
        n.alias("cand_id"), n.alias("seq"), pick(["profile", "preferences", "entities", "events", "cases", "patterns"], n).alias("category"), F.concat(F.lit("Topic "), n, F.lit(": value")).alias("abstract"),
        F.lit("- overview").alias("overview"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("content"), F.lit("s1").alias("session"), F.concat(F.lit("src:"), "source").alias("scope"),
    )
    verdict = F.when(n % 13 != 0, F.struct(pick(_KINDS, F.floor(n / 6)).alias("decision"), F.when(n % 4 > 0, n % 4).cast("string").alias("match_index"), F.concat(F.lit("because "), n).alias("reason"), pick(["general", "evening", None], n).alias("context_label")))
    judged = docs.select(n.alias("cand_id"), verdict.alias("verdict"), F.array(F.concat(F.lit("doc:"), n % 50), F.concat(F.lit("doc:"), n % 50 + 150)).alias("similar"))
    return verdicts.routed(candidates, judged, rows, docs.where("doc_id % 29 = 7").select(n.alias("cand_id"))), rows


_VERDICT_SQL = f"""WITH {SMART_SQL}, c AS (SELECT doc_id AS n, {_CATEGORY} AS category, 'src:' || source AS scope, CASE WHEN doc_id % 13 <> 0 THEN ({_KINDS})[doc_id // 6 % 8 + 1] END AS raw, doc_id % 4 AS i, (['general', 'evening', NULL])[doc_id % 3 + 1] AS label FROM documents),
d AS (SELECT *, coalesce(lower(raw), 'create') AS low, i IN (1, 2) AS valid FROM c), e AS (SELECT *, CASE WHEN low = 'rename' OR (low IN ('supersede', 'contradict') AND NOT valid) THEN 'create' ELSE low END AS decision FROM d),
f AS (SELECT e.*, CASE WHEN category = 'profile' THEN p.profile WHEN decision NOT IN ('create', 'skip') THEN CASE WHEN valid AND i = 2 THEN 'doc:' || (n % 50 + 150) ELSE 'doc:' || (n % 50) END END AS match_id, CASE WHEN decision = low AND n % 13 <> 0 THEN label END AS context,
  CASE WHEN raw IS NULL THEN 'LLM response unparseable' WHEN low = 'rename' THEN 'Unknown decision: rename' WHEN decision <> low THEN low || ' degraded: missing match_index' ELSE 'because ' || n END AS reason FROM e LEFT JOIN (SELECT scope, min(id) AS profile FROM smart WHERE memory_category = 'profile' GROUP BY 1) p USING (scope)),
h AS (SELECT f.*, s.id IS NOT NULL AS there FROM f LEFT JOIN smart s ON s.id = match_id),
k AS (SELECT *, CASE WHEN n % 29 = 7 THEN 'reject' WHEN category = 'profile' THEN CASE WHEN there THEN 'merge' ELSE 'create' END WHEN decision IN ('create', 'skip') THEN decision WHEN decision = 'merge' THEN CASE WHEN there AND category IN ('preferences', 'entities', 'patterns') THEN 'merge' ELSE 'create' END
  WHEN decision = 'support' THEN CASE WHEN there THEN 'support' ELSE 'none' END WHEN category IN ('preferences', 'entities') AND (decision = 'supersede' OR (decision = 'contradict' AND context = 'general')) THEN CASE WHEN there THEN 'supersede' ELSE 'create' END WHEN decision = 'supersede' THEN 'create' ELSE decision END AS action FROM h)"""


@query(f"{_VERDICT_SQL} SELECT n AS cand_id, action, match_id, context, reason FROM k")
def k20_candidate_router(spark, sf_dir):
    """Verdicts of every kind on candidates of every category, some without an answer, some rejected."""
    return _routed(spark, sf_dir)[0].select("cand_id", "action", "match_id", "context", "reason")


@query(f"{_VERDICT_SQL} SELECT count_if(action IN ('create', 'supersede', 'contextualize', 'contradict')) AS created, count_if(action = 'merge') AS merged, count_if(action = 'skip') AS skipped, count_if(action = 'supersede') AS superseded, count_if(action = 'support') AS supported, count_if(action = 'reject') AS rejected FROM k")
def k19_batch_stats(spark, sf_dir):
    return verdicts.batch_stats(_routed(spark, sf_dir)[0])


@query(f"""{_VERDICT_SQL}, o AS (SELECT match_id AS id, count_if(action = 'support') AS good, count(*) AS total, count(DISTINCT CASE WHEN coalesce(context, '') = '' THEN 'general' ELSE context END) AS contexts FROM k WHERE action IN ('support', 'contradict') GROUP BY 1),
u AS (SELECT match_id AS id, 'mem:' || max(n) AS successor FROM k WHERE action = 'supersede' GROUP BY 1), m AS (SELECT match_id AS id, 'Merged ' || max(n) AS l0 FROM k WHERE action = 'merge' GROUP BY 1)
SELECT id, l0, successor, good, total, contexts::INTEGER AS contexts FROM o FULL JOIN u USING (id) FULL JOIN m USING (id)""")
def k22_row_patches(spark, sf_dir):
    """One patch for each row that a batch touches: merged text, successor, and support."""
    told, rows = _routed(spark, sf_dir)
    merges = told.select("cand_id", F.concat(F.lit("Merged "), "cand_id").alias("abstract"), F.lit("- o").alias("overview"), F.lit("c").alias("content"))
    found = verdicts.row_patches(told, merges, rows, NOW)
    total = F.col("support.total_observations")
    return found.select("id", "l0", "successor", F.round(F.col("support.global_strength") * total).cast("long").alias("good"), total.alias("total"), F.when(total.isNotNull(), F.size("support.slices")).alias("contexts"))


@query(f"""{_VERDICT_SQL}, u AS (SELECT match_id AS id, max(n) AS successor FROM k WHERE action = 'supersede' GROUP BY 1), m AS (SELECT match_id AS id, max(n) AS l0 FROM k WHERE action = 'merge' GROUP BY 1)
SELECT s.id, CASE WHEN m.id IS NULL THEN sha256(s.text) ELSE sha256('Merged ' || m.l0) END AS text, CASE WHEN u.id IS NULL THEN json_extract_string(CASE WHEN json_valid(s.metadata) THEN s.metadata::JSON ELSE '{{}}'::JSON END, '$.invalidated_at') ELSE '{NOW}' END AS invalidated_at, CASE WHEN u.id IS NOT NULL THEN 'mem:' || u.successor END AS superseded_by, NULL AS supersedes, CASE WHEN u.id IS NOT NULL THEN 'superseded_by' END AS relation
FROM smart s LEFT JOIN u ON u.id = s.id LEFT JOIN m ON m.id = s.id UNION ALL
SELECT 'mem:' || n, sha256('Topic ' || n || ': value'), NULL, NULL, CASE WHEN action = 'supersede' THEN match_id END, CASE action WHEN 'supersede' THEN 'supersedes' WHEN 'contextualize' THEN 'contextualizes' WHEN 'contradict' THEN 'contradicts' END FROM k WHERE action IN ('create', 'supersede', 'contextualize', 'contradict')""")
def k22_applied_batch(spark, sf_dir):
    """The store after the batch: patched and new rows."""
    told, rows = _routed(spark, sf_dir)
    merges = told.select("cand_id", F.concat(F.lit("Merged "), "cand_id").alias("abstract"), F.lit("- o").alias("overview"), F.lit("c").alias("content"))
    after = verdicts.applied(rows, told, merges, NOW)
    field = lambda f: F.get_json_object("metadata", f"$.{f}")
    kind = F.coalesce(F.get_json_object(field("relations"), "$[0].type"), F.get_json_object("metadata", "$.relations[0].type"))
    return after.select("id", F.sha2("text", 256).alias("text"), field("invalidated_at").alias("invalidated_at"), field("superseded_by").alias("superseded_by"), field("supersedes").alias("supersedes"), kind.alias("relation"))


# --- envelopes and answers of models
_PAD = envelope.BLANKS + envelope.INVISIBLE
_TAGGED = "'a < \u200b/ User_Message id=\"' || doc_id || '\"> ' || replace(coalesce(text, ''), '. ', ' <user_messages> . <assistant_message/>') || ' <user_message no end'"


@query(f"SELECT doc_id, sha256(regexp_replace(x, '<([{_PAD}]*(?:/[{_PAD}]*)?(?i:user_message|assistant_message)(?:[^A-Za-z0-9_>][^>]*)?)>', '‹\\1›', 'g')) AS text FROM (SELECT doc_id, {_TAGGED} AS x FROM documents)")
def i44_spoofed_tags(spark, sf_dir):
    """Documents with tags of speakers between their sentences, real ones, longer names and one without an end."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TAGGED).alias("x"))
    return rows.select("doc_id", F.sha2(envelope.without_spoofed_tags(F.col("x")), 256).alias("text"))


_JSON = 'chr(96) || chr(96) || chr(96)'
_BLOCK = "'{label}' || chr(10) || " + _JSON + " || 'json' || chr(10) || '{{\"message_id\": \"m' || doc_id || '\", \"s\": \"}}\"}}' || chr(10) || " + _JSON
_BODY = f"regexp_replace(replace(coalesce(text, ''), chr(10), ' '), {TRIM})"
_ENVELOPED = f"CASE doc_id % 4 WHEN 0 THEN {_BLOCK.format(label='Sender (untrusted metadata):')} || chr(10) || {_BODY} WHEN 1 THEN '[Subagent Task] Reply with a brief acknowledgment only.' || chr(10) || chr(10) || 'Do not use any memory tools' || chr(10) || {_BODY} WHEN 2 THEN 'System: [2026-03-02 04:21 GMT+8] Chat[main] joined' || chr(10) || {_BODY} ELSE {_BLOCK.format(label='a note:')} || chr(10) || {_BODY} END"


def _enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    fence, n = "```", F.col("doc_id")

    def block(label: str) -> Column:
        return F.concat(F.lit(label + "\n" + fence + 'json\n{"message_id": "m'), n.cast("string"), F.lit('", "s": "}"}\n' + fence))

    whole = F.when(n % 4 == 0, F.concat(block("Sender (untrusted metadata):"), F.lit("\n"), body)).when(n % 4 == 1, F.concat(F.lit("[Subagent Task] Reply with a brief acknowledgment only.\n\nDo not use any memory tools\n"), body))
    whole = whole.when(n % 4 == 2, F.concat(F.lit("System: [2026-03-02 04:21 GMT+8] Chat[main] joined\n"), body)).otherwise(F.concat(block("a note:"), F.lit("\n"), body))
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("x"))


@query(f"SELECT doc_id, sha256(CASE WHEN doc_id % 4 < 3 THEN {_BODY} ELSE regexp_replace({_ENVELOPED}, {TRIM}) END) AS text FROM documents")
def i41_envelope_strip(spark, sf_dir):
    """Each document inside one of four envelopes; a block that no label marks and that names no sender stays."""
    return _enveloped(spark, sf_dir).select("doc_id", F.sha2(envelope.envelope_free(F.col("x")), 256).alias("text"))


@query(f"SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN {_BODY} WHEN 1 THEN regexp_replace('Do not use any memory tools' || chr(10) || {_BODY}, {TRIM}) ELSE regexp_replace({_ENVELOPED}, {TRIM}) END) AS text FROM documents")
def i43_capture_text(spark, sf_dir):
    """The same messages as capture reads them: of wrapper lines the first other line ends the lead-in."""
    return _enveloped(spark, sf_dir).select("doc_id", F.sha2(envelope.capture_text(F.lit("user"), F.col("x")), 256).alias("text"))


@query("""SELECT doc_id, coalesce(text, '') AS content, doc_id % 3 AS n FROM documents""")
def i63_repaired_answers(spark, sf_dir):
    """Answers of a model that hold a document's text in JSON with raw line ends, a trailing comma and prose around; read back by their fields."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    body = F.concat(F.lit('{"content": "'), plain, F.lit('", "list": [1, 2, ], "n": '), (F.col("doc_id") % 3).cast("string"), F.lit(", }"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>{no}</think> Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("<think>{no}</think> ```\n"), body, F.lit("\n``` done")))
    found = table(spark, sf_dir, "documents").select("doc_id", F.from_json(envelope.usable_json(answer), "struct<content: string, n: long>").alias("j"))
    return found.select("doc_id", "j.content", "j.n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
