"""Rules on single rows: nulls, empty texts, malformed metadata, scales and streams."""

import pytest
from pyspark.sql import functions as F

from engramic.functions import metadata, rules, scoring
from engramic.operators import analytics, diversity, store
from engramic.streaming import access


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_malformed_metadata_gives_defaults(spark):
    rows = spark.createDataFrame([("a", "fact", 5_000_000_000_000, "{bad"), (None, None, 5_000_000_000_000, None), ("b", "preference", 5_000_000_000_000, '{"tier":"odd","confidence":7,"access_count":"3"}')], "text string, category string, timestamp long, metadata string")
    got = [r["meta"] for r in metadata.with_smart_metadata(rows).collect()]
    assert [(m["tier"], m["confidence"], m["access_count"], m["memory_category"]) for m in got] == [("working", 0.7, 0, "cases"), ("working", 0.7, 0, "patterns"), ("working", 1.0, 3, "preferences")]
    assert got[2]["fact_key"] == "preferences:b" and got[0]["valid_from"] == 5_000_000_000_000


def test_scales(spark):
    assert one(spark, metadata.importance(F.lit("x"))) == 0.7
    assert one(spark, metadata.legacy_importance(F.lit(5.0))) == 0.95
    assert one(spark, metadata.timestamp_ms(F.lit(1_700_000_000), F.lit(1))) == 1_700_000_000_000
    assert one(spark, metadata.timestamp_ms(F.lit(-4), F.lit(1))) == 1
    assert one(spark, F.round(scoring.length_norm(F.lit(1.0), F.lit(1000), F.lit(False)), 6)) == 0.666667


@pytest.mark.parametrize(("text", "noise"), [("", True), (None, None), ("hello there", True), ("I don't recall this", True), ("The build uses Gradle", False)])
def test_noise(spark, text, noise):
    assert one(spark, rules.is_noise(F.lit(text).cast("string"))) is noise


@pytest.mark.parametrize(("text", "skip"), [("/status", True), ("你还记得", False), ("do you recall?", False), ("ok", True), ("👍👍", True), ("where is the config kept", False)])
def test_retrieval_gate(spark, text, skip):
    assert one(spark, rules.skips_retrieval(F.lit(text))) is skip


def test_scope_filters(spark):
    rows = spark.createDataFrame([("a", "s1", 1), ("b", None, 2)], "id string, scope string, timestamp long")
    assert store.scoped(rows, None).count() == 2
    assert store.scoped(rows, []).count() == 0
    assert [r["id"] for r in store.scoped(rows, ["s1"]).collect()] == ["a"]
    assert {r["id"] for r in store.deleted(rows, ["s1"], 5).collect()} == {"b"}


def test_diversity_defers_likes_and_keeps_rows_without_vectors():
    assert diversity.survivors([[1, 0], [1, 0.01], None, [0, 1]], 0.85) == [True, False, True, True]


def test_facts_as_of(spark):
    facts = spark.createDataFrame([("k", "v1", 10), ("k", "v2", 20)], "fact_key string, id string, valid_from long")
    at = spark.createDataFrame([("k", 5), ("k", 10), ("k", 25), ("other", 25)], "fact_key string, at_ms long")
    got = {(r["fact_key"], r["at_ms"]): r["id"] for r in analytics.facts_as_of(facts, at).collect()}
    assert got == {("k", 5): None, ("k", 10): "v1", ("k", 25): "v2", ("other", 25): None}


def test_stream_merges_accesses(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 9), ("b", 3)], "id string, at long").write.parquet(source)
    seen = {}
    stream = spark.readStream.schema("id string, at long").parquet(source)
    access.merge_accesses(stream, lambda batch, n: seen.update({r["id"]: (r["accesses"], r["last_at"]) for r in batch.collect()}), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert seen == {"a": (2, 9), "b": (1, 3)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string, category string, scope string, timestamp long, metadata string")
    assert metadata.with_smart_metadata(none).count() == 0
    assert analytics.scope_category_counts(none).count() == 0


def test_p95_whatever_the_spread(spark):
    import numpy as np

    from engramic.operators import analytics

    rng = np.random.default_rng(1)
    groups = {"even": rng.random(5000), "outlier": np.append(rng.random(4999), 1e12), "equal": np.full(3000, 7.0), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0]), "two": np.repeat([1.0, 2.0], [940, 60])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["p95"]) for r in analytics.latency_stats(rows, "g", "v").collect()}
    assert got == {g: (len(vs), float(np.sort(vs)[int(np.ceil(len(vs) * 0.95)) - 1])) for g, vs in groups.items()}
    assert analytics.latency_stats(rows.limit(0), "g", "v").count() == 0


def test_patterns_over_the_seam_of_two_turns_count(spark):
    from engramic.operators import analytics

    talks = {1: ["please keep in", "mind this"], 2: ["no", "use tabs"], 3: ["我不是猫", "而是狗"], 4: ["a\nwe", "will see"], 5: ["keep in\n", "mind"], 6: [None, None], 7: ["so", "no way"]}
    rows = spark.createDataFrame([(c, i, t) for c, ts in talks.items() for i, t in enumerate(ts)], "conv_id long, turn long, text string")
    got = {r["conv_id"]: r["value"] for r in analytics.conversation_value(rows).collect()}
    assert got == {1: 0.5, 2: 0.3, 3: 0.3, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}
