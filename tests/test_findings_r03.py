"""Queries against their SQL on rows that small tables do not hold, and rules whose cost must not grow with their depth."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from engramic.functions import envelope, rules, text
from engramic.operators import postings, recall, retrieval
from engramic.plans import catalog, store_tools
from engramic.sources import code, files


@pytest.fixture
def compared(spark, tmp_path):
    """Columns of a query's rows, which must be those of its SQL."""

    def run(name, documents, labels=(), embeddings=()):
        docs = [(i, t, "en", "src0", len(t)) for i, t in documents]
        tables = {
            "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int"),
            "embeddings": spark.createDataFrame([(i, v, 0) for i, v in embeddings], "vec_id long, embedding array<float>, label int"),
        }
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = [tuple(r) for r in registered.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=repr) == sorted(con.execute(registered.oracle_sql()[name]).fetchall(), key=repr)
        return got

    return run


def test_f2_a_prefix_of_two_rows_is_ambiguous(compared):
    colliding = (206_104, 238_551)  # their digests begin alike
    got = compared("a18_forget", [(i, "a text of a row") for i in (*colliding, 5, 6, 7, 8, 10, 14)])
    assert "ambiguous" in {r[3] for r in got}


def test_f3_an_end_before_the_begin_is_dropped(compared):
    got = compared("b5_built_metadata", [(i, "a text") for i in (*range(20), *range(100_000, 100_020))])
    assert {r[5] for r in got if r[0] == "doc:100000"} == {None}


def test_f4_halves_of_the_fourth_place_round_up(compared):
    compared("d12_tier_of_decay", [(i, "a text") for i in (348, 1235, 4776, 14143, 39983)], [(1235, 1), (4776, 0), (14143, 1), (39983, 1)])


def test_f5_a_clause_ends_the_items_inside_a_word(compared):
    got = compared("i57_preference_slots", [(1, "thwhen iningth aninges"), (2, "because second third"), (5, "first second third"), (6, "first second third"), (8, "first second third")])
    assert ("aninges:th", "th") in {r[1:] for r in got}


def test_f6_hits_like_a_better_one_come_last(compared):
    vectors = {100: [1.0, 0.0, 0.0], 1: [1.0, 0.3, 0.0], 2: [1.0, 0.31, 0.0], 3: [0.5, 0.0, 0.8], 4: [0.5, 0.8, 0.0]}
    got = compared("m4_vector_recall", [(i, f"a text of row {i}") for i in vectors], [(i, 1) for i in vectors], list(vectors.items()))
    scores = [s for _, _, s, _ in sorted(got, key=lambda r: r[3])]
    assert scores != sorted(scores, reverse=True)


def test_f1_steps_of_capture_name_their_input_once(spark):
    said = str(envelope.capture_text(F.lit("user"), F.col("x"))._jc)
    assert said.count("regexp_replace") < 100


def test_trim_takes_all_white_space_at_the_ends(spark):
    told = "\u3000\ufeff \x0b a\u00a0b \u2028\t"
    assert spark.createDataFrame([(told,)], "t string").select(text.trim(F.col("t"))).first()[0] == "a\u00a0b"


def test_redaction_of_texts_with_and_without_marks(spark):
    said = ["no secret", "a token = abcdef123 b", "mail bob@example.com x", "key AKIA" + "A" * 16 + " end", "Bearer abc.def-1", r"see C:\dir\file now", "https://u:p@h.example/x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(rules.redact(F.col("t"))).collect()]
    assert got == ["no secret", "a [REDACTED] b", "mail [REDACTED] x", "key [REDACTED] end", "Bearer [REDACTED]", "see [REDACTED] now", "https://[REDACTED]@h.example/x"]


def test_f8_postings_are_made_of_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(postings, "MOST_WORDS", 10)
    batch = pa.record_batch({"id": list(range(8)), "w": [["a"] * n for n in (3, 0, 9, 4, 25, 1, 0, 6)]})
    parts = list(postings._by_words(batch.slice(1)))
    assert len(parts) > 2 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch.slice(1)]))
    assert max(pc.sum(pc.list_value_length(p.column("w"))).as_py() for p in parts) <= 10 + 25


def test_f23_few_scores_at_once_give_the_same_hits(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, vector array<double>").coalesce(1)
    asked = rows.where("id < 9").select(F.col("id").alias("query_id"), "vector")
    want = retrieval.vector_search(rows, asked, 5).collect()
    assert len(want) == 45
    peak = []
    monkeypatch.setattr(retrieval, "MOST_SCORES", 20)
    monkeypatch.setattr(retrieval, "_asked", lambda rows, queries, blocks, kernel, k: peak.append(_hits(rows, blocks, kernel)))
    retrieval.vector_search(rows, asked, 5)
    assert sorted(peak[0]) == sorted((r.query_id, r.id, r.score) for r in want)


def _hits(rows, blocks, kernel):
    (block,) = blocks
    held = type("Held", (), {"value": block})
    return [tuple(r.values()) for b in kernel(held)(iter(rows.toArrow().to_batches())) for r in b.to_pylist()]


@pytest.mark.parametrize("pattern", [r"\b(prefer|like)\b", r"\b(how do (i|we) usually|what('s| is) my)\b", r"\btoday\b", r"\b(we )?decided\b", "(偏好|喜欢)"])
def test_f20_patterns_are_found_as_one_by_one(spark, pattern):
    said = ["I prefer", "unlike", "like", "a_like", "how do we usually go", "WHAT is My", "today", "todays", "we decided", "decided", "undecided", "我喜欢", "", "x like."]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    got = rows.select(text.any_of(F.col("t"), [pattern]), F.lower("t").rlike("(?i)" + text.java(pattern))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and any(r[0] for r in got)


def test_f13_texts_are_lowered_once_a_row(spark):
    rows = spark.createDataFrame([(1, 1, "An Apple", "An Apple", "- An Apple", "An Apple"), (2, 2, "Pear", "short", "- short", "whole")], "id long, timestamp long, text string, l0 string, l1 string, l2 string")
    rows = rows.select("id", "timestamp", "text", F.struct("l0", "l1", "l2").alias("meta"))
    asked = spark.createDataFrame([(1, "apple"), (2, "- an"), (3, "SHORT"), (4, "- short"), (5, "whole"), (6, "nothing")], "query_id long, text string")
    found = retrieval.lexical_fallback(rows, asked)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("lower(" in x for x in joins)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_f11_signs_and_words_are_looked_for_once(spark, tmp_path):
    said = {"def f():\n  pass": "python", "export function g(x) {}": "javascript", "type A = {}\nconst b = (x: string) => 1": "typescript", "an interface with a class of any function": None, "import x from 'y'\nlet a = 1": "javascript", "": None}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    told = rows.select(files.code_language(F.col("t")).alias("language"))
    assert [r[0] for r in told.collect()] == list(said.values())
    assert str(told._jdf.queryExecution().optimizedPlan()).count("__main__") == 1
    texts = ["One two", "a bc def", "abc,defg", "abcdef", "ab abc abc1abc", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    programs = store_tools._functions(spark, str(tmp_path))
    assert {r.id: r.text.count(" f") for r in programs.collect()} == {0: 2, 2: 2, 4: 3}
    assert str(programs._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 1


def test_f11_chunks_of_some_texts_leave_a_task_together(monkeypatch):
    batch = pa.record_batch({"id": ["a", "b", "c", "d"], "text": ["one", None, "three", "four"]})
    (whole,) = files.cut_batches(iter([batch]), files.chunks_of)
    assert [tuple(r.values()) for r in whole.to_pylist()] == [("a", 0, 0, 3, "one"), ("c", 0, 0, 5, "three"), ("d", 0, 0, 4, "four")]
    monkeypatch.setattr(files, "MOST_CHARS", 6)
    parts = list(files.cut_batches(iter([batch]), files.chunks_of))
    assert [p.num_rows for p in parts] == [2, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))
    text = "\n@a\n  @b\ndef f():\n    def g(): pass\n\nasync def\th(): pass\n"
    assert code.python_units(text) == [(1, text.index("async")), (text.index("async"), len(text))]
    assert code.script_units("/* { */ let s = '{;'\n  class A { m() {} } // }\nfunction f() {}") == [(21, 47), (47, 62)]


@pytest.mark.parametrize(("common", "most"), [(0.0, 3), (0.1, 2), (2.0, 5)])
def test_f21_scores_of_common_and_rare_words_are_sums(monkeypatch, common, most):
    for name, value in (("COMMON", common), ("MOST_COMMON", most), ("MOST_ROWS", 4), ("MOST_SUMS", most)):
        monkeypatch.setattr(postings, name, value)
    draw = np.random.default_rng(5)
    askers = [np.flatnonzero(draw.random(9) < 0.5 / (w % 5 + 1)) for w in range(30)]
    asked = postings.Askers(list(range(9)), np.asarray([len(a) for a in askers]), np.concatenate(askers))
    found = [(w, d, draw.random()) for w in range(2, 30) for d in np.flatnonzero(draw.random(7) < 0.4).tolist()]
    want = np.zeros((9, 7))
    for w, d, x in found:
        want[askers[w], d] += x
    got = postings.scores_of_shard(asked, 7, *(np.asarray(c) for c in zip(*found, strict=True)))
    assert np.allclose(got, want) and np.array_equal(got == 0, want == 0)


def test_f22_a_recall_looks_at_a_text_once_and_stores_what_it_reads(spark, tmp_path, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def noisy(said):
        looked.add(1)
        return said.endswith("7")

    monkeypatch.setattr(rules, "is_noise", noisy)
    meta = "valid_from long, invalidated_at long, valid_until long, temporal_type string, reinforced double, reinforced_at long, stamped_category string"
    rows = [(f"doc:{i}", f"a text {i}", 0.5 + i / 100, 0, [1.0, i / 10], (0, None, None, None, 0.0, 0, None)) for i in range(8)]
    rows = spark.createDataFrame(rows, f"id string, text string, importance double, timestamp long, vector array<double>, meta struct<{meta.replace(' ', ':').replace(',:', ',')}>")
    asked = spark.createDataFrame([(q, [1.0, q / 50]) for q in range(30)], "query_id long, vector array<double>")
    hits = asked.crossJoin(rows).select("query_id", "id", F.lit(0.9).alias("score"))
    got = recall.traced(hits, rows, F.lit(0), 5, asked, 0.3).collect()
    assert len(got) == 240 and {r.id for r in got if r.left_at == "noise_filter"} == {"doc:7"}
    assert 8 <= looked.value <= 16

    docs = [(i, f"a text of row {i}", "en", "src0", 20) for i in (*range(8), 1400, 5000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = catalog._remembered(spark, str(tmp_path))
    assert stored.schema["meta"].dataType.names == recall.FIELDS
    # that of 5 has ended, that of 5000 has not begun
    assert {r.doc_id for r in stored.collect()} == {0, 1, 2, 3, 4, 6, 7, 1400}
