from engramic.operators import retrieval


def test_fusion_rules(spark):
    v = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.5)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.8), (1, 3, 0.62)], "query_id long, id long, score double")
    got = {r["id"]: r["score"] for r in retrieval.fuse(v, b).collect()}
    assert got == {1: 0.74, 2: 0.736, 3: 0.62}


def test_null_vectors_and_texts_match_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (2, [0.0, 0.0], ""), (3, [1.0, 0.0], "alpha beta")], "id long, vector array<float>, text string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "Alpha")], "query_id long, vector array<float>, text string")
    assert [(r["id"], r["score"]) for r in retrieval.vector_search(rows, q).collect()] == [(3, 1.0)]
    assert [r["id"] for r in retrieval.lexical_search(rows, q).collect()] == [3]


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "id long, vector array<float>")
    got = retrieval.vector_search(rows, rows.withColumnRenamed("id", "query_id"), k=1).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == [(i, i, 1) for i in range(8)]
