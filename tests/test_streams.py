"""Streams over files, a file a micro-batch."""

from engramic.streaming import access, capture


def run(spark, tmp_path, name, schema, batches, transform, **options):
    source, seen = str(tmp_path / name), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        capture.applied(transform(stream), lambda batch, n: seen.append(sorted(tuple(r) for r in batch.collect())), str(tmp_path / f"{name}-checkpoint")).awaitTermination(120)
    return [x for x in seen if x]


def test_only_new_turns_pass(spark, tmp_path):
    first = [("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("t", 0, "user", "x"), (None, 0, "user", "lost")]
    again = [("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("s", 2, "user", "c"), ("s", 2, "user", "c")]
    got = run(spark, tmp_path, "turns", "session_id string, seq long, role string, text string", [first, again], lambda s: capture.new_turns(s.selectExpr("*", "TIMESTAMP '2026-01-01 00:00:00' AS ts")))
    assert got == [[("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("t", 0, "user", "x")], [("s", 2, "user", "c")]]


def test_cooldown(spark, tmp_path):
    got = run(spark, tmp_path, "asks", "session_id string, at long", [[("s", 1_000_000), ("s", 1_000_005), ("s", 1_130_000)], [("s", 1_200_000), ("s", 1_250_000), ("u", 1_000_001)]], capture.cooled)
    assert got == [[("s", 1_000_000), ("s", 1_130_000)], [("s", 1_250_000), ("u", 1_000_001)]]


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = [("k", "2026-01-01 00:00:00"), ("k", "2026-01-01 00:01:00"), ("j", "2026-01-01 00:02:00")]
    got = run(spark, tmp_path, "events", "key string, at string", [rows, rows[:1]], lambda s: access.deduplicated(s.selectExpr("key", "CAST(at AS TIMESTAMP) AS ts"), ["key"]).select("key"))
    assert got == [[("j",), ("k",)]]


def test_bank_learns_what_it_does_not_know(spark):
    bank = capture.learned([[1.0, 0.0]], [[0.99, 0.01], [0.0, 1.0], [], [0.0, 0.0]])
    assert bank == [[1.0, 0.0], [0.0, 1.0]]
    assert len(capture.learned([], [[float(i == j) for j in range(9)] for i in range(9)], most=5)) == 5
    rows = spark.createDataFrame([(1, [0.9, 0.1]), (2, [-1.0, 0.1]), (3, None)], "id long, vector array<double>")
    asked = spark.createDataFrame(list(enumerate(bank)), "query_id int, vector array<double>")
    assert [r["id"] for r in capture.is_known(rows, asked).collect()] == [1]
