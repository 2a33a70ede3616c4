"""Files, chunks and exports."""

import numpy as np

from engramic.sources import files


def test_chunks_cover_the_text_and_end_at_sentences():
    rng = np.random.default_rng(1)
    text = " ".join("word" * int(rng.integers(1, 4)) + ("." if rng.random() < 0.1 else "") for _ in range(4000))
    found = list(files.chunks_of(text))
    assert len(found) > 5 and found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b, t), nxt in zip(found, [*found[1:], None]):
        assert t == text[a:b] and len(t) <= files.CHUNK
        if nxt:
            assert t.endswith(".") and nxt[0] <= b
    assert list(files.chunks_of(None)) == list(files.chunks_of(" \n")) == []
    assert max(t.count("\n") for *_, t in list(files.chunks_of("a long enough line\n" * 500))[:-1]) < files.LINES


def test_line_chunks_keep_line_numbers():
    text = "\n".join(["", *(f"line {i}" for i in range(200)), "x" * 9000, "", "end"])
    lines, found = text.split("\n"), list(files.line_chunks_of(text))
    assert found[0][:2] == (2, 80)
    for a, b, t in found:
        assert t == "\n".join(lines[a - 1 : b]) or (a == b == 202 and t in lines[201])
    assert sum(len(t) for a, _, t in found if a == 202) == 9000 and found[-1] == (204, 204, "end")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "md" / "memory").mkdir(parents=True)
    (tmp_path / "md" / "memory" / "a.md").write_text("﻿- keep this point\r\n* and that one\nplain\n+ ab", encoding="utf-8")
    (tmp_path / "md" / "big.md").write_text("- too large a file\n" * 50, encoding="utf-8")
    found = files.discovered(spark, str(tmp_path / "md"), "*.md", 200)
    assert [(r["line"], r["text"]) for r in files.bullets(found).orderBy("line").collect()] == [(1, "keep this point"), (2, "and that one")]
    rows = spark.createDataFrame([(1, "s", "t", ("fact", "a"), ("reject", 0.3, "low"))], "rejected_at long, session_key string, target_scope string, candidate struct<category: string, abstract: string>, audit struct<decision: string, score: double, reason: string>")
    files.write_rejections(rows, str(tmp_path / "audit"))
    (tmp_path / "audit" / "part-x.json").write_text("{broken\n")
    assert [r["audit"]["reason"] for r in files.rejections(spark, str(tmp_path / "audit")).collect()] == ["low"]
    notes = spark.createDataFrame([("## [1] a\n**Status**: pending\n**Priority**: high\n## [2] b\n**Status**: promoted",)], "content string")
    assert files.learning_stats(notes).first().asDict() == {"entries": 2, "pending": 1, "high": 1, "promoted": 1}


def test_export_and_mirror_write_every_row(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "one\ntwo", "fact", "s", 1_735_689_600_000, [1.0]), ("b", None, "fact", "t", 1_735_776_000_001, None), ("c", "x" * 900, "other", "s", 1_735_776_000_000, [])], "id string, text string, category string, scope string, timestamp long, vector array<double>")
    files.exported(rows, str(tmp_path / "out"), scope="s")
    back = spark.read.json(str(tmp_path / "out" / "memories"))
    assert {r["id"] for r in back.collect()} == {"a", "c"} and "vector" not in back.columns
    about = spark.read.json(str(tmp_path / "out" / "about")).first()
    assert about["count"] == 2 and about["scope"] == "s" and about["version"] == "1.0"
    files.write_mirror(rows, str(tmp_path / "mirror"), F.lit("main"), F.lit(None).cast("string"))
    files.write_mirror(rows.where("id = 'a'"), str(tmp_path / "mirror"), F.lit(None).cast("string"), F.lit("manual"))
    lines = [(str(r["day"]), r["value"]) for r in spark.read.text(str(tmp_path / "mirror")).collect()]
    assert sorted(lines) == sorted([("2025-01-01", "- 2025-01-01T00:00:00.000Z [fact:s] agent=main one two"), ("2025-01-02", "- 2025-01-02T00:00:00.001Z [fact:t] agent=main "), ("2025-01-02", f"- 2025-01-02T00:00:00.000Z [other:s] agent=main {'x' * 500}"), ("2025-01-01", "- 2025-01-01T00:00:00.000Z [fact:s] source=manual one two")])


def test_rows_of_an_old_store_whatever_they_lack(spark):
    old = spark.createDataFrame([("a", "t", ["1", "2.5"], "4", None, 1234567890), ("b", "u", ["x"], None, "fact", None)], "id string, text string, vector array<string>, importance string, category string, createdAt long")
    got = {r["id"]: r for r in files.legacy_rows(old).collect()}
    assert got["a"]["vector"] == [1.0, 2.5] and got["a"]["importance"] == 4.0 and got["a"]["category"] == "other" and got["a"]["scope"] is None
    assert got["b"]["vector"] == [] and got["b"]["importance"] is None and got["b"]["createdAt"] is None
    assert files.legacy_rows(old.select("id"), 1).count() == 1
