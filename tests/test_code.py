"""Chunks of code and of long texts."""

from pyspark.sql import functions as F

from engramic.sources import code, files

SCRIPT = """import x from 'y'
// function not() {
export class A {
  run() { return '}' } /* { */
}
const f = async (a) => {
  let function_ = `{`
}

function g() {}
"""
PYTHON = """import os

@deco
@other(1)
def a():
    def inner():
        pass
    return 1


class B:
    x = 1
"""


def test_units_of_scripts_and_python():
    got = [SCRIPT[a:b] for a, b in code.script_units(SCRIPT)]
    assert [g.split("{")[0].strip() for g in got] == ["export class A", "const f = async (a) =>", "function g()"] and got[0].endswith("}\n")
    assert code.script_units("function f() {") is None and code.script_units("let x = 1") is None
    assert code.script_units("function f();\nlet y = {}") is None
    got = [PYTHON[a:b] for a, b in code.python_units(PYTHON)]
    assert got[0].startswith("@deco\n@other(1)\ndef a") and got[1].startswith("class B") and len(got) == 2
    assert code.python_units("x = 1") is None


def test_chunks_hold_whole_units_or_fall_back():
    text = "\n".join(f"def f{i}():\n    return {i}\n" for i in range(200))
    got = code.smart_chunks(text, "python", "all-MiniLM-L6-v2")
    most = code.limits(text, "all-MiniLM-L6-v2")[0]
    assert most == 358 and all(len(t) <= most and t.startswith("def") and text[a:b] == t for a, b, t in got)
    assert "".join("".join(t.split()) for _, _, t in got) == "".join(text.split())
    long = "def f():\n" + "    x = 1\n" * 200
    assert code.smart_chunks(long, "python", "all-MiniLM-L6-v2") == list(files.chunks_of(long, 358, 25, 100, 50))
    assert code.limits("漢字" * 50, None) == (2293, 163, 327) and code.smart_chunks(None, None) == [] and code.smart_chunks("  ", "python") == []


def test_long_vectors_are_means_of_their_chunks(spark):
    rows = spark.createDataFrame([(1, "word. " * 400), (2, "short"), (3, None)], "id long, text string")
    embed = lambda chunks: chunks.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0)))
    got = {r["id"]: r["vector"] for r in code.long_vectors(rows, embed, "all-MiniLM-L6-v2").collect()}
    sizes = [len(t) for _, _, t in code.smart_chunks("word. " * 400, None, "all-MiniLM-L6-v2")]
    assert set(got) == {1, 2} and got[2] == [5.0, 1.0] and abs(got[1][0] - sum(sizes) / len(sizes)) < 1e-9
