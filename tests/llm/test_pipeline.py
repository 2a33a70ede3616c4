import numpy as np

import corpus_pipeline


def test_decontamination_removes_leaking_rows_and_no_others(spark, tmp_path):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(n))
    item = text(40)
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [text(30) for _ in range(3)]
    rows = [(None, f"{clean[0]} {item}"), (None, clean[0]), (1, item), (1, clean[1]), (2, clean[2]), (3, None), (None, None), (4, item), (4, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(None, clean[0]), (1, clean[1]), (2, clean[2]), (3, None), (None, None)], key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    """Tables with planted cases, and the ids that the pipeline must keep."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    clean = {i: text(60) for i in range(80)}
    toxic = {i: f"{text(20)}. you worthless stupid idiot {text(3)}. {text(20)}" for i in range(100, 150)}
    item = text(50)
    rows = [*clean.items(), *toxic.items()]
    rows += [(200, clean[0].replace(" ", "  ")), (201, clean[1] + " "), (202, clean[2])]  # exact copies; the longest stays
    words = clean[3].split()
    rows += [(203, " ".join([*words[:59], "changed"])), (204, f"{text(30)} {item} {text(30)}"), (205, None), (206, ""), (207, None)]
    rows += [(208, clean[4]), (208, clean[4]), (None, text(60)), (None, text(60))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = (set(clean) - {0, 1}) | {200, 201, 205, None}
    return spark.read.parquet(f"{folder}/documents.parquet"), kept, set(toxic)


def test_each_stage_takes_what_the_one_before_kept(spark, tmp_path):
    docs, kept, toxic = corpus(spark, tmp_path)
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    left = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and not toxic & set(ids(left)) and len(ids(left)) == docs.count() - len(toxic)
    once = corpus_pipeline.exact_stage(spark, left, str(tmp_path))
    assert once.columns == docs.columns
    assert {0, 1, 202, 206, 207, 208}.isdisjoint(ids(once)) and ids(once).count(None) == 2 and {200, 201, 203, 204, 205} <= set(ids(once))
    near = corpus_pipeline.near_stage(spark, once, str(tmp_path))
    assert near.columns == docs.columns and 203 not in ids(near) and 3 in ids(near) and ids(near).count(None) == 2
    clean = corpus_pipeline.decontamination_stage(spark, near, str(tmp_path))
    assert set(ids(clean)) == kept and len(ids(clean)) == len(kept) + 1
    pieces = corpus_pipeline.packing_stage(spark, clean, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept
    assert sum(r["length"] for r in pieces) == sum(n for n in {(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in pieces}.values())


def test_run_applies_all_stages(spark, tmp_path):
    _, kept, _ = corpus(spark, tmp_path)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == kept
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    last = max(places)
    for s, held in places.items():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False))
        assert s == last or sum(n for _, n in held) == 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, _, _ = corpus(spark, tmp_path)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
