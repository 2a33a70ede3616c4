"""Greedy survivors and clusters against a sequential pass."""

import numpy as np
import pytest

from engramic.operators import pairs


def brute(rows, least):
    kept, gone = [], {}
    for i, v, _ in sorted(rows):
        for k, w in kept:
            if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                gone[i] = k
                break
        else:
            kept.append((i, v))
    return gone


@pytest.mark.parametrize("block", [2048, 9])
def test_survivors_are_those_of_a_pass_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = np.random.default_rng(2)
    angles = rng.uniform(0, 3, 60)
    rows = [(i, np.array([np.cos(a), np.sin(a)]), "s") for i, a in enumerate(angles)]
    table = spark.createDataFrame([(i, v.tolist(), s, 0.5) for i, v, s in rows] + [(99, None, "s", 0.9)], "id long, vector array<double>, scope string, importance double")
    got = {r["id"]: r["kept_by"] for r in pairs.survivors(table, ["id"], ["scope"], 0.99).collect()}
    assert got == brute(rows, 0.99) and len(got) > 20
    found = pairs.clusters(table, 0.99).collect()
    assert {r["id"]: r["seed"] for r in found if r["id"] != r["seed"]} == got
    assert pairs.survivors(table.where("id > 90"), ["id"], ["scope"], 0.99).count() == 0
