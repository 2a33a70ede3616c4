"""Order-dependent selection among the hits of one query: at most the few that a search returns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def survivors(vectors: list, threshold: float) -> list[bool]:
    """In order: whether each vector is alike to no survivor before it. Rows without a vector survive."""
    kept: list[np.ndarray] = []
    out = []
    for v in vectors:
        if v is None or len(v) == 0 or not np.any(v):
            out.append(True)
            continue
        x = np.asarray(v, dtype=float) / np.linalg.norm(np.asarray(v, dtype=float))
        out.append(not any(len(k) == len(x) and float(k @ x) > threshold for k in kept))
        if out[-1]:
            kept.append(x)
    return out


def diversified(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, id, score, position, deferred from hits(query_id, id, score, vector) of a top-k search.

    By score: hits too like one already taken go to the end, in their order. A group is the k
    hits of one query, so it is bounded by the search.
    """

    def reorder(group: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending"), ("id", "ascending")])
        deferred = np.asarray([not s for s in survivors(group.column("vector").to_pylist(), threshold)])
        order = np.argsort(deferred, kind="stable")
        group = group.drop_columns("vector").take(pa.array(order))
        return group.append_column("position", pa.array(np.arange(1, len(order) + 1), pa.int32())).append_column("deferred", pa.array(deferred[order]))

    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return hits.select("query_id", "id", "score", "vector").groupBy("query_id").applyInArrow(reorder, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, position int, deferred boolean")
