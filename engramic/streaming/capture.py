"""Capture streams: new turns of growing sessions, cooldowns, sliding rates, tails of files, a bank of noise.

State is kept by Spark per key and ends with its timeout; every function takes a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How long a session's cursor is kept, and pauses between two runs of one session.
KEPT_MS, COOLDOWN_MS = 1_800_000, 120_000
#: Likeness from which a vector is known, and vectors that a bank holds.
KNOWN, BANK = 0.9, 200


def _keep(state: GroupState, latest_ms: int, kept_ms: int) -> None:
    state.setTimeoutTimestamp(max(latest_ms + kept_ms, state.getCurrentWatermarkMs() + 1))


def new_turns(turns: DataFrame, kept_ms: int = KEPT_MS, late: str = "10 minutes") -> DataFrame:
    """session_id, seq, role, text of turns(session_id, seq, role, text, ts) beyond those of a session's earlier snapshots.

    Each log of a session holds it from the start; a cursor by session tells what was seen.
    Equal snapshots give nothing. A session that pauses for ``kept_ms`` of event time starts anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").drop_duplicates("seq")
        state.update((max(seen, int(rows["seq"].max())),))
        _keep(state, int(rows["at"].max()), kept_ms)
        yield rows.loc[rows["seq"] > seen, ["session_id", "seq", "role", "text"]]

    own = turns.where("session_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    grouped = own.select("session_id", "seq", "role", "text", "ts", F.unix_millis("ts").alias("at")).groupBy("session_id")
    return grouped.applyInPandasWithState(step, "session_id string, seq long, role string, text string", "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def cooled(requests: DataFrame, pause_ms: int = COOLDOWN_MS, late: str = "10 minutes") -> DataFrame:
    """session_id, at of requests(session_id, at in ms) that come at least a pause after the last one let through."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for at in sorted(int(x) for b in batches for x in b["at"]):
            if last is None or at - last >= pause_ms:
                out.append(at)
                last = at
        state.update((last,))
        _keep(state, last, pause_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "at": out}).astype({"at": "int64"})

    own = requests.where("session_id IS NOT NULL AND at IS NOT NULL").select("session_id", "at", F.timestamp_millis("at").alias("ts")).withWatermark("ts", late)
    return own.groupBy("session_id").applyInPandasWithState(step, "session_id string, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_rates(events: DataFrame, most: int = 30, late: str = "10 minutes") -> DataFrame:
    """key, began, events, limited: events of a key in each hour, by the minute."""
    counted = events.withWatermark("ts", late).groupBy("key", F.window("ts", "1 hour", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select("key", F.col("w.start").alias("began"), "events", (F.col("events") >= most).alias("limited"))


def tail(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """value, path of the lines of new files below a folder; the query's checkpoint holds the place."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def learned(bank: list[list[float]], vectors: list[list[float]], known: float = KNOWN, most: int = BANK) -> list[list[float]]:
    """The bank with those vectors that it does not know; the oldest make room."""
    out = [np.asarray(v, float) for v in bank]
    for v in (np.asarray(v, float) for v in vectors if v):
        if not np.any(v) or any(len(b) == len(v) and b @ v >= known * np.linalg.norm(b) * np.linalg.norm(v) for b in out):
            continue
        out.append(v)
    return [v.tolist() for v in out[-most:]]


def is_known(rows: DataFrame, bank: DataFrame, known: float = 0.82) -> DataFrame:
    """Ids of rows(id, vector) that are like a vector of the bank, which holds at most BANK."""
    from engramic.operators.retrieval import vector_search

    best = vector_search(rows.select("id", "vector"), bank.select("query_id", "vector"), 1 << 30, round(1 / (2 - known), 6))
    return best.select("id").distinct()


def applied(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there goes to ``apply`` by micro-batches; it must bear a repeated batch number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
