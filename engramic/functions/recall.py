"""Governance of recalled rows: what an injection changes, and who may be injected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DECAY_MS, SUPPRESS_MS, STRIKES = 86_400_000, 1_800_000, 3


def suppressed(meta: Column, now: Column) -> Column:
    return F.coalesce(meta["suppressed_until_ms"] > now, F.lit(False))


def eligible(meta: Column, now: Column) -> Column:
    """Confirmed, neither archived nor a reflection, and not suppressed."""
    return (meta["state"] == "confirmed") & ~meta["layer"].isin("archive", "reflection") & ~suppressed(meta, now)


def injection_patch(meta: Column, at: Column, repeats: bool = True) -> Column:
    """struct of the counters after an injection at a time.

    A row never touched before sheds old strikes; a long pause clears them; an injection that
    was never confirmed adds one; with enough strikes, and repeats possible, the row is suppressed.
    """
    last, until = meta["last_injected_at"], F.coalesce(meta["suppressed_until_ms"], F.lit(0))
    touched = meta["suppressed_until_ms"].isNotNull()
    paused = F.coalesce(at - last > DECAY_MS, F.lit(True))
    old = F.when(~touched | paused, F.lit(0)).otherwise(meta["bad_recall_count"])
    stale = last.isNotNull() & F.coalesce(meta["last_confirmed_use_at"] < last, F.lit(True))
    strikes = old + stale.cast("int")
    return F.struct(
        (meta["access_count"] + 1).alias("access_count"),
        (meta["injected_count"] + 1).alias("injected_count"),
        strikes.cast("long").alias("bad_recall_count"),
        F.when((strikes >= STRIKES) & F.lit(repeats), F.greatest(until, at + SUPPRESS_MS)).otherwise(until).cast("long").alias("suppressed_until_ms"),
    )
