"""Accesses of recalled rows, merged into the store once each.

Accesses are coalesced by id and expected scope, then applied where the row still has that scope. A row
that was suppressed is released only if its governance fields are those that the recall saw. A batch
writes the changed metadata alone, as one segment beside the rows; the ledger names each batch, its
segment and its outcomes when both are whole. A batch whose number the ledger has changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramic.functions.metadata import with_smart_metadata
from engramic.operators.tools import patched

# Ids that a batch may name, retries of a failed update, and the first wait before one.
VALID_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,127}$"
MOST_RETRIES, FIRST_WAIT_MS = 3, 100
ENTRY = "place long, batch long, segment string"
#: Fields of the snapshot that a recall takes of a row's governance.
SNAPSHOT = ["bad_recall_count", "suppressed_until_turn", "suppressed_until_ms"]


def coalesced(accesses: DataFrame) -> DataFrame:
    """accesses(id, expected_scope, delta, accessed_at, snapshot, seq) -> one update per id and scope.

    Deltas that are not positive do not count; the last access's snapshot stands, of equal times the
    one of the greatest ``seq``. Aggregates before it shuffles, so a hot row costs a row a task.
    """
    told = accesses.where(F.col("delta") > 0)
    return told.groupBy("id", "expected_scope").agg(
        F.sum("delta").cast("long").alias("delta"),
        F.max("accessed_at").alias("accessed_at"),
        F.max_by("snapshot", F.struct("accessed_at", "seq")).alias("snapshot"),
    )


def retried(failed: DataFrame, pending: DataFrame) -> DataFrame:
    """Failed updates(.., attempts) back among the pending ones, with the wait that they ask for; those tried MOST_RETRIES times go.

    An update that meets a pending one of its id and scope is merged with it and keeps the fewer attempts.
    """
    again = failed.withColumn("attempts", F.col("attempts") + 1).where(F.col("attempts") <= MOST_RETRIES).withColumn("fresh", F.lit(0))
    both = again.unionByName(pending.withColumn("fresh", F.lit(1)))
    merged = both.groupBy("id", "expected_scope").agg(
        F.sum("delta").alias("delta"),
        F.max("accessed_at").alias("accessed_at"),
        F.max_by("snapshot", F.struct("accessed_at", -F.col("fresh"))).alias("snapshot"),
        F.min("attempts").alias("attempts"),
        F.max(F.when(F.col("fresh") == 0, F.lit(FIRST_WAIT_MS) * F.pow(F.lit(2), F.col("attempts") - 1)).otherwise(0)).cast("long").alias("wait_ms"),
    )
    return merged


def judged(rows: DataFrame, updates: DataFrame, valid_id: str = VALID_ID) -> DataFrame:
    """``updates`` with their row's meta, metadata and an outcome; ``rows`` need ``meta``.

    Outcomes: invalid id, duplicate, invalid delta, invalid time, missing, moved (the row has another
    scope; null counts as global), updated. Of repeated ids and scopes the first by ``seq``, or any
    without one, stands. Only the rows named by updates are read on, by a join of their ids.
    """
    seq = F.col("seq") if "seq" in updates.columns else F.lit(0)
    told = updates.withColumn("seq", seq)
    least = told.groupBy("id", "expected_scope").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("copies"))
    told = told.join(least, ["id", "expected_scope"], "left")  # null ids have no row there
    own = rows.select("id", F.coalesce("scope", F.lit("global")).alias("row_scope"), "metadata", "meta")
    met = told.join(own, "id", "left")
    outcome = (
        F.when(~F.coalesce(F.col("id").rlike(valid_id), F.lit(False)), "invalid id")
        .when((F.col("copies") > 1) & (F.col("seq") > F.col("first")), "duplicate")
        .when(~F.coalesce(F.col("delta") > 0, F.lit(False)), "invalid delta")
        .when(~F.coalesce(F.col("accessed_at") > 0, F.lit(False)), "invalid time")
        .when(F.col("row_scope").isNull(), "missing")
        .when(F.col("row_scope") != F.col("expected_scope"), "moved")
        .otherwise("updated")
    )
    return met.withColumn("outcome", outcome).drop("first", "copies")


def _unchanged() -> Column:
    same = [F.col(f"meta.{f}").eqNullSafe(F.col(f"snapshot.{f}")) for f in SNAPSHOT]
    return F.col("snapshot").isNotNull() & reduce(Column.__and__, same)


def patches(told: DataFrame) -> DataFrame:
    """id, metadata of the updated rows among ``judged`` ones."""
    released = F.when(_unchanged(), F.lit(0))
    changes = {
        "access_count": F.col("meta.access_count") + F.col("delta"),
        "last_accessed_at": F.greatest("meta.last_accessed_at", "accessed_at"),
        "last_confirmed_use_at": F.greatest(F.coalesce("meta.last_confirmed_use_at", F.lit(0)), F.col("accessed_at")),
        **{f: released for f in SNAPSHOT},
    }
    return told.where("outcome = 'updated'").select("id", patched(F.col("metadata"), changes).alias("metadata"))


def with_patches(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` with the metadata of ``changed(id, metadata)``."""
    new = changed.select("id", F.col("metadata").alias("_metadata"))
    return rows.join(new, "id", "left").withColumn("metadata", F.coalesce("_metadata", "metadata")).select(rows.columns)


@dataclass(frozen=True)
class Ledger:
    """A store of rows in a shared folder, and what has been merged into it.

    An entry is a batch with its segment, or (without a batch) a segment of whole rows that stands for
    all before it.
    """

    spark: SparkSession
    folder: str

    def _entries(self) -> list[Row]:
        # one entry a batch; the rows of segments are never read here
        return sorted(self.spark.read.schema(ENTRY).parquet(f"{self.folder}/ledger").collect(), key=lambda r: r["place"])

    def _add(self, place: int, batch: int | None, segment: str) -> None:
        self.spark.createDataFrame([(place, batch, segment)], ENTRY).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{segment}/{table}")

    def current(self) -> DataFrame:
        """The rows, each with its last metadata."""
        entries = self._entries()
        base = max(k for k, e in enumerate(entries) if e["batch"] is None)
        rows = self._read(entries[base]["segment"], "rows")
        merged = [self._read(e["segment"], "patches").select("id", "metadata", F.lit(e["place"]).alias("place")) for e in entries[base + 1 :]]
        if not merged:
            return rows
        return with_patches(rows, reduce(DataFrame.union, merged).groupBy("id").agg(F.max_by("metadata", "place").alias("metadata")))

    def apply(self, updates: DataFrame, batch: int, valid_id: str = VALID_ID) -> DataFrame:
        """Merges a batch unless the ledger has it; id, expected_scope, outcome of its updates, now or as it was at its first time."""
        entries = self._entries()
        for known in entries:
            if known["batch"] == batch:
                return self._read(known["segment"], "outcomes")
        segment = f"batch-{batch}-{uuid.uuid4().hex}"
        judged(with_smart_metadata(self.current()), updates, valid_id).write.parquet(f"{self.folder}/{segment}/judged")
        told = self._read(segment, "judged")
        patches(told).write.parquet(f"{self.folder}/{segment}/patches")
        told.select("id", "expected_scope", "outcome").write.parquet(f"{self.folder}/{segment}/outcomes")
        self._add(entries[-1]["place"] + 1, batch, segment)
        return self._read(segment, "outcomes")

    def fold(self) -> None:
        """Writes the current rows, so that later reads join no segments of before."""
        place, segment = self._entries()[-1]["place"] + 1, f"rows-{uuid.uuid4().hex}"
        self.current().write.parquet(f"{self.folder}/{segment}/rows")
        self._add(place, None, segment)


def opened(rows: DataFrame, folder: str) -> Ledger:
    """A new store of rows(id, text, category, scope, timestamp, metadata, ..) in an empty shared folder."""
    rows.write.parquet(f"{folder}/rows-0/rows")
    ledger = Ledger(rows.sparkSession, folder)
    ledger._add(0, None, "rows-0")
    return ledger


def merged_stream(accesses: DataFrame, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Coalesces and applies each micro-batch of a stream of accesses; a batch repeated after a failure changes nothing."""
    apply = lambda batch, n: ledger.apply(coalesced(batch), n)
    return accesses.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
