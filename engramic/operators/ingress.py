"""The turns that an extraction should read, found by lining up what is new with what was said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramic.operators.ordered import running_sum


def turns_for_extraction(turns: DataFrame, eligible: DataFrame, new: DataFrame) -> DataFrame:
    """session, pos, role, text of the turns to extract from, in order of pos.

    turns(session, pos, role, text) are all that were said, eligible(session, pos, text) those that may
    be extracted, new(session, pos, text) those that were not yet; pos counts from 0 without gaps. Where the
    new texts are the tail of the eligible ones, the same number of turns is taken from the end, if turns and
    eligible texts are as many; if not, one user turn is passed over for each eligible text that is
    not new, with the replies to it. New texts from elsewhere are user turns themselves.

    Sequences meet place by place, counted from their ends, in joins by (session, place); running
    counts go in blocks, so a session of any length is spread over tasks.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("session").agg(F.count(F.lit(1)).alias(name))

    counts = counted(turns, "n_turns").join(counted(eligible, "n_eligible"), "session", "full_outer").join(counted(new, "n_new"), "session", "full_outer").na.fill(0)
    by_end = lambda rows, n: rows.join(counts.select("session", n), "session").select("session", (F.col(n) - F.col("pos")).alias("from_end"), F.coalesce("text", F.lit("")).alias("text"))
    same = by_end(new, "n_new").join(by_end(eligible, "n_eligible"), ["session", "from_end", "text"])
    met = counts.join(counted(same, "n_same"), "session", "left").na.fill(0)
    tail = (F.col("n_new") <= F.col("n_eligible")) & (F.col("n_same") == F.col("n_new"))
    told = met.select("session", F.when(~tail, "replayed").when(F.col("n_turns") == F.col("n_eligible"), "aligned").otherwise("skipping").alias("way"), (F.col("n_eligible") - F.col("n_new")).alias("skip"))

    replayed = new.join(told.where("way = 'replayed'").select("session"), "session", "left_semi").select("session", "pos", F.lit("user").alias("role"), "text")
    aligned = turns.join(told.where("way = 'aligned'").select("session", "skip"), "session").where(F.col("pos") >= F.col("skip"))
    others = turns.join(told.where("way = 'skipping'").select("session", "skip"), "session")
    walked = running_sum(others, "session", "pos", (F.col("role") == "user").cast("long"), "users").where(F.col("users") > F.col("skip"))
    columns = ["session", "pos", "role", "text"]
    return replayed.unionByName(aligned.select(columns)).unionByName(walked.select(columns))
