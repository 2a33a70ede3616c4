"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations alone.

A logged conversation is often a snapshot that a later log continues. Each turn's prefix hash
combines the hashes of all turns up to it; a conversation whose last prefix hash is an inner prefix
hash of another is a snapshot of it. An anti-join leaves the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A turn is rendered as OPEN role CLOSE newline text END newline; OPEN inside a text is broken up.
OPEN, CLOSE, END, BROKEN = "<|", "|>", "<|end|>", "< |"
#: Turns of a conversation that are handled in one task.
BLOCK = 16_384


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"), F.replace(text, F.lit(OPEN), F.lit(BROKEN)), F.lit(END + "\n"))


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, block, pos (from 1), n, h, k, role, text: turns in order, a long conversation over several blocks.

    Rows that repeat in full meet as one with their number. One sort by ranges puts what is distinct in
    order, whatever a conversation's length; a turn's place is the number of rows before it in the
    whole less those before its conversation.
    """
    spark = turns.sparkSession
    conv = F.struct(F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col), F.lit(0)).alias("id"))
    rows = turns.select(conv.alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("c"))
    # ranges are told by the beginnings of texts; the whole ones order the turns within a part
    ranged = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    stored = materialize(spark, ranged.select("conv", "role", "text", "c", F.monotonically_increasing_id().alias("at")), "turns")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    # a row a part
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("part").agg(F.sum("c").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = stored.select("conv", "at", "part", "c", F.coalesce(F.sum("c").over(inside), F.lit(0)).alias("upto")).join(bases, "part").select("conv", "at", "c", (F.col("base") + F.col("upto")).alias("first"))
    whole = counted.groupBy("conv").agg(F.min("first").alias("begin"), F.sum("c").alias("n"))
    places = counted.join(whole, "conv").select("at", (F.col("first") - F.col("begin")).alias("first"), "n")
    told = stored.select("conv", "role", "text", "c", "at").join(places, "at").drop("at")
    # the many copies of a row are dealt out before they are written out
    few = told.where(F.col("c") <= BLOCK).withColumn("lo", F.lit(0).cast("long"))
    many = told.where(F.col("c") > BLOCK).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(BLOCK)))).repartition("conv", "first", "lo")
    each = few.unionByName(many).withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("c"), F.col("lo") + BLOCK) - 1)))
    placed = each.select("conv", (F.col("first") + F.col("i") + 1).cast("int").alias("pos"), F.col("n").cast("int").alias("n"), "role", "text")
    return placed.select("conv", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", F.xxhash64("pos", "role", "text").alias("h"), F.xxhash64(F.lit("second"), "text", "role", "pos").alias("k"), "role", "text")


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, rendered.

    Turns are ordered by turn, role and text, so that ties and repeated rows have one defined
    place each; null turns come first. Null roles and texts count as empty; rows without a
    conversation id form one conversation. Of identical conversations the smallest id stays and
    ``copies`` counts them. An empty table gives an empty result; other columns are not read.
    Conversations of any length are placed, hashed and compared in blocks; only a maximal one is
    gathered, as one string, which has to stay below the 2 GB that a string can hold.
    """
    placed = materialize(turns.sparkSession, _placed(turns, conv_col, turn_col, role_col, text_col), "placed")
    # the combined hash up to each turn: inside its block, and of the blocks before it
    inside = Window.partitionBy("conv", "block").orderBy("pos")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("k").alias("k"))
    parts = parts.select("conv", "block", F.coalesce(F.bit_xor("h").over(earlier), F.lit(0)).alias("ph"), F.coalesce(F.bit_xor("k").over(earlier), F.lit(0)).alias("pk"))
    running = placed.select("conv", "block", "pos", "n", F.bit_xor("h").over(inside).alias("h"), F.bit_xor("k").over(inside).alias("k")).join(parts, ["conv", "block"])
    prefixes = running.select("conv", "pos", "n", F.col("h").bitwiseXOR(F.col("ph")).alias("h"), F.col("k").bitwiseXOR(F.col("pk")).alias("k"))
    key = ["pos", "h", "k"]
    whole = prefixes.where("pos = n").groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = prefixes.where("pos < n").select(*key).distinct()
    maximal = whole.join(inner, key, "left_anti").select("conv", F.col("pos").alias("n_turns"), "copies")
    texts = placed.select("conv", "pos", render(F.col("role"), F.col("text")).alias("piece")).join(maximal, "conv")
    # one conversation makes one output row, so its turns have to meet
    out = texts.groupBy("conv").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    return out.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        "copies",
        F.array_join(F.col("pieces.piece"), "").alias("rendered"),
    )
