"""Conversations cut down to a budget of characters: the most telling texts, in their order.

The choice is greedy and depends on its order: first and last text, then by score and place, each if
it still fits, a tool call together with what follows it. Of texts with equal score and length the
later ones are chosen after the earlier ones, and once a length does not fit it never will. So of
each (score, length) only the first budget / length texts can matter. Their number is bounded by the
budget alone, however long the conversation, and they alone, without their texts, meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engramic.functions.rules import text_value
from engramic.operators.ordered import last_before, running_sum
from engramic.operators.stored import written

# Texts to keep where all are of little worth, and the score below which they are.
LEAST_TEXTS, LEAST_SCORE = 3, 0.3


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, pos (from 0), size, score, next and previous partner's size where a tool call and the text after it are a pair.

    Of tool calls in a row, every second one is what the one before it is paired with.
    """
    text = F.coalesce("text", F.lit(""))
    worth = text_value(text)
    light = turns.select("conv_id", "turn", F.length(text).cast("long").alias("size"), worth["score"].alias("score"), (worth["reason"] == "tool_call").alias("call"))
    light = written(light, "scored")  # texts are judged once; what follows joins numbers
    light = running_sum(light, "conv_id", "turn", F.lit(1), "pos").withColumn("pos", F.col("pos") - 1)
    light = last_before(light, "conv_id", "pos", ~F.col("call"), "other")
    opens = F.col("call") & ((F.col("pos") - F.coalesce("other", F.lit(-1)) - 1) % 2 == 0)
    light = light.withColumn("opens", opens).drop("call", "other")
    after = light.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("size").alias("size_after"))
    before = light.where("opens").select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("size").alias("size_before"))
    met = light.join(after, ["conv_id", "pos"], "left").join(before, ["conv_id", "pos"], "left")
    partner = F.when(F.col("opens") & F.col("size_after").isNotNull(), F.col("pos") + 1).when(F.col("size_before").isNotNull(), F.col("pos") - 1)
    return met.select("conv_id", "turn", "pos", "size", "score", partner.alias("partner"), F.when(partner > F.col("pos"), F.col("size_after")).otherwise(F.col("size_before")).alias("partner_size"))


def chosen(budget: int, key_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """The greedy choice among one conversation's candidates; ``full_score`` and ``full_pos`` tell which candidate used up the budget."""

    def choose(table: pa.Table) -> pa.Table:
        rows = table.select(["pos", "size", "score", "partner", "partner_size", "last"]).to_pylist()
        used, kept, full = 0, {}, None

        def add(pos: int, size: int) -> bool:
            nonlocal used
            if pos in kept or used + size > budget:
                return False
            kept[pos] = True
            used += size
            return True

        ends = [r for r in rows if r["pos"] in (0, r["last"])]
        for r in sorted(ends, key=lambda r: r["pos"]):
            add(r["pos"], r["size"])
        if used >= budget:
            full = (float("inf"), -1)
        else:
            for r in sorted((r for r in rows if r["pos"] not in (0, r["last"])), key=lambda r: (-r["score"], r["pos"])):
                if add(r["pos"], r["size"]) and r["partner"] is not None:
                    add(r["partner"], r["partner_size"])
                if used >= budget:
                    full = (r["score"], r["pos"])
                    break
        n = len(kept)
        score, pos = full or (None, None)
        columns = [pa.array([table.column("conv_id")[0].as_py()] * n, key_type), pa.array(sorted(kept), pa.int64()), pa.array([score] * n, pa.float64()), pa.array([pos] * n, pa.int64())]
        return pa.Table.from_arrays(columns, ["conv_id", "pos", "full_score", "full_pos"])

    return choose


def compressed(turns: DataFrame, budget: int, least_texts: int = LEAST_TEXTS, least_score: float = LEAST_SCORE) -> DataFrame:
    """conv_id, turn, pos, size of the kept turns(conv_id, turn, text); together they have ``budget`` characters at most.

    ``turn`` is a whole number, unique in its conversation. Null texts are empty. Conversations within
    the budget stay whole; an empty table gives no rows.
    """
    if budget < 1:
        raise ValueError("a budget of at least one character is needed")
    light = written(placed(turns), "placed")
    sums = light.groupBy("conv_id").agg(F.sum("size").alias("all"), F.max("pos").alias("last"), F.max("score").alias("best"))
    whole = light.join(sums.where(F.col("all") <= budget).select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "pos", "size")
    long = light.join(sums.where(F.col("all") > budget).select("conv_id", "last", "best"), "conv_id")

    at_end = (F.col("pos") == 0) | (F.col("pos") == F.col("last"))
    alike = Window.partitionBy("conv_id", "score", "size").orderBy("pos")
    some = long.where((F.col("size") > 0) & (F.col("size") <= budget) & ~at_end).withColumn("nth", F.row_number().over(alike))
    some = some.where(F.col("nth") <= budget).where(F.col("nth") * F.col("size") <= budget).drop("nth")
    key = turns.schema["conv_id"].dataType
    picked = some.unionByName(long.where(at_end)).groupBy("conv_id").applyInArrow(chosen(budget, to_arrow_type(key)), f"conv_id {key.simpleString()}, pos long, full_score double, full_pos long")
    sized = picked.join(long.select("conv_id", "pos", "turn", "size"), ["conv_id", "pos"]).select("conv_id", "turn", "pos", "size")

    # empty texts always fit; those that come after the budget was used up are not looked at
    full = picked.groupBy("conv_id").agg(F.max("full_score").alias("full_score"), F.max("full_pos").alias("full_pos"), F.count(F.lit(1)).alias("n"))
    empty = long.where((F.col("size") == 0) & ~at_end).join(full, "conv_id", "left")
    taken = picked.select("conv_id", "pos", F.lit(True).alias("taken"))  # as somebody's partner
    empty = empty.join(taken, ["conv_id", "pos"], "left").where("taken IS NULL")
    seen = F.col("full_score").isNull() | (F.col("score") > F.col("full_score")) | ((F.col("score") == F.col("full_score")) & (F.col("pos") < F.col("full_pos")))
    empty = empty.withColumn("seen", seen)
    counts = empty.groupBy("conv_id").agg(F.count_if("seen").alias("n_seen"))
    # where all is of little worth, the last empty texts fill up to the least number
    newest = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
    wanted = F.least(F.lit(least_texts), F.col("last") + 1) - F.coalesce("n", F.lit(0)) - F.col("n_seen")
    spare = empty.where(~F.col("seen") & (F.col("best") < least_score)).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= least_texts)
    spare = spare.join(counts, "conv_id").where(F.col("nth") <= wanted)
    parts = [empty.where("seen"), spare]
    return whole.unionByName(sized).unionByName(parts[0].select("conv_id", "turn", "pos", "size")).unionByName(parts[1].select("conv_id", "turn", "pos", "size"))
