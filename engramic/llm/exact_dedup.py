"""Exact dedup by content-defined chunk recipes, in DataFrame operations alone.

A text, with blanks deleted, is cut where its own content says so: a hash of the two characters before
a place decides, whatever the script. A chunk's identifier is its 64-bit hash, and a text's recipe is
the ordered list of its chunk identifiers. Chunks meet once, in a dictionary keyed by hash and
content, which verifies that each identifier stands for one content. Recipes, a few hundredths of
the text, are what is compared and joined; long texts do not move, and no task meets all rows of a
recipe that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialize, with_totals


def _cuts(step: int) -> str:
    """A class of bytes, a quarter of the visible ASCII ones and of those that end or continue other characters, by a rule."""
    return "[" + "".join(f"\\x{b:02x}" for b in (*range(33, 127), *range(128, 192)) if b * step % 64 < 16) + "]"


#: What a character of two to four bytes has before its last byte.
_HEAD = r"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{2})"
#: A chunk has at least 256 bytes and ends where the last bytes of two characters are of two such
#: classes, or at 1,024 bytes.
CHUNK = rf"(?s).{{256,1019}}?{_cuts(11)}{_HEAD}?{_cuts(27)}|.{{1,1024}}"


def normalized(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def chunks(norm: Column) -> Column:
    """The chunks in order, each byte written as one character."""
    return F.regexp_extract_all(F.decode(norm.cast("binary"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def _hex(chunk: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(chunk)), 16, "0")


def _ambiguous(norms: DataFrame, base: DataFrame) -> DataFrame | None:
    """Recipes with an identifier that stands for more than one content (none, as a rule).

    The dictionary verifies an identifier by a second digest of the chunk, so that no chunk moves.
    """
    seen = norms.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(_hex(F.col("chunk")).alias("h"), F.xxhash64(F.sha2("chunk", 256)).alias("d"))
    shared = seen.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo != hi").select("h")
    shared = materialize(norms.sparkSession, shared, "ambiguous")
    if shared.isEmpty():
        return None
    recipes = base.select("recipe").distinct().where("recipe != ''")
    ids = recipes.select("recipe", F.explode(F.expr("transform(sequence(0, length(recipe) div 16 - 1), i -> substring(recipe, i * 16 + 1, 16))")).alias("h"))
    return ids.join(shared, "h", "left_semi").select("recipe").distinct()


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash (of the original).

    Of rows with equal normalised texts the one with the most code points in the original stays,
    then the smallest id; null ids come last. Rows repeated in full are told apart by a row number,
    so one of them stays. Null texts count as empty, and all empty texts are one group. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    norms = docs.select(normalized(F.col(text_col)).alias("norm"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("points"), normalized(F.col(text_col)).alias("norm"), F.xxhash64(text_col).alias("text_hash"))
    base = base.select(
        "doc_id",
        "points",
        F.array_join(F.transform(chunks(F.col("norm")), _hex), "").alias("recipe"),
        F.sha2("norm", 256).alias("text_sha256"),
        "text_hash",
        F.monotonically_increasing_id().alias("rid"),
    )
    base = materialize(spark, base, "recipes")
    odd = _ambiguous(norms, base)
    if odd is not None:
        told = F.when(F.col("odd"), F.col("text_sha256")).otherwise(F.lit(""))
        base = base.join(odd.withColumn("odd", F.lit(True)), "recipe", "left").withColumn("recipe", F.concat("recipe", told)).drop("odd")
    first = F.max(F.struct("points", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("rid").alias("r"))).alias("first")
    groups = with_totals(base, ["recipe"], [first, F.count(F.lit(1)).alias("n")], [F.max("first").alias("best"), F.sum("n").alias("group_size")], F.col("rid"))
    return groups.select(
        "doc_id",
        F.bitwise_not("best.d").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.bitwise_not("best.r")).alias("kept"),
        "text_sha256",
        "text_hash",
    )
