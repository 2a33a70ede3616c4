"""Groups of spelling variants: a trie self-join with active-node sets, for distance one.

The vocabulary is a trie. For a node, the active nodes are those within one edit of it. A node is
active for itself; the one edit opens pairs of nodes at the depth where it falls, and from then on
both walk the same characters. Two words that both end in such a pair are near.

The trie is partitioned by prefix: subtrees of at most MOST_WORDS words, below depth FIRST_DEPTH and
deeper where a prefix is crowded, are joined each in one task. Pairs whose edit falls above, between
two partitions, have no edit left, so what remains of their paths must be equal: such states meet in
an equi-join by depth and path, in groups no larger than the alphabet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Depth of the prefixes that partition the trie, and words of a partition at most.
FIRST_DEPTH, MOST_WORDS = 3, 512
#: A form is TIMES as frequent as its variant, so 27 steps pass any 64-bit count, and 5 doublings pass 27 steps.
MOST_DOUBLINGS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def planted(doc_id: Column, word: Column) -> Column:
    """Test words: one in 199, by the checksum of id and word, loses a character."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, changed: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of LETTERS in lower case (A-Z alone) of LEAST_LENGTH characters and LEAST_COUNT occurrences at least."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("word"))
    # a change makes no word longer
    runs = runs.where(F.length("word") >= LEAST_LENGTH).withColumn("word", F.translate("word", UPPER, LOWER))
    if changed is not None:
        runs = runs.select(changed(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_pairs(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct Latin-1 ``words`` at distance one that share their first ``depth`` characters.

    A node is told by the first word below it; a node of depth k ends a word if that word is k long.
    Each depth has the states (p, q) of equal depth after a replacement, and those with q one deeper
    after an insertion.
    """
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max(initial=0)) + 2
    codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
    common = np.concatenate([[-1], (codes[1:] != codes[:-1]).argmax(axis=1)])

    def edges(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Children of the nodes of depth k: node, parent, character; and parent and character as one key, ascending."""
        node = np.flatnonzero((common < k + 1) & (sizes > k))
        parent = np.maximum.accumulate(np.where(common < k, np.arange(len(words)), 0))[node]
        return node, parent, codes[node, k], parent << 8 | codes[node, k]

    def walked(p: np.ndarray, q: np.ndarray, below_p: tuple, below_q: tuple, unlike: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States below (p, q) by the same character on both sides, other than ``unlike``."""
        node, parent, character, _ = below_p
        first, last = np.searchsorted(parent, p), np.searchsorted(parent, p, "right")
        n = last - first
        at = np.repeat(np.arange(len(p)), n)
        child = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(at))
        if unlike is not None:
            fits = character[child] != unlike[at]
            at, child = at[fits], child[fits]
        wanted = q[at] << 8 | character[child]
        found = np.searchsorted(below_q[3], wanted)
        fits = found < len(below_q[3])
        fits[fits] = below_q[3][found[fits]] == wanted[fits]
        return node[child[fits]], below_q[0][found[fits]]

    none = np.empty(0, np.int64)
    same, more = (none, none), (none, none)
    out = [(none, none)]
    here = edges(depth)
    for k in range(depth, width - 1):
        below = edges(k + 1)
        node, parent, character, _ = here
        # an insertion: the node itself beside each of its children
        own = sizes[parent] == k
        for p, q, far in ((*same, k), (*more, k + 1), (parent[own], node[own], k + 1)):
            ends = (sizes[p] == k) & (sizes[q] == far)
            out.append((p[ends], q[ends]))
        grown = [walked(*more, here, below), walked(parent, node, here, below, character)]
        # a replacement: children of one node beside each other
        opened, step = [walked(*same, here, here)], 1
        while (fits := parent[step:] == parent[:-step]).any():
            opened.append((node[:-step][fits], node[step:][fits]))
            step += 1
        same = tuple(map(np.concatenate, zip(*opened, strict=True)))
        more = tuple(map(np.concatenate, zip(*grown, strict=True)))
        here = below
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _subtree(table: pa.Table) -> pa.Table:
    table = table.sort_by("word") if len(table) > 1 else table
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    # of Latin-1, the order of code points is that of bytes
    p, q = near_pairs(words, table.column("cut")[0].as_py())
    a, b = table.take(pa.array(np.concatenate([p, q]))), table.take(pa.array(np.concatenate([q, p])))
    return pa.table({"word": a.column("word"), "near": b.column("word"), "near_n": b.column("n")})


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n) -> (word, near, near_n), both ways of each pair at distance one.

    ``words`` are distinct, not null, of Latin-1 characters and at least FIRST_DEPTH long.
    """
    # a prefix holds no more words than a shorter one, so a word's crowded prefixes are its shortest
    prefixes = words.select("word", F.explode(F.sequence(F.lit(FIRST_DEPTH), F.length("word"))).alias("d")).withColumn("prefix", F.expr("substring(word, 1, d)"))
    crowded = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MOST_WORDS).select("prefix")
    cuts = prefixes.join(crowded, "prefix").groupBy("word").agg((F.max("d") + 1).alias("cut"))
    cut = materialize(words.sparkSession, words.join(cuts, "word", "left").withColumn("cut", F.coalesce("cut", F.lit(FIRST_DEPTH))), "trie")
    inside = cut.withColumn("prefix", F.expr("substring(word, 1, cut)")).groupBy("prefix").applyInArrow(_subtree, "word string, near string, near_n long")

    # the edit at depth d above the partitions: the rest of the path with and without the character there
    at = cut.select("word", "n", F.explode(F.expr("sequence(0, cut - 1)")).alias("d")).withColumn("c", F.expr("substring(word, d + 1, 1)"))
    whole = at.select("d", F.col("word").alias("path"), "word", "n", "c")
    skipped = at.where("c != ''").select("d", F.expr("concat(substring(word, 1, d), substring(word, d + 2))").alias("path"), "word", "n", "c")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("d", "path", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("c").alias("other"))
        return a.join(b, ["d", "path"]).where("c != other").select("word", "near", "near_n")

    return inside.union(met(skipped, skipped)).union(met(skipped, whole)).union(met(whole, skipped))


def group_variants(docs: DataFrame, changed: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the vocabulary.

    Near words differ by one inserted, deleted or replaced character. A word's form is its most
    frequent near word (ties: the smallest), if TIMES as frequent as the word; else null. The root
    follows forms to the last. Null and empty texts have no words; repeated rows count each; a null
    id counts as empty text where ``changed`` asks for it; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    words = materialize(spark, vocabulary(docs, changed, id_col, text_col), "vocabulary")
    pairs = near_words(words)
    nearest = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(nearest, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f"))
    known = materialize(spark, known.select("word", "n", "n_near", "f.form", "f.form_n"), "variants")
    steps = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(MOST_DOUBLINGS):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = materialize(spark, steps.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return known.join(steps.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
