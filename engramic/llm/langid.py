"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes, of order 0 to 3, counts what follows
each context. A byte seen n times among T after a context with d distinct successors has
probability n / (T + d) there, and the escape to the next shorter context d / (T + d); below order
0 all 256 bytes are equally likely. Once frozen, the code length of a byte depends on the three
bytes before it alone, so the trees of all languages are laid out as one table of code lengths by
byte 4-gram, with the escape path worked out in advance; 4-grams in no tree escape to 3-grams, and
these to a dense table of pairs. A text's score is the sum of its exact code lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches

#: The expected number of training documents of each language, the bound of what the driver fits on.
TRAIN_DOCS, TRAIN_CHARS = 400, 4_000_000
#: Characters of a text that is learned from, at most.
LONGEST = 200_000
MODULUS, HELD_OUT = 3, 1
#: Bytes scored in one step.
STEP = 1 << 20
#: ASCII letters in lower case, other ASCII as blanks, bytes of other characters as they are.
FOLD_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
LEAD = b"   "


def folded(text: str) -> bytes:
    """Three blanks, the words between single blanks, and a blank."""
    return LEAD + b" ".join(text.encode("utf-8", "replace").translate(FOLD_BYTES).split()) + b" "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram ending at each byte from the fourth on."""
    key = np.zeros(len(data) - 3, np.uint32)
    for i in range(n):
        at = 4 - n + i
        key = (key << np.uint32(8)) | data[at : at + len(key)]
    return key


class Model:
    """Frozen code lengths (bits) of all languages; ``langs`` is in ascending order."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        data = {lang: [np.frombuffer(t, np.uint8).astype(np.uint32) for t in texts[lang]] for lang in self.langs}
        counts = {n: [np.unique(np.concatenate([_grams(d, n) for d in data[lang]]), return_counts=True) for lang in self.langs] for n in (1, 2, 3, 4)}
        k = len(self.langs)
        shorter = np.full((256, k), 8.0)  # below order 0
        keys = np.arange(256, dtype=np.uint32)
        for n in (1, 2, 3, 4):
            grams = np.unique(np.concatenate([c[0] for c in counts[n]])) if n > 2 else np.arange(256**n, dtype=np.uint32)
            tail = grams & np.uint32(256 ** (n - 1) - 1) if n > 1 else grams
            below = self._lookup(tail, n - 1, keys, shorter) if n > 1 else shorter
            cost, contexts, escapes = np.empty((len(grams), k)), [], []
            for j, (seen, c) in enumerate(counts[n]):
                ctx, first, d = np.unique(seen >> np.uint32(8), return_index=True, return_counts=True)
                total = np.add.reduceat(c, first)
                at = np.minimum(np.searchsorted(ctx, grams >> np.uint32(8)), len(ctx) - 1)
                known = ctx[at] == grams >> np.uint32(8)
                cost[:, j] = below[:, j] + np.where(known, np.log2((total[at] + d[at]) / d[at]), 0.0)
                own = np.searchsorted(grams, seen)
                cost[own, j] = np.log2((total + d).repeat(d) / c)
                contexts.append(ctx)
                escapes.append(np.log2((total + d) / d))
            every = np.unique(np.concatenate(contexts))
            escape = np.zeros((len(every) + 1, k))
            for j in range(k):
                escape[np.searchsorted(every, contexts[j]), j] = escapes[j]
            setattr(self, f"keys{n}", grams)
            setattr(self, f"cost{n}", cost)
            setattr(self, f"contexts{n}", every)
            setattr(self, f"escape{n}", escape)
            keys, shorter = grams, cost

    def _lookup(self, grams: np.ndarray, n: int, keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Code lengths (a row per n-gram) by way of the tables up to order n - 1."""
        if n <= 2:
            return cost[grams]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out, absent = cost[at], keys[at] != grams
        if absent.any():
            some = grams[absent]
            contexts, escape = getattr(self, f"contexts{n}"), getattr(self, f"escape{n}")
            ctx = np.minimum(np.searchsorted(contexts, some >> np.uint32(8)), len(contexts) - 1)
            ctx = np.where(contexts[ctx] == some >> np.uint32(8), ctx, len(contexts))
            tail = some & np.uint32(256 ** (n - 1) - 1)
            out[absent] = escape[ctx] + self._lookup(tail, n - 1, getattr(self, f"keys{n - 1}"), getattr(self, f"cost{n - 1}"))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each folded text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        owner = np.concatenate([np.full(len(t) - 3, i) for i, t in enumerate(texts)])
        grams = np.concatenate([_grams(np.frombuffer(t, np.uint8).astype(np.uint32), 4) for t in texts])
        for lo in range(0, len(grams), STEP):
            cost, who = self._lookup(grams[lo : lo + STEP], 4, self.keys4, self.cost4), owner[lo : lo + STEP]
            starts = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[starts]] += np.add.reduceat(cost, starts)
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a sample of the labelled documents outside the held-out fold; None without any.

    A language with c such documents of s characters takes part with each one at chance
    min(train_docs / c, train_chars / s), decided by a hash of its id and text. So the sample is
    bounded in rows and characters at any size of the corpus, whatever its ids are: rows with null or
    repeated ids are drawn apart as their texts differ. Texts longer than LONGEST are not learned from.
    """
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    seen = seen.where((fold(F.col("doc_id"), MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") <= LONGEST))
    seen = seen.withColumn("place", F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").isNull(), "doc_id", "text"), F.lit(1 << 30)))
    # a row per language; its first text is learned from where no other is drawn
    sizes = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("text").cast("long")).alias("s"), F.min(F.struct("place", "text"))["text"].alias("first")).collect()
    share = [F.when(F.col("lang") == r["lang"], F.lit(min(train_docs / r["c"], train_chars / max(1, r["s"])))) for r in sizes]
    drawn = F.col("place") / F.lit(float(1 << 30)) < (F.coalesce(*share) if share else F.lit(0.0))
    # one of each text: rows that repeat one have one hash and are drawn together
    rows = [(r["lang"], r["text"]) for r in seen.where(drawn).select("lang", "text").distinct().orderBy("lang", "text").collect()]
    got = {lang for lang, text in rows if has_letter(text)}
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows + [(r["lang"], r["first"]) for r in sizes if r["lang"] not in got]:
        if has_letter(text):
            texts.setdefault(lang, []).append(folded(text))
    return Model(texts) if texts else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits.

    ``lang_pred`` is the language of the least code length (of equal ones the first by name), and
    ``und`` where the text is null or has no letter, or no language was learned; ``score`` is the
    posterior of the languages under equal priors, 0 for ``und``. ``bits`` is the code length per
    byte. Every whole text is scored; repeated rows are scored alike; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # as large as the training sample allows

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ok = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            pred, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if ok:
                codes = [folded(texts[i]) for i in ok]
                cost = model.lengths(codes)
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(ok)), best]
                posterior = 1.0 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
                for i, b, p, c, code in zip(ok, best, posterior, least, codes, strict=True):
                    pred[i], score[i], bits[i] = model.langs[b], float(p), float(c) / (len(code) - 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "bits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), MODULUS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, held_out boolean, lang_pred string, score double, bits double")
