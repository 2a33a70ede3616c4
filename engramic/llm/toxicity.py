"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and a label says only whether some sentence offends. A sentence's
chance is a logistic function of its words' features; the document's chance combines them by
noisy-or, 1 - prod(1 - p). The weights are trained by gradient steps on the likelihood of the
document labels; afterwards the sentence chances show where the offence is.

Only features that toxic documents have clearly more often than others take part, and training
starts from and is drawn to their log odds, so that a plain insult keeps its weight beside others.
So that long clean texts are not taken for toxic by their length alone, equal sentences count once,
and a sentence beside the worst one counts only from the chance OFFENDS on.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches

#: The expected numbers of toxic and of other documents that the weights are fitted on (the bound),
#: and the most characters that they have together.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 1_500, 3_000, 30_000_000
MODULUS, HELD_OUT = 5, 0
BITS = 18
#: Features take part from so many documents on, and so many standard deviations above chance.
LEAST_DOCUMENTS, LEAST_DEVIATION = 3, 4.0
#: Documents by which log odds are smoothed.
SMOOTH = 5.0
PASSES, BATCHES, RATE, RIDGE, START = 15, 16, 0.3, 1e-3, -6.0
#: Words, and ends of sentences.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
WORD, SPLIT = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]")
#: Chance from which a sentence is reported, and counts beside the worst one.
OFFENDS = 0.1
ENDS = frozenset(".!?\n")
#: Words whose weights a worker remembers at once.
CACHE_WORDS = 500_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word itself and its beginnings of 4 to 6 letters."""
    own = ["=" + word] + [word[:k] for k in (4, 5, 6) if len(word) >= k]
    return [zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in own]


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of each sentence that has words."""
    text = text or ""
    low = text.lower()
    at, start, words = 0, 0, []
    for m in TOKEN.finditer(low):
        if m.group() in ENDS:
            if words:
                yield start, m.end(), words
            start, words = m.end(), []
        else:
            words.append(m.group())
        at = m.end()
    if words:
        yield start, at, words


def fit(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_other: int = TRAIN_OTHER, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> np.ndarray | None:
    """Weights (the last is the bias) from a bounded sample of the labelled documents outside the held-out fold.

    A class of c documents takes part with each one at chance bound / c, by a hash of the id; of
    these, in the order of another hash, as many as have ``train_chars`` characters together. Rows
    repeated in full take part once. Null labels and labels of unknown documents are left out;
    contradicting labels of one document are all used. Without both classes there is no model.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).cast("int").alias("y")).where((fold(F.col("doc_id"), MODULUS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    sizes = {r["y"]: r["c"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    if set(sizes) != {0, 1}:
        return None
    chance = F.when(F.col("y") == 1, F.lit(train_toxic / sizes[1])).otherwise(F.lit(train_other / sizes[0]))
    drawn = (F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    # the sample is bounded, so it goes to the texts; first their lengths, which tell how many fit
    found = texts.join(F.broadcast(marked.where(drawn).distinct()), "doc_id").groupBy("doc_id", "y", "h").agg(F.max(F.length("text")).alias("n"))
    found = found.orderBy(F.xxhash64("doc_id", "h"), "y").limit(2 * (train_toxic + train_other)).collect()
    spent = np.cumsum([r["n"] or 0 for r in found])
    picked = [(r["doc_id"], r["y"], r["h"]) for r, n in zip(found, spent, strict=True) if n <= train_chars]
    if not picked:
        return None
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, y int, h long")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "y", "h").agg(F.first("text").alias("text")).collect()
    return train(sorted((r["doc_id"], r["y"], r["text"] or "") for r in rows))


class Bags:
    """Documents as bags: the features of each distinct sentence, the sentence's document, the labels."""

    def __init__(self, rows: list[tuple[int, int, str]]) -> None:
        cols, sent_of, doc_of, known = array("i"), array("i"), array("i"), {}
        for d, (_, _, text) in enumerate(rows):
            seen: set[frozenset[str]] = set()
            for part in SPLIT.split(text.lower()):
                words = frozenset(WORD.findall(part))
                if words and words not in seen:
                    seen.add(words)
                    for w in words.difference(known):
                        known[w] = features(w)
                    own = {f for w in words for f in known[w]}
                    cols.extend(own)
                    sent_of.extend(repeat(len(doc_of), len(own)))
                    doc_of.append(d)
        self.y = np.asarray([y for _, y, _ in rows], float)
        self.cols, self.sent_of, self.doc_of = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in (cols, sent_of, doc_of))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of toxic and of all documents with each feature."""
        pairs = np.unique(self.doc_of[self.sent_of].astype(np.int64) << BITS | self.cols)
        f = pairs & ((1 << BITS) - 1)
        return np.bincount(f, self.y[pairs >> BITS], 1 << BITS), np.bincount(f, minlength=1 << BITS)

    def keep(self, ok: np.ndarray) -> None:
        some = ok[self.cols]
        self.cols, self.sent_of = self.cols[some], self.sent_of[some]

    def gradient(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.sent_of, w[self.cols], len(self.doc_of)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clear = np.bincount(self.doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(self.y))  # log of the chance that no sentence offends
        bag = np.clip(1 - np.exp(clear), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, p * (1 - 1 / bag) for a toxic one
        g = p * np.where(self.y[self.doc_of] > 0, 1 - 1 / bag[self.doc_of], 1.0)
        grad = np.bincount(self.cols, g[self.sent_of], len(w)) / len(self.y)
        grad[-1] = g.sum() / len(self.y)
        return grad


def train(rows: list[tuple[int, int, str]]) -> np.ndarray | None:
    """Weights for (id, label, text) rows, by steps over batches with a rate of each weight's own."""
    order = np.random.default_rng(1).permutation(len(rows))
    bags = [Bags([rows[i] for i in order[k::BATCHES]]) for k in range(min(BATCHES, len(rows)))]
    n, toxic = len(rows), sum(b.y.sum() for b in bags)
    if not 0 < toxic < n or not any(len(b.doc_of) for b in bags):
        return None
    bad, all_ = (sum(x) for x in zip(*(b.counts() for b in bags), strict=True))
    share = toxic / n
    odds = (bad + SMOOTH * share) / (all_ - bad + SMOOTH * (1 - share)) * (1 - share) / share
    ok = (all_ >= LEAST_DOCUMENTS) & (bad - share * all_ >= LEAST_DEVIATION * np.sqrt(all_ * share * (1 - share)))
    start = np.append(np.where(ok, np.log(odds), 0.0), START)
    w, rates = start.copy(), np.full(len(start), 1e-6)
    for b in bags:
        b.keep(ok)
    for _ in range(PASSES):
        for b in bags:
            grad = b.gradient(w)
            grad[:-1] += RIDGE * (w - start)[:-1]
            rates += grad * grad
            w -= RATE * grad / np.sqrt(rates)
    return w


class Scorer:
    def __init__(self, weights: np.ndarray) -> None:
        self.w, self.bias, self.known = weights, float(weights[-1]), {}

    def logit(self, words: set[str]) -> float:
        try:
            return self.bias + sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for w in words.difference(self.known):
                self.known[w] = float(self.w[features(w)].sum())
            return self.bias + sum(map(self.known.__getitem__, words))

    def __call__(self, text: str | None) -> tuple[float, int | None, int | None, float | None]:
        """Score of the document; start, end and chance of its worst sentence, if that offends."""
        chances, worst, at, n, others = set(), -1.0, 0, 0, 1.0
        for part in SPLIT.split((text or "").lower()):
            if words := set(WORD.findall(part)):
                p = 1 / (1 + math.exp(-min(30.0, max(-30.0, self.logit(words)))))
                if p > worst:
                    worst, at = p, n
                if p >= OFFENDS and (own := frozenset(words)) not in chances:  # equal sentences count once
                    chances.add(own)
                    others *= 1 - p
                n += 1
        if worst < OFFENDS:
            return max(0.0, worst), None, None, None
        start, end, _ = next(islice(sentences(text), at, None))
        return 1 - others, start, end, worst


def score(docs: DataFrame, model: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns but the text's and id's own: doc_id, held_out, score, predicted, worst_start, worst_end, worst_score.

    ``worst_*`` locate the sentence of the greatest chance by code points (null where no
    sentence reaches OFFENDS).
    Texts without words, null ones too, and all texts without a model, score 0. Every whole text is scored;
    repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # 2^BITS weights

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in batches:
            got = [scorer(t) if scorer else (0.0, None, None, None) for t in batch.column("text").to_pylist()]
            s, a, b, p = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.float64())],
                ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), MODULUS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_end long, worst_score double")


def keep_clean(docs: DataFrame, model: np.ndarray | None, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``reject``."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in batches:
            yield batch.filter(pa.array([scorer is None or scorer(t)[0] < reject for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
