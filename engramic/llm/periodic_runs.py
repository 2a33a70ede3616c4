"""Runs of words that repeat with a period, by Karp-Miller-Rosenberg naming.

The words of a batch of texts get numbers (names of level 0, distinct between texts). A name of
level k stands for 2^k words: names of pairs of names of level k - 1, 2^(k-1) words apart. Blocks are
equal if and only if their names are, so no hash is compared, and the longest common extension of two
places follows by descending the levels. Levels end where no text has an equal pair of blocks left.

A run of period p and at least LEAST_COPIES * p (and LEAST_LENGTH) words holds two equal blocks p
apart at some place of a grid, for every grid not coarser than the run is long. Such candidates are
extended both ways; of runs with the same extent the least period counts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST_LENGTH, LEAST_COPIES = 24, 3
#: Level of the first block that every run repeats: 2^3 words, for LEAST_LENGTH less any period below 8 leaves room for 8.
FIRST_LEVEL = 3
#: Words of short texts that are searched together, and candidates that are extended at once.
BATCH_WORDS, BATCH_CANDIDATES = 1 << 18, 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def named(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's number in order, and how many there are."""
    order = np.argsort(values, kind="stable")
    inner = values[order]
    fresh = np.empty(len(values), bool)
    if len(values):
        fresh[0] = True
        np.not_equal(inner[1:], inner[:-1], out=fresh[1:])
    names = np.empty(len(values), np.int32)
    names[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return names, int(fresh.sum())


def next_level(names: np.ndarray, half: int) -> tuple[np.ndarray, int]:
    """Names of blocks of twice ``half`` words; blocks that cross the end of a text are unlike all others."""
    pairs = names[:-half].astype(np.int64) << 32 | names[half:]
    return named(pairs)


class Names:
    """Names of all levels that still have equal blocks, over texts laid end to end.

    Word numbers are distinct between texts, so blocks of different texts are never equal.
    """

    def __init__(self, words: np.ndarray, most: int | None = None) -> None:
        self.levels = [words]
        while len(self.levels) - 1 != most and len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            names, n = next_level(self.levels[-1], 1 << (len(self.levels) - 1))
            if n == len(names):
                break
            self.levels.append(names)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b (a < b) on."""
        far = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            names = self.levels[level]
            for _ in range(1 if level < len(self.levels) - 1 else 2):  # beyond the last level no two blocks agree
                x, y = a + far, b + far
                fits = y < len(names)
                fits[fits] = names[x[fits]] == names[y[fits]]
                far += fits.astype(np.int64) << level
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and b (a < b)."""
        far = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            names = self.levels[level]
            for _ in range(1 if level < len(self.levels) - 1 else 2):
                x, y = a - far - (1 << level), b - far - (1 << level)
                fits = (x >= 0) & (y < len(names))
                fits[fits] = names[x[fits]] == names[y[fits]]
                far += fits.astype(np.int64) << level
        return far


def grids(starts: np.ndarray, sizes: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, periods, level) of candidates, at most about BATCH_CANDIDATES at once.

    A run of period p covers at least m = max(LEAST_LENGTH, LEAST_COPIES * p) words, so from its
    start on m - p places agree with those p further on. Blocks of 2^level <= m - p words that begin at
    a grid place of step m - p - 2^level + 1 or less are among them.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    amount, at = 0, FIRST_LEVEL
    longest = int(sizes.max(initial=0)) // LEAST_COPIES
    for p in range(1, longest + 1):
        most = max(LEAST_LENGTH, LEAST_COPIES * p)
        level = max(FIRST_LEVEL, p.bit_length() - 1)
        if level > top:
            break
        if held and (level != at or amount >= BATCH_CANDIDATES):
            yield *map(np.concatenate, zip(*held, strict=True)), at
            held, amount = [], 0
        at = level
        step = most - p - (1 << level) + 1
        fits = sizes >= most
        n = (sizes[fits] - p - (1 << level)) // step + 1
        ends = np.cumsum(n)
        if len(ends):
            places = np.repeat(starts[fits] - (ends - n) * step, n) + np.arange(ends[-1]) * step
            held.append((places, np.full(len(places), p)))
            amount += len(places)
    if held:
        yield *map(np.concatenate, zip(*held, strict=True)), at


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts laid end to end, by start and then period; word numbers are distinct between texts."""
    names = Names(words, FIRST_LEVEL)
    found = [np.empty((0, 3), np.int64)]
    if len(names.levels) > FIRST_LEVEL:
        # texts without an equal pair of first blocks hold no run; the others alone are named on
        first = names.levels[FIRST_LEVEL]
        repeated = np.bincount(first)[first] > 1
        before = np.concatenate([[0], np.cumsum(repeated)])
        hit = before[np.minimum(starts + sizes, len(first))] > before[np.minimum(starts, len(first))]
        from_, sizes = starts[hit], sizes[hit]
        starts = np.cumsum(sizes) - sizes
        names = Names(words[np.repeat(from_ - starts, sizes) + np.arange(sizes.sum())])
        for place, period, level in grids(starts, sizes, len(names.levels) - 1):
            level_names = names.levels[level]
            same = place + period < len(level_names)
            same[same] = level_names[place[same]] == level_names[(place + period)[same]]
            place, period = place[same], period[same]
            start = place - names.backward(place, place + period)
            end = place + period + names.forward(place, place + period)
            keep = end - start >= np.maximum(LEAST_LENGTH, LEAST_COPIES * period)
            if keep.any():
                extents = np.unique(np.stack([start[keep], end[keep], period[keep]], axis=1), axis=0)
                moved = (from_ - starts)[np.searchsorted(starts, extents[:, 0], "right") - 1]
                found.append(extents + moved[:, None] * [1, 1, 0])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # an extent that several periods share has the least as its period
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def kept_words(n: int, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """True for words that no run contains after its first copy of the period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges)[:n] == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that a test text takes: one in ten, by the id's checksum, gets a tail that repeats."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, rearranged: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (words kept, joined by blanks).

    Words are stretches without ``[\\x20\\x09-\\x0D]``. A run is a stretch of words with least period p,
    at least max(24, 3 * p) words long, that no neighbouring word extends. ``collapsed`` leaves out
    what runs contain after their first p words. ``rearranged(doc_id, n)`` may give the places of the
    words to take in place of the text's own order. Null and empty texts have no words and no runs;
    repeated rows and null ids are rows like others; an empty table gives no rows; other columns
    are not read. Each text is searched by itself, so nothing is shuffled; memory is about 4 bytes
    for each word and level of the longest text.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        amount = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split() if text else []  # bytes are split at ASCII blanks alone
                if rearranged is not None and (places := rearranged(doc, len(words))) is not None:
                    words = [words[i] for i in places.tolist()]
                if held and amount + len(words) > BATCH_WORDS:
                    yield searched(held)
                    held, amount = [], 0
                held.append((doc, words))
                amount += len(words)
        if held:
            yield searched(held)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, SCHEMA)


def searched(texts: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    sizes = np.array([len(w) for _, w in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    numbers, fresh = np.empty(int(sizes.sum()), np.int32), count()
    for (_, words), at in zip(texts, starts.tolist(), strict=True):
        own: dict[bytes, int] = defaultdict(fresh.__next__)
        numbers[at : at + len(words)] = [own[w] for w in words]
    start, end, period = find_runs(numbers, starts, sizes)
    first = np.searchsorted(start, starts)
    last = np.searchsorted(start, starts + sizes)
    collapsed = []
    for (_, words), at, i, j in zip(texts, starts.tolist(), first.tolist(), last.tolist(), strict=True):
        if i < j:
            keep = kept_words(len(words), start[i:j] - at, end[i:j] - at, period[i:j])
            words = [words[k] for k in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(words))
    local = start - np.repeat(starts, last - first)
    fields = pa.StructArray.from_arrays([pa.array(local, pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first)]), pa.int32()), fields)
    columns = [pa.array([d for d, _ in texts], pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def digest(found: DataFrame) -> DataFrame:
    """One row per text: doc_id, n_runs, the run of greatest length / period (ties: least start, then period), and checksums of runs and collapsed text."""

    # a quotient of whole numbers is compared by cross products; runs are in order of start and period
    better = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> CASE WHEN a IS NULL OR r.length * a.period > a.length * r.period THEN r ELSE a END)"
    lines = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')"
    return found.withColumn("best", F.expr(better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
