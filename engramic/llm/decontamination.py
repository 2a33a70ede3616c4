"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into overlapping probes. A stretch of a document within k edits of a probe
of m characters shares at least m + 1 - q (k + 1) of its q-grams with it, all on diagonals (place in
the document minus place in the probe) within k of each other. Shared q-grams are counted in
overlapping bands of diagonals, bands that meet the bound are kept, and each is verified by a
banded alignment. Nothing within the edit budget is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Q = 8
#: Characters of a probe, the step between probes, and edits per character. A stretch of
#: PROBE + STEP - 1 characters of a benchmark text is always found, wherever it begins.
PROBE, STEP, EDITS = 64, 16, 0.065
#: Texts of fewer normalised characters, some five words, are no evidence and are not searched;
#: those of fewer than HALF are searched as they stand, without edits.
LEAST, HALF = 24, 32
#: Characters of benchmark text that one pass over the documents holds (the bound of a broadcast).
BLOCK_CHARS = 8_000_000
#: Characters of a document that are searched at once; neighbouring pieces overlap by two probes.
PIECE = 1 << 20

#: Characters that the quick look takes at a time, so that its arrays stay in the processor's cache.
LOOK = 1 << 16

_BITS = 20
_MUL = np.uint32(0x9E3779B1)


def _fold_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter or digit, or 32 for all else, in the basic plane."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000 or not chr(c).isalnum():
            continue
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


class Folder:
    """Normalised code points of a text, and their places in it: letters and digits in lower case, runs of all else as one blank."""

    def __init__(self) -> None:
        self.table = _fold_table()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.table.take(points, mode="clip")
        if len(points) and points.max() > 0xFFFF:
            low = np.where(points > 0xFFFF, points, low)
        keep = low != 32
        keep[1:] |= keep[:-1].copy()
        places = np.flatnonzero(keep)
        return low[places], places


def qgrams(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q code points from each place on; collisions only add to the counts."""
    if len(points) < Q:
        return np.empty(0, np.uint32)
    h = points
    width = 1
    while width < Q:  # doubling: 1, 2, 4, 8
        x = h[width:] >> np.uint32(15)
        x ^= h[width:]
        h = h[:-width] * _MUL
        h += x
        width *= 2
    h *= _MUL
    return h


def edit_distance_within(probe: np.ndarray, text: np.ndarray, k: int) -> int | None:
    """Least edits between ``probe`` and any stretch of ``text``, if at most k."""
    m = len(probe)
    for a in np.flatnonzero(text[: len(text) - m + 1] == probe[0]):
        if np.array_equal(text[a : a + m], probe):
            return 0
    row = np.arange(m + 1)
    steps = np.arange(m + 1)
    best = row[m]
    for c in text:  # one column per character of the stretch; a stretch is as long as the probe and its band
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + (probe != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, row[m])
    return int(best) if best <= k else None


class Probes:
    """Index of the probes of some benchmark texts by q-gram."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        folder = Folder()
        self.points, self.item, self.budget = [], [], []
        grams, owner, place = [], [], []
        for item, text in items:
            points, _ = folder(text)
            points = points[int(len(points) > 0 and points[0] == 32) : len(points) - int(len(points) > 0 and points[-1] == 32)]
            if len(points) < LEAST:
                continue
            last = max(0, len(points) - PROBE)
            for lo in sorted({*range(0, last, STEP), last}):
                p = points[lo : lo + PROBE]
                g = qgrams(p)
                grams.append(g)
                owner.append(np.full(len(g), len(self.points)))
                place.append(np.arange(len(g)))
                self.points.append(p)
                self.item.append(item)
                self.budget.append(math.floor(EDITS * len(p)) if len(p) >= HALF else 0)
        if not self.points:
            return
        grams, owner, place = (np.concatenate(x) for x in (grams, owner, place))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.k = np.asarray(self.budget)
        self.m = np.asarray([len(p) for p in self.points])
        self.need = self.m + 1 - Q * (self.k + 1)
        self.least, self.span = int(self.need.min()), int((self.m + self.k).max())
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint32(32 - _BITS)] = True

    def _rich(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shared q-grams that lie among enough others for any probe at all, and all q-grams."""
        g = qgrams(points)
        hit = np.flatnonzero(self.seen[g >> np.uint32(32 - _BITS)])
        if len(hit) < self.least:
            return hit[:0], g
        ahead = np.searchsorted(hit, hit + self.span, "left") - np.arange(len(hit))
        rich = np.flatnonzero(ahead >= self.least)
        cover = np.zeros(len(hit) + 1, np.int64)
        np.add.at(cover, rich, 1)
        np.add.at(cover, rich + ahead[rich], -1)
        return hit[np.cumsum(cover[:-1]) > 0], g

    def suspects(self, texts: list[str], folder: Folder) -> list[int]:
        """Texts that have such places; short texts are looked at together, long ones in pieces."""
        out: set[int] = set()
        if not self.points:
            return []
        ends = np.cumsum([len(t) + 1 for t in texts])
        points, places = folder("\n".join(texts))
        for lo in range(0, len(points), LOOK):
            hit, _ = self._rich(points[lo : lo + LOOK + self.span + Q])
            out.update(np.searchsorted(ends, np.unique(places[hit + lo]), "right").tolist())
        return sorted(out)

    def search(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Probe, edits, and the stretch (places in ``points``) of each match."""
        hit, g = self._rich(points)
        if not len(hit):
            return
        lo, hi = np.searchsorted(self.grams, g[hit], "left"), np.searchsorted(self.grams, g[hit], "right")
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        probe, at = self.owner[entry], np.repeat(hit, n)
        diagonal = at - self.place[entry]
        # two sets of bands, k + 1 wide steps and 2 (k + 1) wide bands, so that any k + 1 diagonals lie within one
        width = self.k[probe] + 1
        band = (diagonal + PROBE) // width
        found: set[tuple[int, int]] = set()
        for shift in (0, 1):
            key = probe.astype(np.int64) * (1 << 40) + (band + shift) // 2
            keys, counts = np.unique(key, return_counts=True)
            ok = keys[counts >= self.need[keys >> 40]]
            for x in ok.tolist():
                p = x >> 40
                w = int(self.k[p]) + 1
                found.add((p, (2 * (x & (1 << 40) - 1) - shift) * w - PROBE))
        for p, d in sorted(found):
            k = self.budget[p]
            a, b = max(0, d - k), min(len(points), d + 2 * (k + 1) + len(self.points[p]) + k)
            edits = edit_distance_within(self.points[p], points[a:b], k)
            if edits is not None:
                yield p, edits, max(0, d), min(len(points), d + 2 * (k + 1) + len(self.points[p])) - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per leak: doc_id, item_id, start, end, edits; documents without leaks have none.

    A leak is a document that has, after normalisation, a stretch within EDITS of a probe of the
    benchmark text; ``start`` and ``end`` (code points of the document) enclose all its stretches,
    ``edits`` is the least of a probe. Texts of fewer than LEAST characters, null and empty ones
    neither leak nor are leaked (``not_searched`` lists those of the benchmark). Repeated documents are reported once each, repeated items with
    each id; null ids are reported as null. Other columns are not read. The benchmark is a stated
    query set: it is searched in blocks of BLOCK_CHARS characters, one pass over the documents each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") >= LEAST)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [_pass(rows, block) for block in _blocks(items)]
    out = parts[0] if parts else spark.createDataFrame([], "doc_id long, item_id long, start long, end long, edits int")
    for part in parts[1:]:
        out = out.union(part)
    return out


def not_searched(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, n of the benchmark rows that ``find_leaks`` leaves out: n normalised characters (0 for null) are below LEAST.

    So few characters stand in many texts that do not come from the benchmark.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            n = [len(folder(t)[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n, pa.int32())], ["item_id", "n"])

    return items.mapInArrow(kernel, "item_id long, n int").where(F.col("n") < LEAST)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.distinct().sort("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def _pass(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    # built once; as large as BLOCK_CHARS characters make it
    held = rows.sparkSession.sparkContext.broadcast(Probes(block))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, folder = held.value, Folder()
        for batch in batches:
            out = []
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for i in probes.suspects(texts, folder):
                doc, text = ids[i], texts[i]
                points, places = folder(text)
                leaks: dict[int | None, tuple[int, int, int]] = {}
                for lo in range(0, max(1, len(points)), PIECE):
                    for p, edits, a, b in probes.search(points[lo : lo + PIECE + 2 * PROBE]):
                        a, b = int(places[lo + a]), int(places[min(len(places) - 1, lo + b)]) + 1
                        x, y, e = leaks.get(probes.item[p], (a, b, edits))
                        leaks[probes.item[p]] = (min(a, x), max(b, y), min(e, edits))
                out += [(doc, item, a, b, e) for item, (a, b, e) in leaks.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32()], strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

    return rows.mapInArrow(kernel, "doc_id long, item_id long, start long, end long, edits int")
