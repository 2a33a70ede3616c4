"""Best-fit packing with linear grouping of large lengths.

Documents become pieces of at most one window. Lengths are small integers, so their histogram, one
count a length, holds all that the plan needs, however many pieces there are:

1. Large pieces (above a third of the window), in order of length, fall into groups of equal
   cardinality, and each group's lengths are rounded up to its longest.
2. Those few sizes are packed into configurations: column generation solves the cutting-stock
   relaxation, whole numbers of each configuration are used, and the rest goes first-fit decreasing.
3. Pieces take the places of their group in order of rank, all but the shortest place of a
   configuration, and with their own lengths they leave runs of sequences with equal room.
4. What is left, those for the shortest places and the small ones, goes longest first where it
   leaves least room; what fits nowhere opens sequences.

The plan is a list of runs, (length, from which rank on) -> (first sequence), bounded by the window
and the number of groups. Each piece then finds its sequence by its rank among those of its length:
a prefix sum over the partitions' counts of that length, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .packing import WordIds

END_ID = 0
#: Groups of equal cardinality that large lengths are rounded within.
GROUPS = 32
#: Lengths above the window over this are large.
LARGE = 3

PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("pid", pa.int64()), ("local", pa.int64())]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, pid long, local long"


def most_valued(values: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """How often to take each size so that the sum of the values is greatest and the sizes fit the window."""
    best, taken = np.zeros(window + 1), np.full(window + 1, -1)
    order = np.argsort(sizes)
    sizes, values = sizes[order], values[order]
    for room in range(int(sizes[0]), window + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        gain = best[room - sizes[:fit]] + values[:fit]
        k = int(np.argmax(gain))
        best[room], taken[room] = (gain[k], k) if gain[k] > best[room - 1] else (best[room - 1], -1)
    counts, room = np.zeros(len(sizes), np.int64), window
    while room >= sizes[0]:
        if taken[room] < 0:
            room -= 1
        else:
            counts[order[taken[room]]] += 1
            room -= int(sizes[taken[room]])
    return counts


def configurations(sizes: np.ndarray, demands: np.ndarray, window: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, sequences), together exactly ``demands``.

    The relaxation is solved by column generation; its counts are rounded down and what they leave,
    at most one sequence's worth for each size, is packed first-fit decreasing.
    """
    patterns = np.diag(window // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (window // sizes))
    counts = inverse @ demands
    for _ in range(50 * len(sizes)):
        prices = inverse.sum(axis=0)
        column = most_valued(prices, sizes, window)
        if column @ prices <= 1 + 1e-7:
            break
        change = inverse @ column
        ratios = np.where(change > 1e-9, counts / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(np.argmin(ratios))
        patterns[:, leaves] = column
        counts = np.maximum(counts - ratios[leaves] * change, 0)
        counts[leaves] = ratios[leaves]
        pivot = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, pivot)
        inverse[leaves] = pivot
    left, out = demands.copy(), []
    for k in np.argsort(-counts):
        pattern = patterns[:, k]
        # the basis may be off by rounding errors, so what is left bounds the use
        times = min([int(counts[k] + 1e-6), *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if times > 0:
            out.append((pattern.copy(), times))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros_like(left), window
        for g in np.argsort(-sizes):
            k = min(int(left[g]), room // int(sizes[g]))
            pattern[g], room = k, room - k * int(sizes[g])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


class Rooms:
    """Runs of sequences by the room that they have."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, first: int, end: int, room: int) -> None:
        if end > first and room > 0:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((first, end))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out a run with the least room for ``length``."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, end = self.runs[room].pop()
        if not self.runs[room]:
            del self.rooms[at]
        return first, end, room


def plan(histogram: dict[int, int], window: int, groups: int = GROUPS, large: int = LARGE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ranks at which a run begins, ascending; the sequence of that rank); later ranks of a run go to the next sequences."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    free = {n: [(0, c)] for n, c in histogram.items() if n <= window // large}
    rooms, sequences = Rooms(), 0
    full = histogram.get(window, 0)
    if full:
        runs[window].append((0, 0))
        sequences = full
    lengths = np.array(sorted(n for n in histogram if window // large < n < window), np.int64)
    free |= {int(n): [] for n in lengths}
    if len(lengths):
        counts = np.array([histogram[int(n)] for n in lengths])
        starts = np.concatenate([[0], np.cumsum(counts)])  # ranks among large pieces
        total = int(starts[-1])
        bounds = np.unique(np.arange(groups + 1) * total // groups)
        sizes = lengths[np.searchsorted(starts, bounds[1:] - 1, "right") - 1]
        used = bounds[:-1].copy()  # the next free rank of each group
        for pattern, times in configurations(sizes, np.diff(bounds), window):
            slots = []
            # the shortest place is left to the best fit below, which finds closer matches than a group's rank does
            for g in np.repeat(np.arange(len(sizes)), pattern)[::-1][: max(1, int(pattern.sum()) - 1)]:
                slots.append(int(used[g]))
                used[g] += times
            # within the run, lengths change where a slot's ranks pass from one length to the next
            cuts = {0, times}
            for slot in slots:
                inner = starts[np.searchsorted(starts, slot, "right") : np.searchsorted(starts, slot + times, "left")]
                cuts.update((inner - slot).tolist())
            for lo, hi in zip(ordered := sorted(cuts), ordered[1:], strict=False):
                room = window
                for slot in slots:
                    k = int(np.searchsorted(starts, slot + lo, "right")) - 1
                    room -= int(lengths[k])
                    runs[int(lengths[k])].append((slot + lo - int(starts[k]), sequences + lo))
                rooms.put(sequences + lo, sequences + hi, room)
            sequences += times
        for g, end in enumerate(bounds[1:].tolist()):
            rank = int(used[g])
            while rank < end:
                k = int(np.searchsorted(starts, rank, "right")) - 1
                upto = min(end, int(starts[k + 1]))
                free[int(lengths[k])].append((rank - int(starts[k]), upto - rank))
                rank = upto
    for length in sorted(free, reverse=True):
        for rank, left in free[length]:
            while left:
                found = rooms.tightest(length)
                if not found:
                    found = sequences, sequences + -(-left // (window // length)), window
                    sequences = found[1]
                first, end, room = found
                each = min(room // length, left)
                many = min(end - first, left // each)
                for k in range(each):
                    runs[length].append((rank + k * many, first))
                rooms.put(first, first + many, room - each * length)
                rooms.put(first + many, end, room)
                rank, left = rank + each * many, left - each * many
    return {n: tuple(np.array(c, np.int64) for c in zip(*sorted(r), strict=True)) for n, r in runs.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int, keep_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES of each text: pid is the partition, local the rank among the partition's pieces of one length."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, pid = WordIds.shared(tokenizer_path), TaskContext.get().partitionId()
        end, met = np.asarray([END_ID], "<u4").tobytes(), np.zeros(window + 1, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * window)):
                    own = ids[at : at + 4 * window]
                    rows.append((doc, k, at >> 2, len(own) >> 2, zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            local = np.empty(len(rows), np.int64)
            for i, n in enumerate(columns[3]):
                local[i] = met[n]
                met[n] += 1
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, PIECE_FIELDS, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), pid, np.int64)), pa.array(local)], [n for n, _ in PIECE_FIELDS])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless ``keep_ids``).

    Only documents longer than the window are cut, at its multiples. A null or empty text is a
    document of the closing id alone; repeated rows and null ids are documents like others; an empty
    table gives no pieces; other columns are not read. In a sequence, the longest piece comes first.
    """
    stored = materialize(docs.sparkSession, cut_pieces(docs, tokenizer_path, window, keep_ids, id_col, text_col), "pieces")
    counts = stored.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    # one count a length: bounded by the window
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored.join(bases, ["pid", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "pid")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = lengths == n
                starts, first = runs[int(n)]
                k = np.searchsorted(starts, ranks[at], "right") - 1
                sequence[at] = first[k] + ranks[at] - starts[k]
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence)})

    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, rank long, sequence_id long")
    # a sequence holds at most as many pieces as the window has ids
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), "ids")
