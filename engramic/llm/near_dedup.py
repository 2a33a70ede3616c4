"""MinHash near-dedup by tensored banding.

Two small collections of bands, A and B, each of ``BANDS`` bands of ``ROWS`` minhashes, make
``BANDS`` x ``BANDS`` table keys by pairing an A band with a B band: 84 minhashes serve 196 tables
of 6 rows, which would need 1,176 on their own. Documents with equal shingle sets first become one
class. A pair of classes at similarity s shares a table unless all A bands or all B bands differ:
2 * (1 - s^3)^14, which is 9e-5 at s = 0.8 and falls fast above.

Candidates are confirmed on the full shingle sets. To keep large groups linear, each bucket of a few
tables first links its members to one of them, then each component in it to one other; connected
components follow each time. What is left are pairs of different components that share a table.
They meet under the A band that they share (under the whole table key where many would): one large
component of a bucket in chunks against the few rows outside it, and only those among each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import connected_components

BANDS, ROWS = 14, 3
K = 2 * BANDS * ROWS
#: Minhashes of a sketch, a byte each; the first K are those of the bands. Pairs that agree on fewer
#: than LEAST_AGREEING are not confirmed: at similarity 0.8 the count is binomial(168, 0.8), which
#: is below 108 with a chance of 1e-6.
SKETCH, LEAST_AGREEING = 2 * K, 108
#: Bits of the map behind a sketch: one is set for each shingle's first bits.
MAP_BITS = 2048
WIDTH = SKETCH + MAP_BITS // 8
#: Words whose hashes a worker remembers at once.
CACHE_WORDS = 500_000
#: Tables (pairs of an A band and the B band of the same number) that are looked at first.
FIRST_TABLES = 8
#: Rows outside a bucket's largest component that are compared with each other in one step, and rows
#: of that component that they are compared with in one step.
BLOCK, CHUNK = 512, 4096

_SEEDS = np.random.default_rng(20_240_131).integers(1, 2**63, size=(SKETCH, 2), dtype=np.uint64)
_MUL, _ADD = (_SEEDS[:, 0] >> np.uint64(20)).astype(np.uint32) | np.uint32(1), (_SEEDS[:, 1] >> np.uint64(20)).astype(np.uint32)
_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    return h ^ (h >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text, by a memory of word hashes."""

    def __init__(self, words: int) -> None:
        self.n, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks
        if not words:
            return np.empty(0, np.uint64)
        try:
            ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(self.known))
            ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))
        h = np.full(len(ids) - n + 1, np.uint64(n))
        for i in range(n):
            h = _mix(h * _P1 + ids[i : len(ids) - n + 1 + i])
        return np.unique(h)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """SKETCH minhashes, by multiply-add permutations of 32 bits of the hashes."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):  # 1,024 columns of a matrix stay in the cache
        np.minimum(out, (x[None, lo : lo + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out.astype(np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _key(shingles: bytes) -> tuple[int, int]:
    key = xxhash.xxh3_128_digest(shingles)
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, at, n, k1, k2 (128 bits of the set), bands (long per band), sketch (a byte per minhash, and the map)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingles(words)
        weights = _SEEDS[:ROWS, 0] | np.uint64(1)
        for batch in batches:
            n, k1, k2, bands, sketch = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle(text.as_py())
                n.append(len(s))
                for out, k in zip((k1, k2), _key(s.tobytes()), strict=True):
                    out.append(k)
                if not len(s):
                    bands.append([])
                    sketch.append(b"")
                    continue
                m = _mix(minhashes(s))
                bits = np.zeros(MAP_BITS, bool)
                bits[s >> np.uint64(53)] = True
                sketch.append((m >> np.uint64(56)).astype(np.uint8).tobytes() + np.packbits(bits).tobytes())
                band = (m[:K].reshape(2 * BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)
                bands.append(_signed(_mix(band + np.arange(2 * BANDS, dtype=np.uint64) * _P1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("at"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["rid", "doc_id", "at", "n", "k1", "k2", "bands", "sketch"],
            )

    return docs.mapInArrow(kernel, "rid long, doc_id long, at long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def shingle_sets(wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted distinct 64-bit hashes as bytes) of those of wanted(id, k1, k2, text) whose text has the wanted set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, done = Shingles(words), set()
        for batch in batches:
            ids, sets = [], []
            for i, text, x, y in zip(*(batch.column(c) for c in ("id", "text", "k1", "k2")), strict=True):
                if i.as_py() not in done:  # a row may be repeated in full
                    own = shingle(text.as_py()).tobytes()
                    if _key(own) == (x.as_py(), y.as_py()):
                        done.add(i.as_py())
                        ids.append(i.as_py())
                        sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    return wanted.mapInArrow(kernel, "id long, shingles binary")


def _possible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches and maps of sets of nx and ny shingles allow the similarity.

    Each bit of one map that the other lacks stands for a shingle that is not shared, which bounds
    the intersection whatever the hashes.
    """
    near = (x[..., :SKETCH] == y[..., :SKETCH]).sum(axis=-1) >= LEAST_AGREEING
    p, q = (np.ascontiguousarray(z[..., SKETCH:]).view(np.uint64) for z in (x, y))
    both = np.minimum(nx - np.bitwise_count(p & ~q).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(q & ~p).sum(axis=-1, dtype=np.int64))
    return near & (100 * both >= percent * (nx + ny - both))


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in ("sa", "sb"))
            keep = pa.array(_possible(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(kernel, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    spark = pairs.sparkSession
    pairs = materialize(spark, pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = classes.join(ids, "id").select("id", "k1", "k2", F.col("at").alias("_at"), F.col("doc_id").alias("_doc"))
    # the one row of a class, not all copies of its text
    wanted = texts.join(wanted, (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "k1", "k2", "text")
    sets = shingle_sets(wanted, words).groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = materialize(spark, sets, "sets")
    near = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return near.mapInArrow(kernel, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with their root; a row without a link is its own."""
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _first_tables(classes: DataFrame) -> DataFrame:
    """id, key of the first tables."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("bands")[i], F.col("bands")[BANDS + i]) for i in range(FIRST_TABLES)])
    return classes.select("id", F.explode(keys).alias("key"))


def _stars(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's leader and one member of each other component in it, from (key, id, root)."""
    groups = rooted.groupBy("key", "root").agg(F.min("id").alias("id"))
    lead = groups.groupBy("key").agg(F.min(F.struct("root", "id")).alias("lead"), F.max("root").alias("z")).where("lead.root != z").select("key", F.col("lead.id").alias("a"), F.col("lead.root").alias("r"))
    return groups.join(lead, "key").where("root != r").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _mixed(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of buckets that span components, with main (the largest component), large (its rows) and small (all others)."""
    member = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("y")]
    groups = rows.groupBy(*by, "root").agg(*member)
    buckets = groups.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("k > 1")
    # of buckets with equal members the first holds the pairs of all
    first = buckets.groupBy("n", "x", "y").agg(F.min(F.struct(*by, "main")).alias("b"))
    first = first.select(*[F.col(f"b.{c}").alias(c) for c in by], F.col("b.main.root").alias("main"), F.col("b.main.c").alias("large"), (F.col("n") - F.col("b.main.c")).alias("small"))
    return rows.join(first, by)


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of each bucket dealt to groups (p, q): block p against block q of the small part, and chunk -1 - p of the main component against block q."""
    blocks, chunks = F.ceil(F.col("small") / F.lit(BLOCK)).cast("int"), F.ceil(F.col("large") / F.lit(CHUNK)).cast("int")
    main = F.col("root") == F.col("main")
    own = F.when(main, -1 - F.pmod(F.xxhash64("id"), chunks)).otherwise(F.pmod(F.xxhash64("id"), blocks)).cast("int")
    rows = rows.withColumns({"own": own, "others": F.sequence(F.lit(0), blocks - 1), "chunks": F.sequence(F.lit(1), chunks)})
    with_small = F.transform("others", lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    with_main = F.transform("chunks", lambda c: F.struct((-c).alias("p"), F.col("own").alias("q")))
    return rows.withColumn("pq", F.explode(F.when(main, with_small).otherwise(F.concat(with_small, with_main)))).select(*by, "pq.p", "pq.q", "own", "id", "root")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of rows sorted by ``by``, as columns; sketches and bands as matrices."""
    rest: pa.Table | None = None

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        out = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("sketch", "bands")}
        out["bands"] = pc.list_flatten(t.column("bands")).to_numpy().reshape(-1, 2 * BANDS)
        out["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH)
        return out

    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        own = [rest.column(c).to_numpy() for c in by]
        starts = np.flatnonzero(np.any([np.diff(x) != 0 for x in own], axis=0)) + 1
        if len(starts):
            done = columns(rest.slice(0, int(starts[-1])))
            for lo, hi in zip([0, *starts[:-1]], starts, strict=True):
                yield {c: x[lo:hi] for c, x in done.items()}
            rest = rest.slice(int(starts[-1]))
    if rest is not None and len(rest):
        yield columns(rest)


def _across(classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a table, but no component, and whose sizes and sketches allow the similarity.

    They meet under each A band that they share; where a bucket of an A band has more than BLOCK
    rows outside its largest component, under each table key with that band. A pair is looked at
    under the first A band, or the first table, that it shares by its band values, so it comes up once.
    """
    rows = _rooted(classes.select("id", "bands"), roots)
    under_a = _mixed(rows.select("id", "root", F.posexplode(F.slice("bands", 1, BANDS)).alias("i", "v")), ["i", "v"])
    few = _dealt(under_a.where(F.col("small") <= BLOCK), ["i", "v"]).select("i", "v", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w"), "p", "q", "own", "id", "root")
    many = under_a.where(F.col("small") > BLOCK).select("id", "root", "i", "v").join(classes.select("id", "bands"), "id")
    table = ["i", "v", "j", "w"]
    many = _mixed(many.select("id", "root", "i", "v", F.posexplode(F.slice("bands", BANDS + 1, BANDS)).alias("j", "w")), table)
    by = [*table, "p", "q"]
    dealt = few.union(_dealt(many, table).select(*by, "own", "id", "root")).join(classes.select("id", "n", "sketch", "bands"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for g in _groups(batches, by):
            p, q, a, b = (int(g[c][0]) for c in ("p", "q", "i", "j"))
            x, y = np.flatnonzero(g["own"] == p), np.flatnonzero(g["own"] == q)
            if len(x) > len(y):
                x, y = y, x
            for k, i in enumerate(x):  # one row against all others at a time
                others = y[k + 1 :] if p == q else y
                n, m = g["n"][i], g["n"][others]
                j = others[(g["root"][others] != g["root"][i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
                same = g["bands"][j] == g["bands"][i]
                near = (same[:, :BANDS].argmax(axis=1) == a) & (same[:, BANDS:].any(axis=1) if b < 0 else same[:, BANDS:].argmax(axis=1) == b)
                j = j[near]
                j = j[_possible(g["sketch"][i], g["sketch"][j], n, g["n"][j], percent)] if len(j) else j
                if len(j):
                    out.append(np.stack([np.full(len(j), g["id"][i]), g["id"][j]]))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), ["a", "b"])

    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id, first, text_hash.

    A document's set holds its distinct shingles of ``words`` words; with fewer words, the whole
    sequence as one; documents without words (null texts too) have the empty set, are linked with
    nothing and kept. ``class_id`` tells documents with equal sets from others. ``first`` is true
    of one row per component even where rows are repeated in full; ``kept`` is doc_id =
    component_id. A component of null ids alone has a null component_id, and its ``first`` row is
    kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # a text is found again by its hash
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("at", F.xxhash64("text"))
    sig = materialize(spark, signatures(rows.withColumn("rid", F.monotonically_increasing_id()), words), "signatures")
    # a class is a distinct set; its id is a row of it, the one with the least doc_id
    same = ["n", "k1", "k2"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "at")).alias("least")
    classes = sig.where("n > 0").groupBy(*same).agg(least, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(spark, classes.select(*same, F.col("least.rid").alias("id"), F.col("least.doc_id").alias("doc_id"), F.col("least.at").alias("at"), "bands", "sketch"), "classes")
    texts = rows.select("doc_id", "at", "text")

    # the first tables join most of what is similar; then all tables, between components only
    first = _first_tables(classes)
    edges, roots = None, None
    for _ in range(2):
        rooted = first.withColumn("root", F.col("id")) if roots is None else _rooted(first, roots)
        new = materialize(spark, _confirmed(_sketched(_stars(rooted), classes, percent), classes, texts, words, percent), "links")
        edges = new if edges is None else edges.union(new)
        roots = materialize(spark, connected_components(edges), "roots")
    rest = materialize(spark, _across(classes, roots, percent), "rest")
    if not rest.isEmpty():
        edges = edges.union(_confirmed(rest, classes, texts, words, percent))
        roots = materialize(spark, connected_components(edges), "roots")

    rooted = classes.join(roots, "id", "left").select(*same, F.col("id").alias("class_id"), "doc_id", F.coalesce("root", "id").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id")).alias("m"))
    rooted = rooted.join(best, "root").select(*same, "class_id", F.col("m.doc_id").alias("component_id"), F.col("m.class_id").alias("first_rid"))
    out = sig.select("rid", "doc_id", "at", *same).join(rooted, same, "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rid") == F.col("first_rid"))).alias("kept"),
        F.coalesce("class_id", "rid").alias("class_id"),
        (alone | (F.col("rid") == F.col("first_rid"))).alias("first"),
        F.col("at").alias("text_hash"),
    )
