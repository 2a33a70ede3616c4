"""A stored inverted index over texts: postings by document shard and term, appended to, folded, and searched by BM25.

An index is a folder of segments. A segment has ``postings`` (term, id, tf, length, positions, shard),
sorted by term inside files of whole shards, so a term's postings are spread evenly however common it
is, and a filter on terms skips row groups; ``documents`` (id, length, space; a null length is a removed row);
and ``terms`` (term, df). The manifest names the segments of each version. A version is added after its
segments are whole, so a lost job leaves the version before it.

Later segments hide the rows of earlier ones that have the same ids. Folding writes the visible rows as
one segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from engramic.operators.stored import shared_folder

# Fixed values of the scoring rules.
K1, B = 1.2, 0.75
#: Segments behind the first one that are folded into it.
FOLD_AFTER = 20
#: Documents of a shard, about; the scores of a shard's documents for a block of queries are held at once.
SHARD_DOCUMENTS = 1024
#: Words whose postings a task makes at once, about; a document stays whole.
MOST_WORDS = 250_000
#: Words that add to this share of a shard's scores are added as products of matrices, of so many words and queries; the others by so many sums at once, about.
COMMON, MOST_COMMON, MOST_ROWS, MOST_SUMS = 0.003, 256, 1024, 2_000_000
TOKEN = r"[\p{L}\p{N}]+"


#: Between a space of documents and a word in a term.
MARK = "\x01"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms_of(rows: DataFrame) -> Column:
    """The words of ``text``, with the row's ``space`` where it has one."""
    if "space" not in rows.columns:
        return words(F.col("text"))
    return F.transform(words(F.col("text")), lambda w: F.concat(F.coalesce(F.col("space"), F.lit("")), F.lit(MARK), w))


def space_of(term: Column) -> Column:
    return F.when(F.contains(term, F.lit(MARK)), F.substring_index(term, MARK, 1)).otherwise("")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    version: int
    segments: tuple[str, ...]

    def read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{segment}/{table}")

    def documents(self) -> DataFrame:
        """Visible documents: id, length, space."""
        parts = [self._visible(k, "documents") for k in range(len(self.segments))]
        return reduce(DataFrame.union, parts).where("length IS NOT NULL")

    def postings(self) -> DataFrame:
        """Visible postings: term, id, tf, length, positions, shard."""
        return reduce(DataFrame.union, [self._visible(k, "postings") for k in range(len(self.segments))])

    def terms(self) -> DataFrame:
        """term, df of the visible documents."""
        if len(self.segments) == 1:
            return self.read(self.segments[0], "terms")
        return _counted(self.postings())

    def _visible(self, k: int, table: str) -> DataFrame:
        rows = self.read(self.segments[k], table)
        later = [self.read(s, "documents").select("id") for s in self.segments[k + 1 :]]
        return rows.join(reduce(DataFrame.union, later).distinct(), "id", "left_anti").select(rows.columns) if later else rows


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def _by_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about MOST_WORDS words, so that what is held beside it does not grow with it."""
    part = np.cumsum(np.diff(batch.column("w").offsets.to_numpy())) // MOST_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _postings(rows: DataFrame, shards: int, places: bool = True) -> DataFrame:
    """Postings of rows(id, text); a text's words stay in its task, nothing is shuffled. Positions are null without ``places``."""
    sized = rows.select("id", _shard(shards).alias("shard"), terms_of(rows).alias("w"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    names = ["term", "id", "tf", "length", "positions", "shard"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_words(whole)):
            lists = batch.column("w")
            # a number for each (document, word) of the batch, in order of first occurrence
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pair = owner * max(1, len(flat.dictionary)) + flat.indices.to_numpy()
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            tf = np.diff(first, append=len(order))
            doc, word = owner[order][first], pair[order][first] % max(1, len(flat.dictionary))
            kept = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32())) if places else pa.nulls(len(first), pa.list_(pa.int32()))
            columns = [flat.dictionary.take(pa.array(word)), batch.column("id").take(pa.array(doc)).cast(kind), pa.array(tf, pa.int32()), pa.array(sizes[doc], pa.int32()), kept, batch.column("shard").take(pa.array(doc))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return sized.mapInArrow(kernel, f"term string, id {rows.schema['id'].dataType.simpleString()}, tf int, length int, positions array<int>, shard int")


def _write(index: Index, postings: DataFrame, documents: DataFrame) -> str:
    """A whole segment; its name."""
    name = f"segment-{uuid.uuid4().hex}"
    path = f"{index.folder}/{name}"
    postings.repartition("shard").sortWithinPartitions("term", "id").write.option("compression", "zstd").parquet(f"{path}/postings")
    documents.write.parquet(f"{path}/documents")
    _counted(index.read(name, "postings")).write.parquet(f"{path}/terms")
    return name


def _committed(index: Index, segments: tuple[str, ...]) -> Index:
    version = index.version + 1
    rows = [(version, k, s) for k, s in enumerate(segments)]
    index.spark.createDataFrame(rows, "version long, place int, segment string").coalesce(1).write.mode("append").parquet(f"{index.folder}/manifest")
    return Index(index.spark, index.folder, version, segments)


def _sized(rows: DataFrame) -> DataFrame:
    space = F.coalesce("space", F.lit("")) if "space" in rows.columns else F.lit("")
    return rows.select("id", F.size(words(F.col("text"))).alias("length"), space.alias("space"))


def build(rows: DataFrame, folder: str | None = None, shards: int | None = None, places: bool = True) -> Index:
    """Index of rows(id, text), and space where documents of each space count for themselves.

    Ids are unique and not null; a null text has no words. ``folder`` is shared and new (null: one of our own).
    """
    spark = rows.sparkSession
    index = Index(spark, folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", 0, ())
    return _committed(index, (_write(index, _postings(rows, shards or _shards(rows), places), _sized(rows)),))


def _shards(rows: DataFrame) -> int:
    return max(8, -(-rows.count() // SHARD_DOCUMENTS))


def opened(spark: SparkSession, folder: str) -> Index:
    """The newest whole version."""
    listed = spark.read.parquet(f"{folder}/manifest").select("version", "place", "segment").where(F.col("version") == spark.read.parquet(f"{folder}/manifest").agg(F.max("version")).first()[0]).collect()
    return Index(spark, folder, listed[0]["version"], tuple(r["segment"] for r in sorted(listed, key=lambda r: r["place"])))


def appended(index: Index, rows: DataFrame, removed: DataFrame | None = None) -> Index:
    """New and changed rows(id, text), and removed(id), as one more segment; folded when there are FOLD_AFTER of them."""
    shards = index.read(index.segments[0], "postings").agg(F.max("shard")).first()[0]
    documents = _sized(rows)
    if removed is not None:
        gone = removed.select("id").distinct().join(rows.select("id"), "id", "left_anti")
        documents = documents.union(gone.select("id", F.lit(None).cast("int").alias("length"), F.lit("").alias("space")))
    grown = _committed(index, (*index.segments, _write(index, _postings(rows, (shards or 0) + 1), documents)))
    return folded(grown) if len(grown.segments) > FOLD_AFTER else grown


def folded(index: Index) -> Index:
    """One segment of the visible rows, dealt to shards anew."""
    shards = _shards(index.documents())
    postings = index.postings().withColumn("shard", _shard(shards))
    return _committed(index, (_write(index, postings, index.documents()),))


def rebuilt(index: Index, rows: DataFrame) -> Index:
    """A new version from the rows themselves; if that fails, the old one stays."""
    return _committed(index, (_write(index, _postings(rows, _shards(rows)), _sized(rows)),))


@dataclass(frozen=True)
class Askers:
    """Which queries ask for each word of a block: those of all words in a row."""

    names: list
    counts: np.ndarray
    queries: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def scores_of_shard(asked: Askers, docs: int, number: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of the weights of each query's words in each document; postings are sorted by the number of the word."""
    total = np.zeros((len(asked.names), docs))
    first = np.flatnonzero(np.diff(number, prepend=-1))
    size = np.diff(first, append=len(number))
    common = asked.counts[number[first]] * size >= COMMON * total.size
    starts = asked.starts
    # the words of many queries and documents
    words = list(zip(number[first[common]].tolist(), first[common].tolist(), size[common].tolist(), strict=True))
    for some in (words[k : k + MOST_COMMON] for k in range(0, len(words), MOST_COMMON)):
        asks, holds = np.zeros((len(some), len(asked.names))), np.zeros((len(some), docs))
        for j, (n, at, many) in enumerate(some):
            asks[j, asked.queries[starts[n] : starts[n] + asked.counts[n]]] = 1
            holds[j, doc[at : at + many]] = weight[at : at + many]
        for k in range(0, len(total), MOST_ROWS):
            total[k : k + MOST_ROWS] += asks[:, k : k + MOST_ROWS].T @ holds
    # each posting of the others for each query that asks for its word
    rare = np.flatnonzero(~np.repeat(common, size))
    times = asked.counts[number[rare]]
    part = np.cumsum(times) // MOST_SUMS
    for some in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(part)) + 1):
        n = times[some]
        own = np.repeat(rare[some], n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(total.reshape(-1), asked.queries[starts[number[own]] + place] * docs + doc[own], weight[own])
    return total


def best_of_shard(held: Broadcast, k: int, id_type: pa.DataType, query_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Scores of a shard's postings (id, number of the term, weight): the k best of each query, equal ones by id."""

    def kernel(table: pa.Table) -> pa.Table:
        encoded = table.column("id").combine_chunks().dictionary_encode()
        ids, doc = encoded.dictionary, encoded.indices.to_numpy()
        by_id = np.argsort(np.asarray(ids.to_pylist(), object), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        number = table.column("number").to_numpy()
        at = np.argsort(number, kind="stable")
        names, total = held.value.names, scores_of_shard(held.value, len(ids), number[at], place[doc[at]], table.column("weight").to_numpy()[at])
        queries, docs, scores = [], [], []
        for i, row in enumerate(total):
            hits = np.flatnonzero(row)
            score = np.round(1 / (1 + np.exp(-row[hits] / 5)), 6)
            if len(hits) > k:
                near = score >= np.partition(score, len(hits) - k)[len(hits) - k]
                hits, score = hits[near], score[near]
            best = np.argsort(-score, kind="stable")[:k]
            queries += [names[i]] * len(best)
            docs.append(by_id[hits[best]])
            scores.append(score[best])
        return pa.table({"query_id": pa.array(queries, query_type), "id": ids.take(pa.array(np.concatenate(docs))).cast(id_type), "score": pa.array(np.concatenate(scores))})

    return kernel


def search_block(index: Index, block: list[tuple], query_id: DataType, k: int) -> DataFrame:
    """query_id, id, score for a block of (query_id, distinct terms): the k best of each query and shard."""
    spark = index.spark
    askers: dict[str, list[int]] = {}
    for i, (_, terms) in enumerate(block):
        for t in terms:
            askers.setdefault(t, []).append(i)
    told = spark.createDataFrame([(t, n) for n, t in enumerate(askers)], "term string, number int")
    counts = np.fromiter(map(len, askers.values()), np.int64, len(askers))
    queries = np.fromiter((i for a in askers.values() for i in a), np.int64)
    held = spark.sparkContext.broadcast(Askers([q for q, _ in block], counts, queries))
    sizes = index.documents().groupBy("space").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # the terms of a block are bounded by the block
    asked = index.terms().join(F.broadcast(told), "term").withColumn("space", space_of(F.col("term"))).join(sizes, "space")
    asked = asked.select("term", "number", idf.alias("idf"), F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = index.postings().join(F.broadcast(asked), "term").select("shard", "id", "number", weight.alias("weight"))
    kinds = found.schema["id"].dataType, query_id
    schema = f"query_id {query_id.simpleString()}, id {kinds[0].simpleString()}, score double"
    return found.groupBy("shard").applyInArrow(best_of_shard(held, k, *map(to_arrow_type, kinds)), schema)
