"""Packing by concatenate and cut.

Pass one tokenises each text once, stores the ids, and counts tokens by partition. A prefix sum
over the partition totals turns each document's place in its partition into a place in the whole
stream; pass two cuts the stream at multiples of the window and writes a record for each piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Words, and pieces of words, whose ids a worker process remembers at once.
CACHE_WORDS = 900_000
END_ID = 1
# Fixed value: the tokenizer's own pattern of pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for ASCII in lower case.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def byte_characters() -> list[str]:
    """The character by which byte-level models write each byte: itself if visible in Latin-1, else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        seen = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if seen else more))
        more += not seen
    return out


class Ids(dict):
    """Ids (bytes) by string, worked out where missing and remembered."""

    def __init__(self, of: Callable[[str], bytes]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, string: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[string] = self.of(string)
        return ids


class WordIds:
    """Ids of a text by way of its words.

    The tokenizer lower-cases, replaces white space and never joins across it, so a text's ids are
    those of its words in order, and a word's ids are those of its pieces. Words with characters
    beyond Latin-1, where normal forms and case may depend on context, are not cut up; texts with
    characters that Python, but not the tokenizer, takes for blanks go the whole way.
    """

    ODD = frozenset("\x1c\x1d\x1e\x1f")
    _of_process: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.words, self.pieces = Ids(self._word), Ids(self._piece)

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """One for all tasks of a worker process."""
        if path not in cls._of_process:
            cls._of_process[path] = cls(path)
        return cls._of_process[path]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):  # control bytes of ASCII have characters of their own too
            piece = "".join([self.characters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word:
            return self._whole(word)
        if word.isascii():
            low = word.lower()
            return self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, ASCII_PIECE.findall(low)))
        if max(word) >= "\u0100":
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(word.lower())))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.words.__getitem__, text.split())) if self.ODD.isdisjoint(text) else self._whole(text)


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, closed by END_ID), n, pid, local (ids before it in its partition)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, pid, before = WordIds.shared(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [b + end for b in words.encode(texts)]
            n = np.fromiter((len(b) >> 2 for b in ids), np.int64, len(ids))
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), pid, np.int64)), pa.array(starts)],
                ["doc_id", "ids", "n", "pid", "local"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, ids binary, n long, pid long, local long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece itself. Each id lies in one piece; all sequences but the last are full.
    A null or empty text is a document of the closing id alone, so it has one piece. Repeated rows
    and null ids are documents like others; an empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    stored = materialize(spark, tokenized(docs, tokenizer_path, id_col, text_col), "tokens")
    # one row per partition of pass one: a bounded table, and a bounded prefix sum
    totals = stored.groupBy("pid").agg(F.sum("n").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "pid").select("doc_id", "ids", "n", (F.col("base") + F.col("local")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, ids, n, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at")), strict=True):
                lo = 0
                while lo < n:
                    sequence, offset = divmod(at + lo, window)
                    hi = min(n, lo + window - offset)
                    piece = ids[4 * lo : 4 * hi]
                    out.append((doc, lo, hi - lo, zlib.crc32(piece), n, sequence, offset, piece))
                    lo = hi
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(cut, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
