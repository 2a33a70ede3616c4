"""Files as rows: session transcripts, Markdown memories, exports, rejections, and chunks of long texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramic.functions.text import bound, trim
from engramic.operators.tools import first_rows

# Sizes in characters and lines.
CHUNK, OVERLAP, LEAST, LINES = 4000, 200, 200, 50
CORPUS_CHARS, CORPUS_LINES = 4000, 80
SENTENCE_END = frozenset(".!?。！？")
SESSIONS = 25
#: Characters of chunks that leave a task together, about.
MOST_CHARS = 1_000_000


def discovered(spark: SparkSession, paths: str | list[str], pattern: str, most_bytes: int) -> DataFrame:
    """path, mtime_ms, content of the files below ``paths`` whose names fit, up to a size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return files.where(F.col("length") <= most_bytes).select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("content"))


def newest_sessions(files: DataFrame, n: int = SESSIONS) -> DataFrame:
    """The newest files of each agent; files need agent, path and mtime_ms."""
    return first_rows(files, ["agent"], [F.desc("mtime_ms"), F.col("path")], n)


def transcript(content: Column) -> Column:
    """``## role`` blocks of the JSON lines of a session; other lines are passed over."""
    plain = "struct<message: struct<role: string, content: string>>"
    blocks = "array<struct<text: string>>"

    def block(line: Column) -> Column:
        m = F.from_json(line, plain)["message"]
        parts = F.from_json(m["content"], blocks)
        listed = F.startswith(F.ltrim(m["content"]), F.lit("["))
        text = trim(F.when(listed & parts.isNotNull(), F.array_join(F.filter(F.transform(parts, lambda p: p.text), lambda t: t != ""), "\n")).otherwise(m["content"]))
        return F.when((m["role"] != "") & (text != ""), F.concat(F.lit("## "), m["role"], F.lit("\n"), text))

    lines = F.split(content, r"\r?\n", -1)
    return F.array_join(F.filter(F.transform(lines, block), lambda b: b.isNotNull()), "\n\n")


def bullets(files: DataFrame, least: int = 5) -> DataFrame:
    """path, line, text of the ``-``, ``*`` and ``+`` items of Markdown files(path, content), of some characters at least."""
    plain = F.regexp_replace("content", "^\ufeff", "")
    lines = files.select("path", F.posexplode(F.split(plain, r"\r?\n", -1)).alias("line", "raw"))
    items = lines.select("path", (F.col("line") + 1).alias("line"), trim(F.regexp_extract("raw", r"^\s*[-*+]\s+(.*)$", 1)).alias("text"))
    return items.where(F.length("text") >= least)


def imported(items: DataFrame, rows: DataFrame, scope: str) -> DataFrame:
    """Items with texts that the scope does not have yet; of equal texts the first by path and line."""
    there = rows.where(F.col("scope") == scope).select("text")
    new = items.join(there, "text", "left_anti")
    return first_rows(new, ["text"], [F.col("path"), F.col("line")], 1).withColumn("scope", F.lit(scope))


def note(rows: DataFrame) -> DataFrame:
    """id, note: each row as a Markdown note with a head of YAML."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    scalar = lambda c: F.substring(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    head = [F.lit("---"), F.concat(F.lit("id: "), scalar(F.col("id"))), F.concat(F.lit("category: "), scalar(F.col("category"))), F.concat(F.lit("scope: "), scalar(F.coalesce("scope", F.lit("global")))), F.concat(F.lit("importance: "), F.coalesce("importance", F.lit(0.0)).cast("string")), F.lit("---"), F.lit("")]
    return rows.select("id", F.concat_ws("\n", *head, trim(F.coalesce("text", F.lit(""))), F.lit("")).alias("note"))


def rejections(spark: SparkSession, path: str) -> DataFrame:
    """The audit of rejections, one JSON object a line; corrupt lines are dropped."""
    schema = "rejected_at long, session_key string, target_scope string, candidate struct<category: string, abstract: string>, audit struct<decision: string, score: double, reason: string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_rejections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def backup(rows: DataFrame, path: str, day: str) -> None:
    """The rows of a day's backup, without vectors, beside those of other days."""
    kept = rows.drop("vector").withColumn("day", F.lit(day))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(path)


def split_end(text: str, start: int, most: int, least: int = LEAST, lines: int = LINES) -> int:
    """Where a chunk that begins at ``start`` ends: after so many lines, else after a sentence, a line, or a word."""
    least = min(start + least, most)
    breaks = [m.start() for m in re.finditer("\n", text[start:most])]
    if len(breaks) >= lines:
        return max(start + breaks[lines - 1] + 1, least)
    for i in range(most - 1, least - 1, -1):
        if text[i] in SENTENCE_END:
            end = i + 1
            while end < most and text[end].isspace():
                end += 1
            return end
    at = text.rfind("\n", least, most)
    if at >= 0:
        return at + 1
    return next((i for i in range(most - 1, least - 1, -1) if text[i].isspace()), most)


def chunks_of(text: str | None, most: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, lines: int = LINES) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each overlapping chunk."""
    text, at = text or "", 0
    while at < len(text) and text.strip():
        end = len(text) if len(text) - at <= most else split_end(text, at, at + most, least, lines)
        piece = text[at:end]
        if end < len(text) and len(piece.strip()) < least:
            end = min(at + most, len(text))
            piece = text[at:end]
        if piece.strip():
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(piece.strip()), piece.strip()
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def line_chunks_of(text: str | None) -> Iterator[tuple[int, int, str]]:
    """First and last line (from 1) and text of each chunk of whole lines; a line too long is cut by itself."""
    held: list[str] = []
    first = 1

    def flush() -> Iterator[tuple[int, int, str]]:
        own = [i for i, x in enumerate(held) if x.strip()]
        if own:
            yield first + own[0], first + own[-1], "\n".join(held[own[0] : own[-1] + 1])

    for n, line in enumerate(re.split(r"\r?\n", text or ""), 1):
        if len(line) > CORPUS_CHARS:
            yield from flush()
            held = []
            for lo in range(0, len(line), CORPUS_CHARS):
                if part := line[lo : lo + CORPUS_CHARS].strip():
                    yield n, n, part
            continue
        if held and (sum(map(len, held)) + len(held) + len(line) > CORPUS_CHARS or len(held) >= CORPUS_LINES):
            yield from flush()
            held = []
        if not held:
            first = n
        held.append(line)
    yield from flush()


def cut_batches(batches: Iterator[pa.RecordBatch], cut: Callable[..., Iterable[tuple[int, int, str]]], names: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """id, chunk, start, end, text of what ``cut`` makes of each row's columns ``names``; some texts' chunks go together."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        held: list[tuple[int, int, int, int, str]] = []
        chars = 0
        for i in range(batch.num_rows):
            for k, (start, end, text) in enumerate(cut(*[c[i].as_py() for c in columns])):
                held.append((i, k, start, end, text))
                chars += len(text)
            if held and (chars >= MOST_CHARS or i == batch.num_rows - 1):
                row, chunk, start, end, text = zip(*held, strict=True)
                ids = batch.column("id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (chunk, start, end)), pa.array(text, pa.string())], ["id", "chunk", "start", "end", "text"])
                held, chars = [], 0


def chunked(rows: DataFrame, by_lines: bool = False) -> DataFrame:
    """id, chunk, start, end, text of rows(id, text): characters, or lines from 1."""
    cut = line_chunks_of if by_lines else chunks_of
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(lambda batches: cut_batches(batches, cut), f"id {kind}, chunk int, start int, end int, text string")


# Signs of program code by language, each after the words of which its texts hold one; `(?m)` patterns find lines.
CODE = {
    "ts": [
        (("interface", "type", "enum"), r"(?m)^\s*(?:export\s+)?(?:interface|type|enum)\s+\w+"),
        ((":",), r":\s*(?:string|number|boolean|unknown|any)\b"),
        (("Promise<",), r"\bPromise<[^>]+>"),
    ],
    "js": [
        (("function",), r"(?m)^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+\w+\s*\("),
        (("class",), r"(?m)^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+\w+"),
        (("const", "let", "var"), r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*="),
        (("import",), r"\bimport\s+[^;]+?\s+from\s+[\"'][^\"']+[\"']"),
        (("=>",), "=>"),
    ],
    "py": [
        (("def",), r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\("),
        (("class",), r"(?m)^\s*class\s+\w+.*:"),
        (("import",), r"(?m)^\s*(?:from\s+\w+(?:\.\w+)*\s+import|import\s+\w+)"),
        (("__name__",), r"(?m)^\s*if\s+__name__\s*==\s*[\"']__main__[\"']\s*:"),
    ],
}


def code_language(text: Column) -> Column:
    """python, typescript, javascript or null, by how many signs of each are there."""

    def told(n: Column) -> Column:
        return (
            F.when((n.py >= 2) | ((n.py >= 1) & (n.js == 0) & (n.ts == 0)), "python")
            .when((n.ts > 0) & (n.js > 0), "typescript")
            .when((n.js >= 2) | ((n.js >= 1) & (n.py == 0)), "javascript")
        )

    # each sign is looked for once, in texts that hold a word of it
    sign = lambda t, marks, p: reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks]) & t.rlike(p)
    counts = lambda t: F.struct(*[sum((sign(t, *s).cast("int") for s in signs), F.lit(0)).alias(k) for k, signs in CODE.items()])
    return bound(bound(text, counts), told)


def learning_stats(files: DataFrame) -> DataFrame:
    """entries, pending, high, promoted over Markdown files(content) of learnings."""
    count = lambda p: F.sum(F.regexp_count("content", F.lit("(?im)" + p)))
    return files.agg(count(r"^## \[").alias("entries"), count(r"\*\*Status\*\*:\s*pending").alias("pending"), count(r"\*\*Priority\*\*:\s*(high|critical)").alias("high"), count(r"\*\*Status\*\*:\s*promoted(_to_skill)?").alias("promoted"))


#: Fixed value: characters of a mirrored text.
MIRROR_CHARS = 500


def mirror_lines(rows: DataFrame, agent: Column, source: Column) -> DataFrame:
    """``rows`` with day and line: a bullet of the daily mirror for each, its text on one line."""
    at = F.timestamp_millis("timestamp")
    label = lambda name, c: F.coalesce(F.concat(F.lit(f" {name}="), c), F.lit(""))
    text = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 1, MIRROR_CHARS)
    utc = F.to_utc_timestamp(at, F.current_timezone())
    line = F.concat(F.lit("- "), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" ["), F.coalesce("category", F.lit("other")), F.lit(":"), F.coalesce("scope", F.lit("global")), F.lit("]"), label("agent", agent), label("source", source), F.lit(" "), text)
    return rows.select("*", F.date_format(utc, "yyyy-MM-dd").alias("day"), line.alias("line"))


def write_mirror(rows: DataFrame, folder: str, agent: Column, source: Column) -> None:
    """Appends the day's lines as text files below ``folder``/day=..; a day's rows come from as many tasks as hold them."""
    mirror_lines(rows, agent, source).select("day", "line").write.mode("append").partitionBy("day").text(folder)


def exported(rows: DataFrame, path: str, scope: str | None = None, category: str | None = None) -> None:
    """All rows of a scope and category as JSON lines without vectors, newest first within each file; what was asked for lies beside them."""
    kept = rows.where(F.col("scope") == scope) if scope else rows
    kept = kept.where(F.col("category") == category) if category else kept
    kept.drop("vector", "meta").sortWithinPartitions(F.desc("timestamp")).write.mode("overwrite").json(f"{path}/memories")
    told = kept.agg(F.count(F.lit(1)).alias("count")).select(F.lit("1.0").alias("version"), F.current_timestamp().alias("exported_at"), "count", F.lit(scope).cast("string").alias("scope"), F.lit(category).cast("string").alias("category"))
    told.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def legacy_rows(old: DataFrame, limit: int | None = None) -> DataFrame:
    """id, text, vector, importance, category, createdAt, scope of an old store's table, whatever of these it lacks; vectors that are no numbers are empty."""
    from engramic.functions.metadata import number, number_vector

    has = lambda c, kind: F.col(c).cast(kind) if c in old.columns else F.lit(None).cast(kind)
    vector = number_vector(F.col("vector")) if "vector" in old.columns else F.array().cast("array<double>")
    category = F.coalesce(F.nullif(has("category", "string"), F.lit("")), F.lit("other"))
    rows = old.select(has("id", "string").alias("id"), has("text", "string").alias("text"), vector.alias("vector"), number(has("importance", "string")).alias("importance"), category.alias("category"), number(has("createdAt", "string")).alias("createdAt"), has("scope", "string").alias("scope"))
    return rows.limit(limit) if limit else rows
