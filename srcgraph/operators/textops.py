"""Source text operators: line search, snippets, verification, answer pieces and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text
from srcgraph.functions.ids import safe_relative
from srcgraph.operators.lookup import check_limit
from srcgraph.session import SCOPE

FILE = [*SCOPE, "file_path"]


def read_problem(maximum_bytes: int | None) -> Column:
    """Why a file's content cannot be read; null if it can. Without a bound any length can."""
    raw = F.col("content").cast("binary")
    problem = F.when(~F.is_valid_utf8(raw.cast("string")), F.lit("Source file is not valid UTF-8"))
    if maximum_bytes is None:
        return problem
    too_long = F.octet_length(raw) > maximum_bytes
    return F.when(too_long, F.lit("Source file exceeds the configured size limit")).otherwise(problem)


def readable(files: DataFrame, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES) -> DataFrame:
    """Files within the size bound, if there is one, whose bytes are valid UTF-8, content as text."""
    return files.filter(read_problem(maximum_bytes).isNull()).withColumn(
        "content", F.col("content").cast("binary").cast("string")
    )


def unreadable(files: DataFrame, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES) -> DataFrame:
    """The other files, as issue rows."""
    problem = read_problem(maximum_bytes)
    return files.filter(problem.isNotNull()).select(
        *FILE, problem.alias("message"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("fatal")
    )


def file_extents(files: DataFrame, maximum_bytes: int | None = None) -> DataFrame:
    """Hash and last line of every readable file: what verifying a hit needs of its source.

    Files of any size are measured unless a bound is given.
    """
    return readable(files, maximum_bytes).select(
        *FILE, "content_hash",
        F.greatest(F.lit(1), F.size(text.lines(F.col("content")))).alias("last_line"),
    )


def safe_paths(files: DataFrame) -> DataFrame:
    return files.filter(safe_relative(F.col("file_path")))


def unsafe_paths(files: DataFrame) -> DataFrame:
    """Files outside their repository, as issue rows; they are reported and not indexed."""
    return files.filter(~F.coalesce(safe_relative(F.col("file_path")), F.lit(False))).select(
        *FILE, F.lit("File path is not inside the repository").alias("message"),
        F.lit(None).cast("int").alias("line"), F.lit(False).alias("fatal"),
    )


def line_matches(
    files: DataFrame, query: str, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES
) -> DataFrame:
    """Every line that holds the literal ``query``, ignoring case. Whole files, no cap.

    Files without the query anywhere are dropped before their lines are split.
    """
    if not query.strip():
        raise ValueError("search query cannot be empty")
    needle = F.lower(F.lit(query))
    return (
        readable(files, maximum_bytes)
        .filter(F.contains(F.lower("content"), needle))
        .select(*FILE, "content_hash", F.posexplode(text.lines(F.col("content"))).alias("at", "raw"))
        .filter(F.contains(F.lower("raw"), needle))
        .select(
            *FILE,
            (F.col("at") + 1).alias("line"),
            text.strip(F.col("raw")).alias("excerpt"),
            "content_hash",
        )
    )


def line_search(
    files: DataFrame, query: str, limit: int = 20, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES
) -> DataFrame:
    """First ``limit`` matches by path and line, with a flag that the limit was reached."""
    check_limit(limit)
    best = line_matches(files, query, maximum_bytes).orderBy("file_path", "line", *SCOPE).limit(limit)
    everything = Window.partitionBy(F.lit(0))
    return best.withColumn("truncated", F.count(F.lit(1)).over(everything) >= limit)


def snippets(
    files: DataFrame, requests: DataFrame, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES
) -> DataFrame:
    """Line ranges with context. ``requests``: FILE, start_line, end_line, context_lines.

    Ranges are clamped to the file; requests that start after its end, are inverted, ask for more
    than 50 context lines, or name an unsafe or unreadable file give no row.
    """
    valid = requests.filter(
        (F.col("start_line") >= 1)
        & (F.col("end_line") >= F.col("start_line"))
        & F.col("context_lines").between(0, 50)
        & safe_relative(F.col("file_path"))
    )
    lined = readable(files, maximum_bytes).select(
        *FILE, "content_hash", text.lines(F.col("content")).alias("lines")
    )
    total = F.greatest(F.lit(1), F.size("lines"))
    first = F.greatest(F.lit(1), F.col("start_line") - F.col("context_lines"))
    last = F.least(total, F.col("end_line") + F.col("context_lines"))
    return (
        valid.join(lined, FILE)
        .filter(F.col("start_line") <= total)
        .withColumn("first", first)
        .withColumn("last", last)
        .withColumn("code", F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n"))
        .drop("start_line", "end_line", "context_lines", "lines")
        .withColumnsRenamed({"first": "start_line", "last": "end_line"})
    )


def verify(
    files: DataFrame, requests: DataFrame, maximum_bytes: int | None = rules.MAXIMUM_FILE_BYTES
) -> DataFrame:
    """Existence, hash, optional hash match and whole-file location per request.

    ``requests``: FILE, optional expected_content_hash.
    """
    if "expected_content_hash" not in requests.columns:
        requests = requests.withColumn("expected_content_hash", F.lit(None).cast("string"))
    found = readable(files, maximum_bytes).select(
        *FILE,
        "content_hash",
        F.greatest(F.lit(1), F.size(text.lines(F.col("content")))).alias("end_line"),
    )
    expected = F.col("expected_content_hash")
    return (
        requests.join(found, FILE, "left")
        .withColumn("exists", F.col("end_line").isNotNull())
        .withColumn(
            "content_hash_matches",
            F.when(F.col("exists") & (expected != ""), F.col("content_hash") == expected),
        )
        .withColumn("start_line", F.when(F.col("exists"), F.lit(1)))
    )


def answer_chunks(answers: DataFrame, maximum: int = 160, blank: bool = True) -> DataFrame:
    """Answers (response_id, answer) as ordered transport pieces; an empty one has a piece with ``blank``."""
    pieces = text.answer_chunks(F.col("answer"), maximum, blank)
    return answers.select("response_id", F.posexplode(pieces).alias("position", "chunk"))


def event_sequence(responses: DataFrame, blank: bool = True) -> DataFrame:
    """Ordered events of a response: evidence, answer pieces, warnings, then done.

    ``responses``: response_id, answer, evidence ARRAY<STRING>, warnings ARRAY<STRING>,
    payload STRING (what the closing event carries). An empty answer has a piece with ``blank``.
    """

    def events(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("data")))

    ordered = F.concat(
        events("evidence", F.col("evidence")),
        events("token", text.answer_chunks(F.col("answer"), blank=blank)),
        events("warning", F.col("warnings")),
        events("done", F.array("payload")),
    )
    return responses.select("response_id", F.posexplode(ordered).alias("position", "event")).select(
        "response_id", "position", "event.type", "event.data"
    )
