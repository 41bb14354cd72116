"""Answer assembly: evidence, rendering, citations, response rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text
from srcgraph.session import SCOPE, lookup_join, top_per

# How much of each list a rendered answer shows.
EXCERPT, PROMPT_EXCERPT, PATH_PARTS = 4_000, 1_500, 12
VERIFIED_HITS, RELATIONS, LOCATIONS, PATTERNS, ASYNC_NAMES = 6, 10, 3, 25, 5


def trimmed_excerpt(excerpt: Column) -> Column:
    return text.truncate(excerpt, EXCERPT)


def deduplicate_evidence(evidence: DataFrame, key: str = "response_id") -> DataFrame:
    """Drop repeated evidence of a response, keeping the first by ``position``.

    Rows are compared as a whole by digest, so the grouping key stays short.
    """
    body = [c for c in evidence.columns if c not in (key, "position")]
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    return (
        evidence.withColumn("_digest", digest)
        .groupBy(key, "_digest")
        .agg(F.min_by(F.struct("position", *body), "position").alias("kept"))
        .select(key, "kept.*")
    )


def enrich_provenance(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Fill missing snapshots from hits of the same repository and revision; the last hit wins.

    ``evidence``: SCOPE, snapshot; ``hits``: SCOPE, snapshot, position.
    """
    known = (
        hits.filter(F.col("snapshot").isNotNull())
        .groupBy(*SCOPE)
        .agg(F.max_by("snapshot", "position").alias("_known"))
    )
    return (
        evidence.join(known, SCOPE, "left")
        .withColumn("snapshot", F.coalesce("snapshot", "_known"))
        .drop("_known")
    )


def verified_hits(hits: DataFrame, extents: DataFrame, limit: int = VERIFIED_HITS) -> DataFrame:
    """First hits per question joined to their file: whole-file location and hash.

    ``extents``: hash and last line of every file (``textops.file_extents``), stored by the index job, so
    that no source text is read to answer.
    """
    first = top_per(hits, ["query_id"], [F.col("position")], limit).drop("rank")
    located = extents.select(
        *SCOPE, "file_path", F.col("content_hash").alias("verified_hash"), "last_line"
    )
    # A popular file is hit by many questions; its rows are spread by question.
    return lookup_join(first, located, [*SCOPE, "file_path"], ["query_id", "position"], "left")


def analysed_hits(located: DataFrame, analyses: DataFrame, limit: int = VERIFIED_HITS) -> DataFrame:
    """Per question: the analyses of its first hits, a warning for each that has none, failed.

    ``located``: query_id, position, name, FILE, definition (null when not found), status.
    """
    key = [*SCOPE, "file_path", "definition"]
    first = top_per(located, ["query_id"], [F.col("position")], limit).drop("rank")
    found = first.join(
        analyses.select(*key, F.col("explanation"), F.lit(True).alias("analysed")), key, "left"
    )
    message = F.when(
        F.col("status") == "ambiguous",
        F.lit("Source entity name is ambiguous; use its qualified name"),
    ).otherwise(F.lit("Source entity was not found"))
    return found.groupBy("query_id").agg(
        F.transform(
            F.sort_array(
                F.collect_list(F.when(F.col("analysed"), F.struct("position", "explanation")))
            ),
            lambda row: row["explanation"],
        ).alias("analyses"),
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.when(F.col("analysed").isNull(), F.struct("position", message.alias("warning")))
                )
            ),
            lambda row: row["warning"],
        ).alias("warnings"),
        F.coalesce(F.bool_and(F.col("analysed").isNull()), F.lit(True)).alias("failed"),
    )


def assemble(outputs: DataFrame) -> DataFrame:
    """One response per question from its stage outputs.

    ``outputs``: query_id, query, position, agent, success, section (rendered text or empty),
    warnings, error. A question has a handful of stages, so its lists are short.
    """
    ordered = F.sort_array(
        F.collect_list(F.struct("position", "agent", "success", "section", "warnings", "error"))
    )
    gathered = outputs.groupBy("query_id").agg(
        F.first("query").alias("query"),
        ordered.alias("outputs"),
        F.bool_or(~F.col("success")).alias("any_failed"),
        F.bool_or("success").alias("any_success"),
    )
    good = F.filter("outputs", lambda o: o["success"])
    sections = F.filter(F.transform(good, lambda o: o["section"]), lambda s: F.coalesce(s, F.lit("")) != "")
    warned = F.flatten(
        F.transform(
            "outputs",
            lambda o: F.concat(
                F.coalesce(o["warnings"], F.array().cast("array<string>")),
                F.array_compact(
                    F.array(F.when(o["error"] != "", F.concat_ws(": ", o["agent"], o["error"])))
                ),
            ),
        )
    )
    nothing = F.concat(F.lit("I could not gather repository evidence for: "), "query")
    return gathered.select(
        "query_id",
        F.when(F.size(sections) == 0, nothing).otherwise(F.array_join(sections, "\n\n")).alias("answer"),
        F.array_distinct(F.transform(good, lambda o: o["agent"])).alias("agents_used"),
        F.array_distinct(warned).alias("warnings"),
        (F.col("any_failed") | ~F.col("any_success")).alias("partial"),
    )


def _listing(label: str, values: str, shown: int, separator: str = ", ", more: bool = False) -> Column:
    tail = F.when(F.size(values) > shown, F.lit(" …")).otherwise(F.lit("")) if more else F.lit("")
    body = F.array_join(F.slice(values, 1, shown), separator)
    return F.when(F.size(values) > 0, F.concat(F.lit(label), body, tail, F.lit(".")))


def entity_summary() -> Column:
    """Text of one analysis row (columns of ``facts.analyses``), fixed order and caps."""
    stripped = text.strip(F.coalesce("docstring", F.lit("")))
    purpose = F.replace(F.get(F.split(stripped, "\n\n", 2), F.lit(0)), F.lit("\n"), F.lit(" "))
    return F.concat_ws(
        " ",
        "explanation",
        F.when(
            F.col("signature") != "",
            F.concat(F.lit("Signature: `"), text.truncate(F.col("signature"), 300), F.lit("`.")),
        ),
        _listing("Bases: ", "bases", 8),
        _listing("Key methods: ", "methods", 10, more=True),
        _listing("Key calls: ", "calls", 10, more=True),
        _listing("Awaited operations: ", "awaits", 6),
        _listing("Control flow: ", "control_flow", 6, "; "),
        _listing("Return paths: ", "returns", 4, "; "),
        _listing("Explicit raises: ", "raises", 4, "; "),
        F.when(stripped != "", F.concat(F.lit("Purpose: "), text.truncate(purpose, 280))),
        F.concat(
            F.lit("Source: "), "file_path", F.lit(":"), "line", F.lit("-"), "snippet_end", F.lit(".")
        ),
    )


def _ordered_lines(rows: DataFrame, keys: list[str], position: str, line: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), line.alias("line")))),
            lambda row: row["line"],
        ).alias("lines")
    )


def relation_text(relations: DataFrame) -> DataFrame:
    """First relations of each question as text. ``relations``: query_id, position, source_name,
    kind, target_name."""
    kept = top_per(relations, ["query_id"], [F.col("position")], RELATIONS)
    line = F.concat(F.lit("- "), "source_name", F.lit(" "), "kind", F.lit(" "), "target_name")
    return _ordered_lines(kept, ["query_id"], "rank", line).select(
        "query_id",
        F.concat(F.lit("Graph relationships:\n"), F.array_join("lines", "\n")).alias("section"),
    )


def location_text(hits: DataFrame) -> DataFrame:
    """First resolved locations of each question as text."""
    kept = top_per(hits, ["query_id"], [F.col("position")], LOCATIONS)
    line = F.concat(
        "qualified_name", F.lit(" ("), "kind", F.lit(") at "), "file_path", F.lit(":"),
        "start_line", F.lit("-"), "end_line",
    )
    return _ordered_lines(kept, ["query_id"], "rank", line).select(
        "query_id",
        F.concat(F.lit("Resolved: "), F.array_join("lines", "; "), F.lit(".")).alias("section"),
    )


def pattern_text(patterns: DataFrame, keys: list[str], decorators_only: bool = False) -> DataFrame:
    """Count and first patterns of each file as text. ``patterns``: keys, position, kind,
    entity_name, rationale, line."""
    chosen = patterns.filter(F.col("kind") == "decorator") if decorators_only else patterns
    label = "decorators" if decorators_only else "source patterns"
    counts = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    kept = top_per(chosen, keys, [F.col("position")], PATTERNS)
    line = F.concat(
        F.lit("- "), "kind", F.lit(": "), "entity_name", F.lit(" — "), "rationale",
        F.lit(" (line "), "line", F.lit(")"),
    )
    more = F.when(F.col("total") > PATTERNS, F.lit(f" Showing the first {PATTERNS}.")).otherwise("")
    head = F.concat(F.lit("Detected "), "total", F.lit(f" {label}."), more, F.lit("\n"))
    return (
        _ordered_lines(kept, keys, "rank", line)
        .join(counts, keys)
        .select(*keys, F.concat(head, F.array_join("lines", "\n")).alias("section"))
    )


def design_pattern_text(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Architectural reading of a file's patterns (keys must include file_path)."""
    async_rows = top_per(
        patterns.filter(F.col("kind") == "async_io"), keys, [F.col("position")], ASYNC_NAMES
    ).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "entity_name", "line"))).alias("asyncs")
    )
    first = F.struct("entity_name", "rationale", "line")
    grouped = patterns.groupBy(*keys).agg(
        *[
            F.min_by(
                F.when(F.col("kind") == kind, first), F.when(F.col("kind") == kind, F.col("position"))
            ).alias(kind)
            for kind in ("inheritance", "decorator")
        ]
    )

    def place(line: Column) -> Column:
        return F.concat(F.lit("["), "file_path", F.lit(":"), line, F.lit("]"))

    def observed(item: str, title: str, body: str) -> Column:
        value = F.col(item)
        return F.when(
            value.isNotNull(),
            F.concat(
                F.lit(title), value["entity_name"], F.lit(" "), value["rationale"], F.lit(body),
                place(value["line"]),
            ),
        )

    names = F.array_join(F.transform("asyncs", lambda row: row["entity_name"]), ", ")
    places = F.array_join(F.transform("asyncs", lambda row: row["line"].cast("string")), ", ")
    sections = F.array_compact(
        F.array(
            observed("inheritance", rules.INHERITANCE_TITLE, rules.INHERITANCE_TEXT),
            observed("decorator", rules.DECORATOR_TITLE, rules.DECORATOR_TEXT),
            F.when(
                F.col("asyncs").isNotNull(),
                F.concat(
                    F.lit(rules.ASYNC_TITLE), names, F.lit(" "), place(places), F.lit("."),
                    F.lit(rules.ASYNC_TEXT),
                ),
            ),
        )
    )
    nothing = F.concat(
        F.lit("No supported statically observable patterns were detected in "), "file_path", F.lit(".")
    )
    body = F.concat_ws(
        "\n\n", F.lit(rules.PATTERN_HEAD), F.array_join(sections, "\n\n"), F.lit(rules.PATTERN_TAIL)
    )
    return grouped.join(async_rows, keys, "left").select(
        *keys, F.when(F.size(sections) == 0, nothing).otherwise(body).alias("section")
    )


def stage_trace(analyses: DataFrame) -> DataFrame:
    """Ordered request trace per question from its analyses, missing stages skipped.

    ``analyses``: query_id, name, qualified_name, file_path, start_line, end_line. A stage is found
    by either name; the last analysis given (``position``) wins.
    """
    order = [name for name, _, _ in rules.LIFECYCLE_STAGES]
    found = (
        analyses.select(
            "*", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol")
        )
        .filter(F.col("symbol").isin(*order))
        .groupBy("query_id", "symbol")
        .agg(F.max_by(F.struct("file_path", "start_line", "end_line"), "position").alias("at"))
        .groupBy("query_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("symbol", "at"))).alias("found"))
    )
    entries = []
    for name, title, description in rules.LIFECYCLE_STAGES:
        at = F.col("found")[name]
        source = F.concat(
            at["file_path"], F.lit(":"), at["start_line"], F.lit("-"), at["end_line"]
        )
        entries.append(
            F.when(
                F.map_contains_key("found", name),
                F.concat(F.lit(f"**{title}:** {description} ["), source, F.lit("]")),
            )
        )
    numbered = F.transform(
        F.array_compact(F.array(*entries)),
        lambda entry, index: F.concat((index + 1).cast("string"), F.lit(". "), entry),
    )
    return found.select(
        "query_id",
        F.concat_ws(
            "\n\n",
            F.lit(rules.LIFECYCLE_HEAD),
            F.array_join(numbered, "\n\n"),
            F.lit(rules.LIFECYCLE_TAIL),
        ).alias("answer"),
    )


def wants_stage_trace(query: Column) -> Column:
    lowered = F.lower(query)
    return F.contains(lowered, F.lit("request")) & (
        F.contains(lowered, F.lit("lifecycle")) | F.contains(lowered, F.lit("end-to-end"))
    )


def citation_label(evidence: Column) -> Column:
    """Label of an evidence struct (file_path, start_line, end_line, graph_path, entity_id)."""
    located = F.concat(
        F.lit("["), evidence["file_path"], F.lit(":"), evidence["start_line"], F.lit("-"),
        evidence["end_line"], F.lit("]"),
    )
    path = F.concat(F.lit("[graph: "), F.array_join(evidence["graph_path"], " -> "), F.lit("]"))
    entity = F.concat(
        F.lit("[graph entity: "), F.coalesce(evidence["entity_id"], F.lit("unknown")), F.lit("]")
    )
    return (
        F.when(evidence["file_path"].isNotNull(), located)
        .when(F.coalesce(F.size(evidence["graph_path"]), F.lit(0)) > 0, path)
        .otherwise(entity)
    )


def resolve_citations(answers: DataFrame) -> DataFrame:
    """Check and replace citation markers.

    ``answers``: response_id, answer, used ARRAY<INT>, labels ARRAY<STRING> (label of evidence 1,
    2, ...). Status is ``ok``, ``invalid`` (unknown or undeclared ids) or ``malformed``; only an
    ``ok`` answer has text.
    """
    markers = F.array_distinct(
        F.concat(
            F.regexp_extract_all("answer", F.lit("\\[E(\\d+)\\]"), F.lit(1)),
            F.regexp_extract_all("answer", F.lit("(?<![A-Za-z])\\[(\\d+)\\]"), F.lit(1)),
        )
    )
    numbers = F.transform(markers, lambda m: F.coalesce(m.try_cast("int"), F.lit(-1)))
    like = F.regexp_extract_all("answer", F.lit("(\\[E[^\\]]*\\])"), F.lit(1))
    used = F.col("used")
    declared = (F.size(used) > 0) & F.forall(used, lambda n: n.between(1, F.size("labels")))
    valid = declared & (F.size(F.array_except("markers", used)) == 0)
    malformed = F.exists(like, lambda m: ~m.rlike("^\\[E\\d+\\]$"))

    def label(n: Column) -> Column:
        return F.get("labels", n - 1)

    replaced = F.aggregate(
        F.sort_array("markers", asc=False),
        F.col("answer"),
        lambda body, n: F.replace(
            F.replace(body, F.concat(F.lit("[E"), n.cast("string"), F.lit("]")), label(n)),
            F.concat(F.lit("["), n.cast("string"), F.lit("]")),
            label(n),
        ),
    )
    listed = F.array_join(F.transform(F.sort_array(F.array_distinct(used)), label), " ")
    with_sources = F.concat(text.rstrip(F.col("answer")), F.lit("\n\nSources: "), listed)
    return (
        answers.withColumn("markers", numbers)
        .withColumn(
            "status",
            F.when(~valid, "invalid").when(malformed, "malformed").otherwise("ok"),
        )
        .withColumn(
            "resolved_answer",
            F.when(
                F.col("status") == "ok",
                F.when(F.size("markers") == 0, with_sources).otherwise(replaced),
            ),
        )
        .drop("markers")
    )


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """Numbered evidence text per response. ``evidence``: response_id, position, kind, file_path,
    start_line, end_line, entity_id, graph_path, excerpt."""
    item = F.struct("file_path", "start_line", "end_line", "graph_path", "entity_id")
    section = F.concat(
        F.lit("kind: "), "kind", F.lit("\nlocation: "), citation_label(item),
        F.lit("\nentity_id: "), F.coalesce("entity_id", F.lit("")), F.lit("\ngraph_path: "),
        F.coalesce(F.array_join(F.slice("graph_path", 1, PATH_PARTS), " -> "), F.lit("")),
        F.lit("\nexcerpt:\n"), F.coalesce(F.substring("excerpt", 1, PROMPT_EXCERPT), F.lit("")),
    )
    lines = _ordered_lines(evidence, ["response_id"], "position", section)
    numbered = F.transform(
        "lines",
        lambda line, index: F.concat(F.lit("E"), (index + 1).cast("string"), F.lit("\n"), line),
    )
    return lines.select("response_id", F.array_join(numbered, "\n\n").alias("prompt"))
