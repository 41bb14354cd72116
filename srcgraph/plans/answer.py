"""Answer a table of questions from the index tables, all questions in one job.

Each stage of answering is one join here: analyse, find or search, verify,
analyse source, render, assemble. Stages a question does not plan give it no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import text
from srcgraph.operators import (
    facts as analysis,
    hybrid,
    lookup,
    questions,
    responses,
    state,
    traverse,
)
from srcgraph.operators.postings import PieceIndex
from srcgraph.session import SCOPE, cut_lineage, lookup_join, top_per

FILE = [*SCOPE, "file_path"]
# Candidates per name, search hits, traversal depth, analysed hits, answer size.
CANDIDATES, SEARCH_HITS, DEPTH, ANALYSED, ANSWER = 10, 10, 3, 6, 5_000


@dataclass(frozen=True)
class Index:
    """Tables a question is answered from, as the index job stores them (see plans.index).

    Source text is not among them: ``extents`` has hash and last line of every file, ``analyses`` and
    ``patterns`` what the structural analysis says of each definition and file. ``pieces`` is the stored
    name index; without it one is built.
    """

    extents: DataFrame
    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame
    analyses: DataFrame
    patterns: DataFrame
    preferred_prefix: str = ""
    pieces: PieceIndex | None = None

    @classmethod
    def stored(cls, tables: dict[str, DataFrame], preferred_prefix: str = "") -> Index:
        """The index of published tables (``plans.index.load``), all revisions in it."""
        names = ("extents", "entities", "edges", "chunks", "analyses", "patterns")
        pieces = PieceIndex(tables["names"], tables["postings"])
        return cls(*[tables[name] for name in names], preferred_prefix=preferred_prefix, pieces=pieces)


def _hits(analysed: DataFrame, index: Index, plans: set[str]) -> DataFrame:
    """Graph hits in order per question (query_id, position, entity columns, requested_name)."""
    named = analysed.filter(~F.col("plan").isin("discovery", "search", "index")).select(
        "query_id", *SCOPE, F.posexplode("entities").alias("position", "mention"),
    ).withColumn("requested_name", F.col("mention.name")).drop("mention")
    # A name is looked up once in its scope, however many questions mention it.
    queries = named.select(*SCOPE, F.col("requested_name").alias("name")).distinct().withColumn(
        "query_id", F.struct(*SCOPE, "name")
    )
    columns = ["id", "kind", "qualified_name", "file_path", "start_line", "end_line"]
    # Choosing keeps whole rows, so those of the entities leave out the metadata, which holds docstrings.
    narrow = index.entities.select(*SCOPE, "name", *columns)
    found = lookup.find_entities(narrow, queries, CANDIDATES, scoped=True, index=index.pieces)
    chosen = lookup.select_entities(found, index.preferred_prefix).select(
        *SCOPE, F.col("query.name").alias("requested_name"), F.col("entity_name").alias("name"), *columns
    )
    exact = lookup_join(named, chosen, [*SCOPE, "requested_name"], ["query_id", "position"]).select(
        "query_id", *SCOPE, "position", "name", *columns, "requested_name"
    )
    if not plans & {"discovery", "search"}:
        return exact
    broad = analysed.filter(F.col("plan").isin("discovery", "search") & F.col("revision").isNotNull())
    near = hybrid.hybrid_search(
        index.entities, index.chunks, broad.select("query_id", *SCOPE, "query"), SEARCH_HITS, pieces=index.pieces
    )
    described = (
        near.join(broad.select("query_id", *SCOPE), "query_id")
        .join(index.entities.withColumnRenamed("id", "entity_id"), [*SCOPE, "entity_id"])
        .withColumnRenamed("entity_id", "id")
    )
    return exact.unionByName(
        described.select(
            "query_id", *SCOPE, F.col("rank").alias("position"), "name", *columns,
            F.col("name").alias("requested_name"),
        )
    )


def _output(
    rows: DataFrame, position: int, agent: str, success: Column, section: Column, error: Column,
    warnings: Column | None = None,
) -> DataFrame:
    nothing = F.array().cast("array<string>")
    return rows.select(
        "query_id", "query", F.lit(position).alias("position"), F.lit(agent).alias("agent"),
        success.alias("success"), F.when(success, section).otherwise("").alias("section"),
        (nothing if warnings is None else F.coalesce(warnings, nothing)).alias("warnings"),
        F.when(~success, error).alias("error"),
    )


def _located(hits: DataFrame, index: Index) -> DataFrame:
    """First hits of each question with the definition their name means in their file."""
    first = top_per(hits, ["query_id"], [F.col("position"), F.col("id")], ANALYSED).withColumn(
        "request_id", F.struct("query_id", "rank")
    )
    requests = first.select(
        "request_id", "query_id", F.col("rank").alias("position"), *FILE,
        F.col("requested_name").alias("name"), F.lit("any").alias("allowed"),
    )
    return analysis.locate(index.analyses, requests)


def _explained(located: DataFrame, analyses: DataFrame) -> DataFrame:
    """Summaries and warnings per question; several hits make a multi-file text."""
    key = [*FILE, "definition"]
    summary = responses.entity_summary().alias("explanation")
    described = responses.analysed_hits(located, analyses.select(*key, summary))
    size = located.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    joined = F.array_join("analyses", "\n\n")
    many = text.truncate(F.concat(F.lit("Multi-file source analysis:\n\n"), joined), ANSWER)
    problem = F.when(
        F.col("asked") > 1, "Code Analyst could not analyze any discovered lifecycle entity"
    ).otherwise(F.get("warnings", F.lit(0)))
    return described.join(size, "query_id").select(
        "query_id",
        F.when(F.col("asked") > 1, many).otherwise(joined).alias("section"),
        F.when(F.col("asked") > 1, F.col("warnings")).alias("warnings"),
        "failed",
        problem.alias("problem"),
    )


def _pattern_sections(hits: DataFrame, analysed: DataFrame, index: Index) -> DataFrame:
    """Pattern text of the file of each question's first hit."""
    first = top_per(hits, ["query_id"], [F.col("position"), F.col("id")], 1).select("query_id", *FILE)
    asked = first.join(analysed.select("query_id", F.lower("query").alias("lowered")), "query_id")
    found = asked.join(index.patterns, FILE)
    design = F.contains("lowered", F.lit("design pattern"))
    decorator = F.contains("lowered", F.lit("decorator"))
    keys = ["query_id", "file_path"]
    parts = [
        responses.design_pattern_text(found.filter(design), keys),
        responses.pattern_text(found.filter(~design & decorator), keys, decorators_only=True),
        responses.pattern_text(found.filter(~design & ~decorator), keys),
    ]
    made = reduce(DataFrame.unionByName, parts).select("query_id", "section")
    label = F.when(decorator & ~design, "decorators").otherwise("supported patterns")
    none = F.concat(F.lit("No "), label, F.lit(" were detected in "), "file_path", F.lit("."))
    return asked.join(made, "query_id", "left").select(
        "query_id", F.coalesce("section", none).alias("section")
    )


def _comparison_sections(located: DataFrame, analyses: DataFrame) -> DataFrame:
    """Comparison text of the first two hits of each question."""
    key = F.struct(*FILE, "definition")
    pairs = (
        located.filter(F.col("status") == "found")
        .groupBy(F.col("query_id").alias("pair_id"))
        .agg(
            F.max(F.when(F.col("position") == 1, key)).alias("left"),
            F.max(F.when(F.col("position") == 2, key)).alias("right"),
        )
        .filter(F.col("left").isNotNull() & F.col("right").isNotNull())
    )
    described = analyses.withColumn("entity_text", responses.entity_summary())
    compared = analysis.compare(described, pairs)

    def listed(label: str, values: str) -> Column:
        return F.when(
            F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.slice(values, 1, 5), " "))
        )

    body = F.concat_ws(
        "\n", "summary", listed("Similarities: ", "similarities"),
        listed("Differences: ", "differences"), "left_entity.entity_text",
        "right_entity.entity_text",
    )
    return compared.select(F.col("pair_id").alias("query_id"), body.alias("section"))


def answer(asked: DataFrame, index: Index) -> DataFrame:
    """Responses for questions (query_id, query, repository_id, revision and optional session
    context: active_entities, recalled_entities).

    ``index`` may be any object with the attributes of ``Index``; tables are read only where a plan needs them."""
    analysed = cut_lineage(
        questions.analyse(asked)
        .withColumn("plan", questions.plan_name(F.col("intent"), F.col("entities")))
        .withColumn("incoming", questions.asks_incoming(F.col("query")))
    )
    # At most nine plans in two directions exist; branches no question needs are not built at all.
    traced = responses.wants_stage_trace(F.col("query"))
    kinds = analysed.groupBy("plan", "incoming").agg(F.bool_or(traced).alias("traced")).collect()
    plans = {row.plan for row in kinds}
    hits = cut_lineage(_hits(analysed, index, plans))
    located = cut_lineage(_located(hits, index))
    wanted = located.filter(F.col("definition").isNotNull()).select(*FILE, "definition").distinct()
    analyses = cut_lineage(index.analyses.join(wanted, [*FILE, "definition"], "left_semi"))

    searching = F.col("plan").isin("discovery", "search")
    scoped = F.col("repository_id").isNotNull() & F.col("revision").isNotNull()
    place = responses.location_text(hits)
    hit_count = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    base = (
        analysed.join(place, "query_id", "left")
        .join(hit_count, "query_id", "left")
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
        .withColumn("found", F.when(searching, scoped).otherwise(F.size("entities") > 0))
    )
    base = cut_lineage(base)

    outputs = [
        _output(
            base.filter("plan = 'index'"), 0, "indexer", F.lit(False), F.lit(""),
            F.lit("Indexer routing requires an explicit repository path from the gateway"),
        ),
        _output(
            base.filter("plan <> 'index'"), 0, "graph", F.col("found"),
            F.coalesce("section", F.lit("No matching graph entity was found.")),
            F.when(searching, "Repository and revision context are required for hybrid search").otherwise(
                "No entity was identified for graph lookup"
            ),
        ),
    ]

    if "traverse" in plans:
        ways = sorted({row.incoming for row in kinds if row.plan == "traverse"})
        outputs.append(_walked(base, hits, index, ways))

    sourced = base.filter(
        F.col("found") & ~F.col("plan").isin("index", "lookup", "traverse")
    )
    verified = responses.verified_hits(hits, index.extents)
    missing = verified.groupBy("query_id").agg(
        F.bool_and(F.col("verified_hash").isNotNull()).alias("verified")
    )
    checked = cut_lineage(sourced.drop("section").join(missing, "query_id", "left"))
    is_verified = F.coalesce("verified", F.lit(False))
    outputs.append(
        _output(
            checked, 1, "repository", is_verified, F.lit(""),
            F.when(F.col("hits") == 0, "A prior graph entity result is required for source verification")
            .otherwise("Source file was not found"),
        )
    )

    analyst = checked.filter(is_verified)
    explained = analyst.filter(~F.col("plan").isin("patterns", "comparison")).join(
        _explained(located, analyses), "query_id"
    )
    outputs.append(
        _output(
            explained, 2, "code_analyst", ~F.col("failed"), F.col("section"), F.col("problem"),
            F.col("warnings"),
        )
    )
    if "patterns" in plans:
        patterned = analyst.filter("plan = 'patterns'").join(
            _pattern_sections(hits, analysed, index), "query_id"
        )
        outputs.append(
            _output(patterned, 2, "code_analyst", F.lit(True), F.col("section"), F.lit(""))
        )
    if "comparison" in plans:
        compared = analyst.filter("plan = 'comparison'").join(
            _comparison_sections(located, analyses), "query_id", "left"
        )
        outputs.append(
            _output(
                compared, 2, "code_analyst", F.col("section").isNotNull(), F.col("section"),
                F.lit("Two resolved graph entities are required for comparison"),
            )
        )

    assembled = responses.assemble(reduce(DataFrame.unionByName, outputs))
    answered = analysed.select("query_id", "query", "intent", "plan", *SCOPE, "entities").join(
        assembled, "query_id"
    )
    if not any(row.traced for row in kinds):
        return answered
    return (
        answered.join(_traces(analysed, located, analyses), "query_id", "left")
        .withColumn("answer", F.coalesce("trace", "answer"))
        .drop("trace")
    )


def _walked(base: DataFrame, hits: DataFrame, index: Index, ways: list[bool]) -> DataFrame:
    """Output rows of the dependency walk from each question's first hit, against the edges where ``incoming``."""
    walked = base.filter("plan = 'traverse' and found")
    first = top_per(hits, ["query_id"], [F.col("position"), F.col("id")], 1)
    # An id is the same in every revision, so nodes carry their revision and walks stay inside it.
    def node(column: str) -> Column:
        return F.concat_ws("|", "revision", column)

    roots = first.join(walked.select("query_id", "incoming"), "query_id").select(
        "query_id", "incoming", node("id").alias("root")
    )
    edges = index.edges.withColumns(
        {"source_id": node("source_id"), "target_id": node("target_id")}
    )
    found = []
    for incoming in ways:
        walk = traverse.dependents if incoming else traverse.dependencies
        asked = roots.filter(F.col("incoming") == incoming)
        found.append(walk(edges, asked.select("root").distinct(), DEPTH).join(asked, "root"))
    names = index.entities.select(node("id").alias("id"), "qualified_name")
    relations = (
        reduce(DataFrame.unionByName, found)
        .join(names.toDF("source_id", "source_name"), "source_id")
        .join(names.toDF("target_id", "target_name"), "target_id")
        .withColumn("position", F.struct("depth", "source_name", "kind", "target_name"))
    )
    return _output(
        walked.drop("section").join(responses.relation_text(relations), "query_id", "left"), 1,
        "graph", F.col("hits") > 0,
        F.coalesce("section", F.lit("No matching graph relationships were found.")),
        F.lit("A prior graph entity result is required"),
    )


def _traces(analysed: DataFrame, located: DataFrame, analyses: DataFrame) -> DataFrame:
    """Stage traces of the questions that ask for the request lifecycle."""
    wanted = analysed.filter(responses.wants_stage_trace(F.col("query"))).select("query_id")
    shown = (
        located.join(wanted, "query_id", "left_semi")
        .join(
            analyses.select(
                *FILE, "definition", F.col("name").alias("simple"), F.col("local_name").alias("qualified"),
                "line", "snippet_end",
            ),
            [*FILE, "definition"],
        )
        .select(
            "query_id", "position", F.col("simple").alias("name"),
            F.col("qualified").alias("qualified_name"), "file_path",
            F.col("line").alias("start_line"), F.col("snippet_end").alias("end_line"),
        )
    )
    return responses.stage_trace(shown).withColumnRenamed("answer", "trace")


def evidence(responses_made: DataFrame, hits: DataFrame, extents: DataFrame) -> DataFrame:
    """Graph and source evidence of each question's hits, without repeats."""
    verified = responses.verified_hits(hits, extents).filter(F.col("verified_hash").isNotNull())
    graph = hits.select(
        F.col("query_id").alias("response_id"), F.col("position"), F.lit("graph").alias("kind"),
        F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("last_line"), F.lit(None).cast("string").alias("content_hash"),
    )
    source = verified.select(
        F.col("query_id").alias("response_id"), (F.col("position") + 1_000).alias("position"),
        F.lit("source").alias("kind"), F.lit(None).cast("string").alias("entity_id"), "file_path",
        "last_line", F.col("verified_hash").alias("content_hash"),
    )
    made = responses_made.select(F.col("query_id").alias("response_id"))
    rows = graph.unionByName(source).join(made, "response_id", "left_semi")
    return responses.deduplicate_evidence(rows)


def turn_log(asked: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """State rows that a batch of answered questions adds: turns, audits, episodes.

    ``asked``: query_id, session_id, user_id, query, repository_id, revision, asked_at, turn,
    response_detail, code_examples. Bound each with the functions of ``operators.state``.
    """
    made = answers.select("query_id", "plan", "intent", "answer", "partial", "agents_used", "entities")
    joined = asked.join(made, "query_id").withColumn(
        "names", F.transform("entities", lambda e: e["name"])
    )
    turn = F.col("turn") * 2
    spoken = joined.select(
        "session_id", "asked_at", F.col("names").alias("entities"), *SCOPE,
        F.explode(
            F.array(
                F.struct(turn.alias("turn"), F.lit("user").alias("role"), F.col("query").alias("content")),
                F.struct((turn + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
            )
        ).alias("said"),
    ).select("session_id", "said.*", F.col("asked_at").alias("created_at"), "entities", *SCOPE)
    audits = state.audit_records(
        joined.select(
            "session_id", F.col("query_id").alias("audit_id"), F.col("asked_at").alias("created_at"),
            "query", *SCOPE, "intent", questions.planned_agents(F.col("plan")).alias("planned_agents"),
            F.col("agents_used").alias("successful_agents"), "partial",
            *[F.col(c) for c in ("cache_hit",) if c in asked.columns],
        )
    )
    episodes = joined.select(
        F.col("query_id").alias("episode_id"), "user_id", *SCOPE, "query", "answer",
        F.col("names").alias("entities"), "partial", F.col("asked_at").alias("created_at"),
    )
    return {"turns": spoken, "audits": audits, "episodes": episodes}

