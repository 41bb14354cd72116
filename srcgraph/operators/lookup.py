"""Name lookup over entities for a whole table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import postings
from srcgraph.operators.postings import PieceIndex
from srcgraph.session import SCOPE, top_per

# Definitions that a name most likely means, and the lookup bounds.
CORE_KINDS = ["class", "function", "method", "module"]
LIMITS = (1, 100)


def check_limit(limit: int, bounds: tuple[int, int] = LIMITS) -> None:
    if not bounds[0] <= limit <= bounds[1]:
        raise ValueError(f"limit must be between {bounds[0]} and {bounds[1]}")


def contains_matches(index: PieceIndex, queries: DataFrame, scoped: bool = False) -> DataFrame:
    """(query, SCOPE, id, entity_name, qualified_name, kind) where a name of the entity contains the query's name.

    With ``scoped`` a query meets only the entities of its own repository and revision. A query looks only
    at entities that hold its name as a piece, or lie near one that holds its rarer end (see ``postings``), then
    the match is verified. An empty name is in no entity.
    """
    columns = ["id", "kind", F.col("name").alias("entity_name"), "qualified_name"]
    found = ["query", *SCOPE, "id", "kind", "entity_name", "qualified_name"]
    parts = []
    if index.postings is not None:
        short = postings.candidates(index, queries, scoped).join(
            index.names.withColumnRenamed("name", "entity_name"), [*SCOPE, "number"]
        )
        parts.append(
            short.filter(F.contains(postings.haystack("entity_name"), F.lower("query.name"))).select(*found)
        )
    near = postings.candidate_runs(index, queries, scoped)
    if near is not None:
        holds = lambda row: F.contains(postings.haystack(row["entity_name"], row["qualified_name"]), F.lower("query.name"))
        rows = postings.runs(index.names, F.struct(*columns))
        long = near.join(rows, [*SCOPE, "run"]).select("query", *SCOPE, F.explode(F.filter("rows", holds)).alias("row"))
        parts.append(long.select("query", *SCOPE, "row.*").select(*found))
    return reduce(DataFrame.unionByName, parts)


def ranked_matches(index: PieceIndex, queries: DataFrame, limit: int, scoped: bool = False) -> DataFrame:
    """(query_id, query, SCOPE, id, rank) of the first ``limit`` matches per query; see ``find_entities``."""
    if "kind" not in queries.columns:
        queries = queries.withColumn("kind", F.lit(None).cast("string"))
    hits = contains_matches(index, queries, scoped).filter(
        F.col("query.kind").isNull() | (F.col("query.kind") == F.col("kind"))
    )
    name = F.col("query.name")
    closeness = (
        F.when(F.col("qualified_name") == name, 0).when(F.col("entity_name") == name, 1).otherwise(2)
    )
    return top_per(
        hits.withColumn("query_id", F.col("query.query_id")).withColumn("closeness", closeness),
        ["query_id"],
        [F.col("closeness"), F.col("qualified_name"), F.col("id")],
        limit,
    ).drop("entity_name", "qualified_name", "kind")


def find_entities(
    entities: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    scoped: bool = False,
    revisions: DataFrame | None = None,
    index: PieceIndex | None = None,
) -> DataFrame:
    """Case-insensitive substring lookup, exact names first, at most ``limit`` rows per query.

    ``index`` is the stored piece index of the entities, built here if there is none. Only the chosen rows
    are joined with the wide entities.

    ``queries``: query_id, name, optional kind; with ``scoped`` also repository_id and revision.
    Rank 1 is a qualified name equal to the query, then an equal simple name, then the rest by
    qualified name and id.
    """
    check_limit(limit)
    if index is None:
        index = postings.build(entities)
    ranked = ranked_matches(index, queries, limit, scoped)
    key = [c for c in (*SCOPE, "id") if c in entities.columns]
    ranked = entities.withColumnRenamed("name", "entity_name").join(
        ranked.drop(*[c for c in SCOPE if c not in key]), key
    )
    if revisions is not None:
        snapshot = [c for c in revisions.columns if c not in SCOPE]
        ranked = ranked.join(
            revisions.select(*SCOPE, F.struct(*snapshot).alias("snapshot")), SCOPE, "left"
        )
    return ranked


def missing_roots(roots: DataFrame, entities: DataFrame) -> DataFrame:
    """Roots (identifier, optional kind) that name no entity by id or qualified name."""
    known = entities.select(
        F.explode(F.array("id", "qualified_name")).alias("identifier"), F.col("kind").alias("has")
    )
    if "kind" in roots.columns:
        condition = (roots["identifier"] == known["identifier"]) & (
            roots["kind"].isNull() | (roots["kind"] == known["has"])
        )
        return roots.join(known, condition, "left_anti")
    return roots.join(known, "identifier", "left_anti")


def select_entities(candidates: DataFrame, preferred_prefix: str = "") -> DataFrame:
    """Per query the one credible candidate: equal by name, qualified name or dotted suffix.

    ``candidates`` is the output of ``find_entities``. Exact-case simple names win, then core
    kinds, then exact-case qualified names, then the preferred path; earlier rank breaks ties.
    """
    name, qualified = F.col("query.name"), F.col("qualified_name")
    folded = F.lower(name)
    credible = (
        (F.lower("entity_name") == folded)
        | (F.lower(qualified) == folded)
        | F.endswith(F.lower(qualified), F.concat(F.lit("."), folded))
    )
    score = F.struct(
        (F.col("entity_name") == name).alias("same_case"),
        F.col("kind").isin(*CORE_KINDS).alias("core"),
        ((qualified == name) | F.endswith(qualified, F.concat(F.lit("."), name))).alias("suffix"),
        F.startswith("file_path", F.lit(preferred_prefix)).alias("preferred"),
        (-F.col("rank")).alias("earlier"),
    )
    return (
        candidates.filter(credible)
        .groupBy("query_id")
        .agg(F.max_by(F.struct(*candidates.columns), score).alias("best"))
        .select("best.*")
    )
