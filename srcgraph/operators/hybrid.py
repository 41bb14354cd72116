"""Hybrid retrieval: query expansion, rerank, reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text
from srcgraph.operators import postings, vectors
from srcgraph.operators.cells import Cells
from srcgraph.operators.lookup import check_limit, ranked_matches
from srcgraph.operators.postings import PieceIndex
from srcgraph.session import SCOPE, staged, top_per

RANK_CONSTANT = 60  # fixed value


def expand_query(query: Column) -> Column:
    """Append the hint words of every rule the question meets, in rule order."""
    lowered = text.fold(query)
    hints = []
    for groups, words in rules.EXPANSION_RULES:
        met = F.lit(True)
        for alternatives in groups:
            met = met & text.contains_any(lowered, alternatives)
        hints.append(F.when(met, F.lit(" ".join(words))))
    joined = F.array_join(F.array_compact(F.array(*hints)), " ")
    return F.when(joined == "", query).otherwise(
        F.concat(query, F.lit("\nRelevant code concepts: "), joined)
    )


def _haystack() -> Column:
    return text.fold(F.concat_ws(" ", "qualified_name", "text"))


def _relevance(tokens: Column, haystack: Column) -> Column:
    """Identifiers that the haystack holds, snake-case ones counted thrice."""
    weight = lambda token: F.when(F.contains(token, F.lit("_")), 3).otherwise(1)
    held = lambda token: F.when(F.contains(haystack, token), weight(token)).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda total, token: total + held(token))


def rerank(hits: DataFrame) -> DataFrame:
    """Order each query's hits by shared identifiers, snake-case ones thrice, then by score.

    ``hits``: query_id, query, entity_id, qualified_name, text, score. Adds relevance and rank.
    """
    scored = hits.withColumn("relevance", _relevance(text.identifiers(F.col("query")), _haystack()))
    order = [F.col("relevance").desc(), F.col("score").desc(), F.col("entity_id")]
    return top_per(scored, ["query_id"], order, 100)


def fuse(exact: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, entity_id, rank).

    Equal scores keep first-seen order: exact hits by rank, then semantic hits by rank.
    """
    sources = F.array_compact(
        F.array(
            F.when(F.count_if(F.col("position") == 0) > 0, F.lit("exact")),
            F.when(F.count_if(F.col("position") == 1) > 0, F.lit("semantic")),
        )
    )
    # Sum in list order, so the result does not depend on row order.
    part = [
        F.coalesce(F.sum(F.when(F.col("position") == p, 1.0 / (RANK_CONSTANT + F.col("rank")))), F.lit(0.0))
        for p in (0, 1)
    ]
    fused = (
        exact.select("query_id", "entity_id", "rank", F.lit(0).alias("position"))
        .unionByName(semantic.select("query_id", "entity_id", "rank", F.lit(1).alias("position")))
        .groupBy("query_id", "entity_id")
        .agg(
            (part[0] + part[1]).alias("score"),
            sources.alias("sources"),
            F.min(F.struct("position", "rank")).alias("first_seen"),
        )
    )
    order = [F.col("score").desc(), F.col("first_seen"), F.col("entity_id")]
    return top_per(fused, ["query_id"], order, limit).drop("first_seen")


def hybrid_search(
    entities: DataFrame,
    chunks: DataFrame,
    questions: DataFrame,
    limit: int = 10,
    rank_before_filter: bool = False,
    embedder: str = "hash",
    index: Cells | None = None,
    pieces: PieceIndex | None = None,
) -> DataFrame:
    """Fuse name matches with vector matches for questions (query_id, SCOPE, query).

    Name matches are ranked inside the question's repository and revision. With
    ``rank_before_filter`` they are ranked over the whole corpus first and then filtered, which
    leaves gaps in the ranks. With ``index`` the chunks are searched by their stored cells; ``pieces`` is the
    stored piece index of the entities.
    """
    check_limit(limit)
    names = questions.withColumnRenamed("query", "name")
    pieces = pieces or postings.build(entities)
    exact = ranked_matches(pieces, names, min(limit * 2, 100), scoped=not rank_before_filter).filter(
        (F.col("query.repository_id") == F.col("repository_id"))
        & (F.col("query.revision") == F.col("revision"))
    )
    exact = staged(exact.select("query_id", F.col("id").alias("entity_id"), "rank"))
    expanded = vectors.embedded(questions.withColumn("query", expand_query(F.col("query"))), embedder)
    rows, found = vectors.nearest(chunks, expanded, min(max(limit * 8, 50), 100), index)
    described = found.join(chunks.select(*SCOPE, "entity_id", _haystack().alias("haystack")), [*SCOPE, "entity_id"])
    named = exact.groupBy("query_id").agg(F.collect_set("entity_id").alias("named"))
    asked = rows.select("query_id", "asked", "salt", text.identifiers(F.col("query")).alias("tokens"))
    near = vectors.with_hits(
        asked.join(named, "query_id", "left"), described, F.struct("entity_id", "score", "haystack")
    )
    # As rerank orders them. Texts stay with the vector, whose hits are the same for all its queries.
    ordered = F.sort_array(
        F.transform(
            "hits",
            lambda hit: F.struct(
                (-_relevance(F.col("tokens"), hit["haystack"])).alias("relevance"), (-hit["score"]).alias("score"),
                hit["entity_id"].alias("entity_id"),
            ),
        )
    )
    ranked = F.transform(ordered, lambda hit, at: F.struct(hit["entity_id"].alias("entity_id"), (at + 1).alias("rank")))
    # A vector hit after the first ``limit`` is among the fused only if it is a name match as well.
    wanted = lambda hit: (hit["rank"] <= limit) | F.array_contains("named", hit["entity_id"])
    semantic = near.select("query_id", F.explode(F.filter(ranked, wanted)).alias("hit")).select("query_id", "hit.*")
    return fuse(exact, semantic, limit)
