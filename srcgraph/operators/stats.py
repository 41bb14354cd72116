"""Graph statistics and the bounded ad-hoc query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcgraph.operators.lookup import check_limit

QUERY_LIMITS = (1, 200)  # fixed values


def _digest(*columns: str) -> Column:
    """128 bits of the SHA-256 of the columns, null if one is."""
    return F.unhex(F.left(F.sha2(F.concat(*[F.concat(F.length(c), F.lit(":"), F.col(c)) for c in columns]), 256), F.lit(32)))


def kind_counts(membership: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and distinct outgoing edges per revision and entity kind.

    ``membership`` (entity_id, revision_id) says which entities a revision holds. Edges are
    counted per source before the join, so a busy source moves one row. Rows move with digests of 16 bytes
    in place of ids, which are most of a row and hardly compress.
    """
    outgoing = (
        edges.select(_digest("source_id").alias("entity_id"), _digest("kind", "target_id").alias("edge"))
        .distinct()
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("edges"))
    )
    kinds = entities.select(_digest("id").alias("entity_id"), "kind").distinct()
    return (
        membership.withColumn("entity_id", _digest("entity_id"))
        .distinct()
        .join(kinds, "entity_id")
        .join(outgoing, "entity_id", "left")
        .groupBy("revision_id", "kind")
        .agg(
            F.count(F.lit(1)).alias("entity_count"),
            F.coalesce(F.sum("edges"), F.lit(0)).cast("bigint").alias("relationship_count"),
        )
    )


def graph_statistics(membership: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals per revision with the entity counts by kind as a map."""
    return (
        kind_counts(membership, entities, edges)
        .groupBy("revision_id")
        .agg(
            F.sum("entity_count").alias("entity_count"),
            F.sum("relationship_count").alias("relationship_count"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "entity_count")))).alias(
                "entities_by_kind"
            ),
        )
    )


def bounded_query(rows: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` rows and whether there were more.

    One row beyond the limit is read to know; at most 201 rows are numbered.
    """
    check_limit(limit, QUERY_LIMITS)
    everything = Window.partitionBy(F.lit(0))
    return (
        rows.limit(limit + 1)
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("truncated", F.count(F.lit(1)).over(everything) > limit)
        .withColumn("_rank", F.row_number().over(everything.orderBy("_position")))
        .filter(F.col("_rank") <= limit)
        .drop("_position", "_rank")
    )


def bounded_sql(spark: SparkSession, statement: str, limit: int = 50) -> DataFrame:
    """A user's Spark SQL over registered views, bounded; parameters go through spark.sql."""
    return bounded_query(spark.sql(statement), limit)
