"""Keyed merges of new rows into stored tables. Inputs and outputs are DataFrames; publishing the
result is the job of ``sources.tables``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import ids
from srcgraph.session import SCOPE

EDGE_KEY = [*SCOPE, "source_id", "kind", "target_id"]
FILE = [*SCOPE, "file_path"]


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both tables, one per key; new rows win, among them the last by ``order``."""
    values = [c for c in old.columns if c not in keys]
    within = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    stored = old.select(*keys, *values, F.lit(-1).cast("bigint").alias("_rank"))
    fresh = new.select(*keys, *values, within.alias("_rank"))
    return (
        stored.unionByName(fresh)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col("_rank")).alias("_kept"))
        .select(*keys, *[F.col(f"_kept.{v}").alias(v) for v in values])
        .select(*old.columns)
    )


def graph_entities(extracted: DataFrame) -> DataFrame:
    """Extracted entities in stored form: keyed by id, with the revision they were last seen in."""
    return extracted.select(
        "id", "repository_id", F.col("revision").alias("latest_revision"), "kind", "name",
        "qualified_name", "file_path", "start_line", "end_line", "content_hash",
        F.to_json(_sorted_map("metadata")).alias("metadata_json"), "ord",
    )


def _sorted_map(column: str):
    return F.map_from_entries(F.array_sort(F.map_entries(column)))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by id; the last definition of an id in its file wins. ``new`` carries ``ord``."""
    return merge_by_key(old, new, ["id"], "ord")


def memberships(extracted: DataFrame) -> DataFrame:
    return extracted.select(
        F.col("id").alias("entity_id"),
        ids.revision_id(F.col("repository_id"), F.col("revision")).alias("revision_id"),
    ).distinct()


def upsert_memberships(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def graph_edges(resolved: DataFrame) -> DataFrame:
    """Resolved references in stored form with their order in the file."""
    return resolved.select(
        *EDGE_KEY, "target_qualified_name", "resolved", "file_path", "line",
        F.to_json(_sorted_map("metadata")).alias("metadata_json"),
        (F.col("ord").cast("bigint") * 1_000 + F.col("pos")).alias("place"),
    )


def upsert_edges(
    old: DataFrame, new: DataFrame, entities: DataFrame, external: DataFrame
) -> DataFrame:
    """Edges by (source, kind, target); call sites of one pair collapse, the last line wins.

    Rows whose source is no entity, or whose target is neither entity nor external symbol, are
    dropped. Stale edges to external symbols are removed from the old table first.
    """
    known = entities.select("id")
    targets = known.unionByName(external.select("id")).distinct()
    complete = new.join(
        known.withColumnRenamed("id", "source_id").distinct(), "source_id", "left_semi"
    ).join(targets.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return merge_by_key(without_stale(old, complete), complete, EDGE_KEY, "place")


def without_stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges minus those to an external symbol that a resolved edge now replaces.

    The replacement has the same source, kind, file and line.
    """
    site = [*SCOPE, "source_id", "kind", "file_path", "line"]
    replaced = new.filter(F.col("resolved")).select(*site).distinct().withColumn("_new", F.lit(True))
    return (
        old.join(replaced, site, "left")
        .filter(F.col("resolved") | F.col("_new").isNull())
        .select(*old.columns)
    )


def upsert_external(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_by_key(old, new, ["id"])


def upsert_revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Revision rows by id; a provenance value that is not given keeps the stored one."""
    values = [c for c in old.columns if c != "id"]
    both = old.select("id", *[F.col(c).alias(f"old_{c}") for c in values]).join(
        new.select("id", *[F.col(c).alias(f"new_{c}") for c in values]), "id", "full_outer"
    )
    return both.select("id", *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in values])


def replace_files(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Vector rows with those of touched files replaced; a touched file without new rows loses its own."""
    return delete_files(old, touched).unionByName(new.select(*old.columns))


def delete_files(rows: DataFrame, removed: DataFrame) -> DataFrame:
    return rows.join(removed.select(*FILE).distinct(), FILE, "left_anti")


def put_manifest(manifest: DataFrame, entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Manifest after a job: removed paths leave, new entries replace."""
    path = ["repository_id", "file_path"]
    kept = manifest.join(removed.select(*path).distinct(), path, "left_anti")
    return merge_by_key(kept, entries, path)


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
