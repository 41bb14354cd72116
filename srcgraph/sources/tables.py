"""Stored tables: parquet folders whose partitions are replaced one scope at a time.

A scope is a repository, or a repository and revision. Spark's dynamic partition overwrite rewrites the
partitions of the scopes a job has rows for and leaves all others where they are, so a job on one
repository writes nothing else. Each partition has one mark row with the batch that wrote it last: it
replaces partitions that have become empty and tells a replayed stream batch from a new one.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.session import SCOPE

REPOSITORY = SCOPE[:1]
# Per table: the columns of its scope, then the order inside files, whose parquet statistics serve lookups.
LAYOUT = {
    "entities": (SCOPE, ["qualified_name"]),
    "references": (SCOPE, ["file_path"]),
    "edges": (SCOPE, ["source_id"]),
    "chunks": (SCOPE, ["file_path"]),
    "extents": (SCOPE, ["file_path"]),
    "analyses": (SCOPE, ["file_path", "definition"]),
    "patterns": (SCOPE, ["file_path"]),
    "names": (SCOPE, ["number"]),
    "postings": (SCOPE, ["piece", "block"]),
    "issues": (SCOPE, []),
    "graph_edges": (SCOPE, ["source_id"]),
    "memberships": (SCOPE, ["entity_id"]),
    "graph_entities": (REPOSITORY, ["id"]),
    "external": (REPOSITORY, ["id"]),
    "manifest": (REPOSITORY, ["file_path"]),
    "revisions": (REPOSITORY, []),
    "jobs": (REPOSITORY, []),
}
#: Tables written at a time: each write is a few short stages, which leave most of a cluster idle.
WRITERS = 4
PART, BATCH, LIVE = "_part", "_batch", "_live"


def part(columns: list[str]) -> Column:
    """Name of a scope's partition: always text, whatever the values look like."""
    values = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns])
    return F.concat(F.lit("p"), F.substring(F.sha2(values.cast("binary"), 256), 1, 32))


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def get(spark: SparkSession, root: str, name: str, scopes: DataFrame | None = None) -> DataFrame | None:
    """The rows of a stored table, or None if nothing was ever written; of ``scopes`` alone if given.

    The scopes are joined on the partition column, so Spark prunes the partitions of all others.
    """
    stored = _stored(spark, root, name)
    if stored is None:
        return None
    if scopes is not None:
        stored = stored.join(scopes.select(part(LAYOUT[name][0]).alias(PART)).distinct(), PART, "left_semi")
    return stored.filter(LIVE).drop(PART, BATCH, LIVE)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    table = get(spark, root, name)
    if table is None:
        raise LookupError(f"no table {name} under {root}")
    return table


def replace(
    spark: SparkSession, root: str, name: str, rows: DataFrame, scopes: DataFrame, batch: str = "",
    layout: tuple[list[str], list[str]] | None = None,
) -> None:
    """Make ``rows`` the content of the partitions of ``scopes``; both are computed before anything is replaced."""
    columns, order = layout or LAYOUT[name]
    marks = scopes.select(part(columns).alias(PART)).distinct()
    live = rows.withColumn(PART, part(columns)).withColumn(LIVE, F.lit(True))
    body = live.unionByName(marks.withColumn(LIVE, F.lit(False)), allowMissingColumns=True).withColumn(BATCH, F.lit(batch))
    # By range, so that a large scope is spread over tasks and a small one is one file.
    (
        body.repartitionByRange(PART, *order)
        .sortWithinPartitions(PART, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART)
        .parquet(f"{root}/{name}")
    )


def replace_all(
    spark: SparkSession, root: str, rows: dict[str, DataFrame], scopes: DataFrame, batch: str = ""
) -> None:
    """``replace`` of several tables whose writes do not wait for each other; returns when all are written."""
    write = inheritable_thread_target(spark)(lambda name: replace(spark, root, name, rows[name], scopes, batch))
    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(write, rows))


def written_by(spark: SparkSession, root: str, name: str, batch: str) -> DataFrame | None:
    """Partitions that ``batch`` wrote last."""
    stored = _stored(spark, root, name)
    return None if stored is None else stored.filter(~F.col(LIVE) & (F.col(BATCH) == batch)).select(PART)


def bucketed(table: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a catalog table bucketed by its key, so later joins on the key need no shuffle."""
    table.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_report(report: DataFrame, path: str) -> None:
    """JSON report: one row per summary or case, written where the job runs."""
    report.write.mode("overwrite").json(path)
