"""Incremental index: what changed between a manifest and a scan, and what follows from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import ids
from srcgraph.session import SCOPE, cut_lineage, ranked_within, running_last

PATH = ["repository_id", "file_path"]
CLAIM_LIFE = 604_800  # fixed value: seconds a job claim holds


def manifest_diff(
    manifest: DataFrame,
    files: DataFrame,
    mode: str = "incremental",
    analysis_version: int = rules.ANALYSIS_VERSION,
) -> DataFrame:
    """Class of every path: unchanged, changed, new or removed.

    A file is unchanged if path, hash and analysis version are as in the manifest; unchanged files
    are skipped in incremental mode only. ``same_content`` tells that stored vectors still fit.
    Only repositories that were scanned are compared.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown index mode {mode}")
    known = manifest.join(
        files.select("repository_id").distinct(), "repository_id", "left_semi"
    ).select(
        *PATH,
        F.col("content_hash").alias("old_hash"),
        F.col("revision").alias("source_revision"),
        "analysis_version",
    )
    scanned = files.select(*PATH, F.col("content_hash").alias("new_hash"), F.lit(True).alias("seen"))
    same = F.col("old_hash") == F.col("new_hash")
    status = (
        F.when(F.col("seen").isNull(), "removed")
        .when(F.col("old_hash").isNull(), "new")
        .when(same & (F.col("analysis_version") == analysis_version), "unchanged")
        .otherwise("changed")
    )
    return known.join(scanned, PATH, "full_outer").select(
        *PATH,
        status.alias("status"),
        "new_hash",
        "old_hash",
        "source_revision",
        F.coalesce(same, F.lit(False)).alias("same_content"),
        ((F.lit(mode) == "incremental") & (status == "unchanged")).alias("skipped"),
    )


def rename_pairs(diff: DataFrame) -> DataFrame:
    """Pair each new path with one removed path of equal content, one to one, by path order.

    Many files may share one content (empty package markers), so ranks are computed without
    bringing a content's copies into one task.
    """
    fresh = ranked_within(
        diff.filter(F.col("status") == "new").select(
            "repository_id", F.col("new_hash").alias("content_hash"), F.col("file_path").alias("new_path")
        ),
        ["repository_id", "content_hash"],
        ["new_path"],
    )
    gone = ranked_within(
        diff.filter(F.col("status") == "removed").select(
            "repository_id", F.col("old_hash").alias("content_hash"), F.col("file_path").alias("old_path")
        ),
        ["repository_id", "content_hash"],
        ["old_path"],
    )
    return fresh.join(gone, ["repository_id", "content_hash", "rank"]).drop("rank")


def carry_forward(membership: DataFrame, entities: DataFrame, skipped: DataFrame) -> DataFrame:
    """Membership rows that bind entities of unchanged files to the new revision.

    ``skipped``: repository_id, file_path, source_revision, new_hash, target_revision.
    """
    kept = entities.select("id", *PATH, F.col("content_hash").alias("new_hash")).join(
        skipped, [*PATH, "new_hash"]
    )
    wanted = kept.select(
        F.col("id").alias("entity_id"),
        ids.revision_id(F.col("repository_id"), F.col("source_revision")).alias("revision_id"),
        ids.revision_id(F.col("repository_id"), F.col("target_revision")).alias("target"),
    )
    return (
        membership.select("entity_id", "revision_id")
        .join(wanted, ["entity_id", "revision_id"])
        .select("entity_id", F.col("target").alias("revision_id"))
        .distinct()
    )


def detach(membership: DataFrame, entities: DataFrame, removed: DataFrame) -> DataFrame:
    """Membership without the entities of removed files.

    ``removed``: repository_id, file_path, revision (the revision to leave).
    """
    leaving = entities.select(F.col("id").alias("entity_id"), *PATH).join(removed, PATH).select(
        "entity_id",
        ids.revision_id(F.col("repository_id"), F.col("revision")).alias("revision_id"),
    )
    return membership.join(leaving, ["entity_id", "revision_id"], "left_anti")


def latest_revisions(membership: DataFrame, revisions: DataFrame) -> DataFrame:
    """Newest revision of each entity by indexing time, then id; deterministic."""
    times = revisions.select(F.col("id").alias("revision_id"), "sha", "indexed_at")
    return (
        membership.join(times, "revision_id")
        .groupBy("entity_id")
        .agg(F.max_by("sha", F.struct("indexed_at", "revision_id")).alias("latest_revision"))
    )


def drop_orphans(
    entities: DataFrame, edges: DataFrame, membership: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entities still in some revision, and the edges between what remains.

    External symbols are not entities, so an edge only falls with an *orphaned* end.
    """
    orphans = entities.join(
        membership.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"
    ).select("id")
    kept_edges = edges.join(
        orphans.withColumnRenamed("id", "source_id"), "source_id", "left_anti"
    ).join(orphans.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return entities.join(orphans, "id", "left_anti"), kept_edges.select(*edges.columns)


def missing_vectors(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files of a revision that have no vector yet and must be embedded."""
    key = [*SCOPE, "file_path"]
    return files.join(chunks.select(*key).distinct(), key, "left_anti")


def job_counters(
    diff: DataFrame, written: DataFrame, failed: DataFrame, renames: DataFrame
) -> DataFrame:
    """Counters of each repository's job.

    ``written``: repository_id, file_path, entity_count, relationship_count, chunk_count of files
    written or carried; ``failed``: repository_id, file_path of unparsable files.
    """
    bad = failed.select(*PATH).distinct().withColumn("bad", F.lit(True))
    # A skipped file was indexed before, so it is never reported as failed again.
    joined = (
        diff.join(bad, PATH, "left")
        .join(written, PATH, "left")
        .join(
            renames.select("repository_id", F.col("old_path").alias("file_path"), F.lit(True).alias("moved")),
            PATH,
            "left",
        )
    )
    present = F.col("status") != "removed"
    is_bad = F.coalesce("bad", F.lit(False)) & ~F.col("skipped")
    fresh = present & ~F.col("skipped") & ~is_bad

    def total(column: str, condition) -> DataFrame:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("bigint")

    moved = F.coalesce("moved", F.lit(False))
    return joined.groupBy("repository_id").agg(
        F.count_if(present).alias("discovered_files"),
        F.count_if(present).alias("processed_files"),
        F.count_if(F.col("skipped")).alias("skipped_files"),
        F.count_if(is_bad & present).alias("failed_files"),
        total("entity_count", fresh).alias("entity_count"),
        total("relationship_count", fresh).alias("relationship_count"),
        total("chunk_count", present & ~is_bad).alias("semantic_chunk_count"),
        F.count_if(~present & ~moved).alias("deleted_file_count"),
        F.count_if(moved).alias("renamed_file_count"),
    )


def job_status(counters: DataFrame) -> DataFrame:
    """Completed, or failed with its message; a failed job removes and publishes nothing."""
    failed = F.col("failed_files") > 0
    return counters.withColumns(
        {
            "status": F.when(failed, "failed").otherwise("completed"),
            "error": F.when(failed, F.lit(rules.PARSE_FAILURE_ERROR)),
            "deleted_file_count": F.when(failed, 0).otherwise(F.col("deleted_file_count")),
            "renamed_file_count": F.when(failed, 0).otherwise(F.col("renamed_file_count")),
        }
    )


def index_identity(requests: DataFrame) -> DataFrame:
    parts = F.concat_ws("\0", "repository_id", "revision", "mode", "repository_path")
    return requests.withColumn("identity", F.sha2(parts, 256))


def _next_claims(times: DataFrame, life: int) -> DataFrame:
    """(identity, at, next): the first request that would claim anew after a claim at ``at``.

    Times are cut into buckets one claim long, so a claim lapses in the bucket after its own: the next
    request is the first one there after the lapse, or else the first of the next bucket with any.
    """
    bucket = F.floor(F.col("at") / life)
    placed = times.select("identity", "at", bucket.alias("bucket"), F.col("at").alias("seen"), F.lit(None).cast("long").alias("of"))
    lapses = times.select(
        "identity", (F.col("at") + life).alias("at"), (bucket + 1).alias("bucket"), F.lit(None).cast("long").alias("seen"), F.col("at").alias("of")
    )
    ahead = Window.partitionBy("identity", "bucket").orderBy("at", F.col("of").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    inside = placed.unionByName(lapses).withColumn("inside", F.first("seen", ignorenulls=True).over(ahead)).filter("of IS NOT NULL")
    buckets = (
        placed.groupBy("identity", "bucket").agg(F.min("at").alias("least"))
        .unionByName(lapses.select("identity", "bucket", F.lit(None).cast("long").alias("least")))
        .groupBy("identity", "bucket")
        .agg(F.min("least").alias("least"))
    )
    later = Window.partitionBy("identity").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    after = buckets.withColumn("later", F.first("least", ignorenulls=True).over(later)).drop("least")
    return inside.join(after, ["identity", "bucket"]).select("identity", F.col("of").alias("at"), F.coalesce("inside", "later").alias("next"))


def claim_jobs(requests: DataFrame, life: int = CLAIM_LIFE) -> DataFrame:
    """The job each request ends up with: the first request of its identity within ``life``.

    ``requests``: identity, job_id, created_at. A claim is not prolonged; the first request after
    it lapses claims anew. From an identity's first request the claims are reached along next claims,
    twice as many in every round, so their number of rounds is the logarithm of the longest chain.
    """
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    timed = requests.withColumn("_at", micros)
    times = cut_lineage(timed.groupBy("identity", F.col("_at").alias("at")).agg(F.min("job_id").alias("job")))
    hop = cut_lineage(_next_claims(times, life * 1_000_000).filter("next IS NOT NULL"))
    claims = times.groupBy("identity").agg(F.min("at").alias("at"))
    while not hop.isEmpty():
        reached = claims.join(hop, ["identity", "at"]).select("identity", F.col("next").alias("at"))
        claims = cut_lineage(claims.unionByName(reached).distinct())
        onward = hop.select("identity", F.col("at").alias("next"), F.col("next").alias("onward"))
        hop = cut_lineage(hop.join(onward, ["identity", "next"]).select("identity", "at", F.col("onward").alias("next")))
    held = claims.join(times, ["identity", "at"]).select("identity", F.col("at").alias("_at"), F.col("job").alias("_job"))
    marked = timed.join(held, ["identity", "_at"], "left")
    claimed = running_last(
        marked, ["identity"], ["_at"], F.floor(F.col("_at") / (life * 1_000_000)), F.col("_job"), "claimed_job_id"
    )
    return claimed.drop("_at", "_job")


def fail_interrupted(jobs: DataFrame, now: datetime) -> DataFrame:
    """Jobs left pending or running by a stopped process are marked failed."""
    open_job = F.col("status").isin("pending", "running")
    return jobs.withColumns(
        {
            "status": F.when(open_job, "failed").otherwise(F.col("status")),
            "completed_at": F.when(open_job, F.lit(now)).otherwise(F.col("completed_at")),
            "error": F.when(open_job, F.lit(rules.INTERRUPTED_ERROR)).otherwise(F.col("error")),
        }
    )


def job_progress(increments: DataFrame) -> DataFrame:
    """Sum of counter increments and last change per job (same query for batch and stream)."""
    return increments.groupBy("job_id").agg(
        F.sum("processed_files").alias("processed_files"),
        F.sum("failed_files").alias("failed_files"),
        F.sum("entity_count").alias("entity_count"),
        F.max("at").alias("updated_at"),
    )
