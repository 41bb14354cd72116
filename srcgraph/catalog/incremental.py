"""Incremental index: revision r1 of the document files against revision r2."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.functions import ids
from srcgraph.operators import incremental, upsert, vectors
from srcgraph.session import cut_lineage, ensure_checkpoint_dir
from srcgraph.sources.adapters import next_text_files, table, text_files

REVISIONS = """
WITH old AS (SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path, sha256(text) AS hash FROM documents),
new AS (
  SELECT source AS repo, CASE WHEN quality IS NULL THEN 'moved/' ELSE '' END || lang || '/' || doc_id || '.txt' AS path,
    sha256(CASE WHEN quality = 0 THEN text || chr(10) || 'edited' ELSE text END) AS hash
  FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT 'src0', 'benchmark/' || item_id || '.txt', sha256(text) FROM benchmark),
diff AS (SELECT coalesce(o.repo, n.repo) AS repository_id, coalesce(o.path, n.path) AS file_path,
    CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'new' WHEN o.hash = n.hash THEN 'unchanged'
         ELSE 'changed' END AS status, n.hash AS new_hash, o.hash AS old_hash
  FROM old o FULL JOIN new n ON o.repo = n.repo AND o.path = n.path),
pair AS (SELECT n.repository_id, n.file_path AS new_path, o.file_path AS old_path, n.new_hash AS content_hash FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id, new_hash ORDER BY file_path) AS k FROM diff WHERE status = 'new') n
  JOIN (SELECT *, row_number() OVER (PARTITION BY repository_id, old_hash ORDER BY file_path) AS k FROM diff WHERE status = 'removed') o
  ON o.repository_id = n.repository_id AND o.old_hash = n.new_hash AND o.k = n.k)
"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return text_files(spark, folder).select(
        "repository_id", "file_path", "content_hash", "revision", F.lit(2).alias("analysis_version")
    )


def diff(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.manifest_diff(manifest(spark, folder), next_text_files(spark, folder))


@query(
    "manifest_diff",
    REVISIONS + "SELECT repository_id, file_path, status, new_hash, old_hash, status = 'unchanged' AS skipped FROM diff",
)
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diff(spark, folder).drop("source_revision", "same_content")


@query("rename_pairs", REVISIONS + "SELECT * FROM pair")
def rename_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.rename_pairs(diff(spark, folder))


def _file_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One entity per r1 file and one per line of it that is not empty."""
    from srcgraph.functions.text import lines

    path = F.col("file_path")
    return (
        text_files(spark, folder)
        .withColumn("line", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.size(lines(F.col("content")))))))
        .select(
            F.concat_ws("#", F.concat("repository_id", F.lit("/"), path), "line").alias("id"),
            "repository_id", "file_path", "content_hash",
            ids.revision_id(F.col("repository_id"), F.col("revision")).alias("revision_id"),
        )
    )


ENTITIES = REVISIONS + """, entity AS (SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path,
    source || '/' || lang || '/' || doc_id || '.txt#' || line AS id, sha256(text) AS hash
  FROM (SELECT *, unnest(range(0, 2 + length(text) - length(replace(text, chr(10), ''))
      - (right(text, 1) = chr(10))::INT)) AS line FROM documents))
"""


@query(
    "carry_forward",
    ENTITIES
    + """SELECT id AS entity_id, repo || ':r2' AS revision_id FROM entity
JOIN diff ON repository_id = repo AND file_path = path WHERE status = 'unchanged'""",
)
def carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    entities = _file_entities(spark, folder)
    membership = entities.select(F.col("id").alias("entity_id"), "revision_id")
    skipped = diff(spark, folder).filter("skipped").withColumn("target_revision", F.lit("r2"))
    return incremental.carry_forward(membership, entities, skipped)


@query(
    "detach_delete",
    ENTITIES
    + """, gone AS (SELECT repo, path FROM entity JOIN diff ON repository_id = repo AND file_path = path
  WHERE status = 'removed')
SELECT id AS entity_id, 'r1' AS latest_revision FROM entity
WHERE (repo, path) NOT IN (SELECT repo, path FROM gone)
UNION ALL SELECT e.id, 'r0' FROM entity e WHERE (repo, path) IN (SELECT repo, path FROM gone)
  AND starts_with(path, 'en/')""",
)
def detach_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Removed files leave r1; English ones were also in r0 and stay with that as their latest."""
    entities = _file_entities(spark, folder)
    now = entities.select(F.col("id").alias("entity_id"), "revision_id")
    before = entities.filter(F.startswith("file_path", F.lit("en/"))).select(
        F.col("id").alias("entity_id"), F.concat("repository_id", F.lit(":r0")).alias("revision_id")
    )
    removed = diff(spark, folder).filter("status = 'removed'").select(
        "repository_id", "file_path", F.lit("r1").alias("revision")
    )
    left = incremental.detach(now.unionByName(before), entities, removed)
    sources = table(spark, folder, "documents").select(F.col("source").alias("repository_id")).distinct()
    revisions = sources.select(
        "repository_id", F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("sha")
    ).select(
        F.concat_ws(":", "repository_id", "sha").alias("id"), "sha",
        F.when(F.col("sha") == "r0", F.lit(datetime(2024, 1, 1))).otherwise(F.lit(datetime(2024, 2, 1))).alias("indexed_at"),
    )
    return incremental.latest_revisions(left, revisions)


@query(
    "orphan_edges",
    REVISIONS
    + """SELECT o.repo || '/' || o.path AS source_id, 'lang:' || left(o.path, 2) AS target_id FROM old o
JOIN diff ON repository_id = o.repo AND file_path = o.path WHERE status <> 'removed'""",
)
def orphan_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of files to their language symbol; those of files without any revision go."""
    files = text_files(spark, folder)
    node = F.concat_ws("/", "repository_id", "file_path")
    entities = files.select(node.alias("id"))
    edges = files.select(
        node.alias("source_id"), F.concat(F.lit("lang:"), F.substring("file_path", 1, 2)).alias("target_id")
    )
    kept = diff(spark, folder).filter("status not in ('removed', 'new')")
    membership = kept.select(node.alias("entity_id"), F.lit("r2").alias("revision_id"))
    return incremental.drop_orphans(entities, edges, membership)[1]


@query(
    "job_counters",
    REVISIONS
    + """, bad AS (SELECT DISTINCT repository_id, file_path FROM diff
    WHERE status IN ('new', 'changed') AND starts_with(replace(file_path, 'moved/', ''), 'es/')),
counted AS (SELECT d.*, b.file_path IS NOT NULL AS bad, p.old_path IS NOT NULL AS moved FROM diff d
  LEFT JOIN bad b USING (repository_id, file_path)
  LEFT JOIN pair p ON p.repository_id = d.repository_id AND p.old_path = d.file_path)
SELECT repository_id, count(*) FILTER (status <> 'removed') AS discovered_files,
  count(*) FILTER (status <> 'removed') AS processed_files, count(*) FILTER (status = 'unchanged') AS skipped_files,
  count(*) FILTER (bad) AS failed_files,
  (2 * count(*) FILTER (status IN ('new', 'changed') AND NOT bad))::BIGINT AS entity_count,
  (3 * count(*) FILTER (status IN ('new', 'changed') AND NOT bad))::BIGINT AS relationship_count,
  count(*) FILTER (status <> 'removed' AND NOT bad) AS semantic_chunk_count,
  CASE WHEN count(*) FILTER (bad) > 0 THEN 0 ELSE count(*) FILTER (status = 'removed' AND NOT moved) END AS deleted_file_count,
  CASE WHEN count(*) FILTER (bad) > 0 THEN 0 ELSE count(*) FILTER (moved) END AS renamed_file_count,
  CASE WHEN count(*) FILTER (bad) > 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN count(*) FILTER (bad) > 0 THEN 'One or more discovered Python files failed to parse' END AS error
FROM counted GROUP BY repository_id""",
)
def job_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Spanish files fail to parse; every other file yields two entities, three edges, one chunk."""
    changes = cut_lineage(diff(spark, folder))
    failed = changes.filter(
        F.startswith(F.regexp_replace("file_path", "^moved/", ""), F.lit("es/"))
        & (F.col("status") != "removed")
    ).select("repository_id", "file_path")
    written = changes.select(
        "repository_id", "file_path", F.lit(2).alias("entity_count"),
        F.lit(3).alias("relationship_count"), F.lit(1).alias("chunk_count"),
    )
    renames = incremental.rename_pairs(changes)
    return incremental.job_status(incremental.job_counters(changes, written, failed, renames))


@query(
    "manifest_put",
    REVISIONS
    + """SELECT repo AS repository_id, path AS file_path, hash AS content_hash, 'r2' AS revision, 2 AS analysis_version FROM new""",
)
def manifest_put(spark: SparkSession, folder: str) -> DataFrame:
    entries = next_text_files(spark, folder).select(
        "repository_id", "file_path", "content_hash", "revision", F.lit(2).alias("analysis_version")
    )
    removed = diff(spark, folder).filter("status = 'removed'")
    return upsert.put_manifest(manifest(spark, folder), entries, removed)


@query(
    "vector_replace",
    REVISIONS
    + """, chunk AS (SELECT repository_id, file_path, 'old' AS text FROM diff WHERE status IN ('unchanged', 'removed')
  UNION ALL SELECT repository_id, file_path, 'new' FROM diff WHERE status = 'changed')
SELECT * FROM chunk""",
)
def vector_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of changed files are replaced, the others stay."""
    rows = ["repository_id", "revision", "file_path"]
    old = text_files(spark, folder).select(*rows, F.lit("old").alias("text"))
    changed = diff(spark, folder).filter("status = 'changed'").select(
        "repository_id", F.lit("r1").alias("revision"), "file_path"
    )
    new = changed.withColumn("text", F.lit("new"))
    return upsert.replace_files(old, new, changed).drop("revision")


@query(
    "vector_delete",
    REVISIONS + "SELECT repository_id, file_path FROM diff WHERE status NOT IN ('removed', 'new')",
)
def vector_delete(spark: SparkSession, folder: str) -> DataFrame:
    removed = diff(spark, folder).filter("status = 'removed'").withColumn("revision", F.lit("r1"))
    files = text_files(spark, folder).select("repository_id", "revision", "file_path")
    return upsert.delete_files(files, removed).drop("revision")


@query(
    "vector_backfill",
    REVISIONS + "SELECT repository_id, file_path FROM diff WHERE status IN ('new', 'changed')",
)
def vector_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Files of r2 that the carried vectors do not cover."""
    files = next_text_files(spark, folder)
    chunks = text_files(spark, folder).withColumn("entity_id", F.col("file_path")).withColumn("point_id", F.lit(""))
    same = diff(spark, folder).filter("status = 'unchanged'").select(
        "repository_id", F.lit("r1").alias("revision"), "file_path", F.lit("r2").alias("target_revision")
    )
    carried = vectors.carry_vectors(chunks, same)
    return incremental.missing_vectors(files, carried).select("repository_id", "file_path")


_CLAIM_LIFE = 604_800


@query(
    "idempotency",
    """WITH RECURSIVE req AS (SELECT event_id, ts, sha256(user_id || chr(0) || 'r1' || chr(0) || event_type || chr(0) || '/src') AS identity FROM events),
claim AS (SELECT identity, min(ts) AS at FROM req GROUP BY identity
  UNION ALL SELECT c.identity, (SELECT min(ts) FROM req r WHERE r.identity = c.identity AND r.ts >= c.at + INTERVAL 7 DAY)
  FROM claim c WHERE EXISTS (SELECT 1 FROM req r WHERE r.identity = c.identity AND r.ts >= c.at + INTERVAL 7 DAY)),
holder AS (SELECT c.identity, c.at, min(r.event_id) AS job_id FROM claim c JOIN req r ON r.identity = c.identity AND r.ts = c.at GROUP BY ALL)
SELECT req.identity, event_id AS job_id, h.job_id AS claimed_job_id FROM req
ASOF JOIN holder h ON h.identity = req.identity AND h.at <= req.ts""",
)
def idempotency(spark: SparkSession, folder: str) -> DataFrame:
    """Index requests by user and event type; the first within seven days owns the claim."""
    requests = incremental.index_identity(
        table(spark, folder, "events").select(
            F.col("user_id").cast("string").alias("repository_id"),
            F.lit("r1").alias("revision"),
            F.col("event_type").alias("mode"),
            F.lit("/src").alias("repository_path"),
            F.col("event_id").alias("job_id"),
            F.col("ts").alias("created_at"),
        )
    )
    # Digests go as bytes: as hex text they were most of what the rounds shuffle and write.
    claimed = incremental.claim_jobs(requests.select(F.unhex("identity").alias("identity"), "job_id", "created_at"))
    return claimed.withColumn("identity", F.lower(F.hex("identity"))).drop("created_at")


@query(
    "interrupted_sweep",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderstatus WHEN 'F' THEN o_orderdate ELSE TIMESTAMP '2024-01-01' END AS completed_at,
  CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'Indexer restarted before the job completed' END AS error FROM orders""",
)
def interrupted_sweep(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    jobs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "O", "pending").when(status == "P", "running").otherwise("completed").alias("status"),
        F.when(status == "F", F.col("o_orderdate").cast("timestamp_ntz")).alias("completed_at"),
        F.lit(None).cast("string").alias("error"),
    )
    swept = incremental.fail_interrupted(jobs, datetime(2024, 1, 1))
    return swept.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query(
    "job_progress",
    """SELECT user_id AS job_id, count(*) AS processed_files, count(*) FILTER (event_type = 'error') AS failed_files,
  sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS entity_count, max(ts) AS updated_at FROM events GROUP BY user_id""",
)
def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.job_progress(_increments(table(spark, folder, "events")))


def _increments(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("job_id"),
        F.lit(1).cast("bigint").alias("processed_files"),
        (F.col("event_type") == "error").cast("bigint").alias("failed_files"),
        F.get_json_object("props", "$.k").cast("bigint").alias("entity_count"),
        F.col("ts").alias("at"),
    )


@query(
    "index_job",
    """WITH d AS (SELECT lang AS repo, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS gone,
    count(*) FILTER (doc_id % 10 = 1) AS changed, count(*) FILTER (doc_id % 10 = 2) AS moved FROM documents GROUP BY lang)
SELECT repo AS repository_id, 'r1' AS revision, 'completed' AS status, n + 1 AS discovered_files, 0 AS skipped_files,
  0 AS failed_files, 3 * (n + 1) AS entity_count, 0 AS deleted_file_count, 0 AS renamed_file_count FROM d
UNION ALL
SELECT repo, 'r2', CASE WHEN repo = 'fr' THEN 'failed' ELSE 'completed' END, n - gone + CASE WHEN repo = 'fr' THEN 2 ELSE 1 END,
  n - gone - changed - moved, CASE WHEN repo = 'fr' THEN 1 ELSE 0 END, 3 * (changed + moved + 1),
  CASE WHEN repo = 'fr' THEN 0 ELSE gone END, CASE WHEN repo = 'fr' THEN 0 ELSE moved END FROM d""",
)
def index_job(spark: SparkSession, folder: str) -> DataFrame:
    """Two jobs over a file per document. The second one loses, changes and moves files; one file grows
    over a megabyte, and one repository gets a file that is not text and fails."""
    from uuid import uuid4

    from srcgraph.plans import index

    documents = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("repository_id"))
    kind = F.col("doc_id") % 10

    def files(revision: str) -> DataFrame:
        later = F.lit(revision == "r2")
        small = documents.filter(~later | (kind != 0)).select(
            "repository_id",
            F.concat(F.when(later & (kind == 2), "pkg/moved").otherwise("pkg/m"), "doc_id", F.lit(".py")).alias("file_path"),
            F.concat(
                F.lit("def f"), "doc_id", F.lit("():\n    return "), F.when(later & (kind == 1), F.lit("-")).otherwise(F.lit("")),
                "doc_id", F.lit("\n"),
            ).cast("binary").alias("content"),
        )
        padding = F.repeat(F.lit("#" * 99 + "\n"), F.when(later, 10_001).otherwise(1))
        repositories = documents.select("repository_id").distinct()
        large = repositories.select(
            "repository_id", F.lit("pkg/large.py").alias("file_path"),
            F.concat(F.lit("def large():\n    return 0\n"), padding).cast("binary").alias("content"),
        )
        raw = repositories.filter(later & (F.col("repository_id") == "fr")).select(
            "repository_id", F.lit("pkg/raw.py").alias("file_path"), F.unhex(F.lit("FFFE00")).alias("content")
        )
        every = small.unionByName(large).unionByName(raw).withColumn("revision", F.lit(revision))
        return every.withColumn("content_hash", ids.content_hash(F.col("content")))

    root = f"{ensure_checkpoint_dir(spark)}/index-{uuid4().hex}"
    jobs = [
        cut_lineage(index.index_revision(spark, root, files(revision), index.IndexRequest(f"job-{revision}")))
        for revision in ("r1", "r2")
    ]
    return jobs[0].unionByName(jobs[1]).select(
        "repository_id", "revision", "status", "discovered_files", "skipped_files", "failed_files", "entity_count",
        "deleted_file_count", "renamed_file_count",
    )
