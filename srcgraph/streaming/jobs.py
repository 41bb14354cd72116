"""Index job streams: duplicate requests, progress, bounded logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from srcgraph.operators import incremental
from srcgraph.session import cut_lineage
from srcgraph.sources import tables


def first_requests(requests: DataFrame, life: str = "7 days") -> DataFrame:
    """Requests that claim their identity; repeats within the life are dropped.

    ``requests``: repository_id, revision, mode, repository_path, job_id, created_at TIMESTAMP.
    """
    return (
        incremental.index_identity(requests)
        .withWatermark("created_at", life)
        .dropDuplicatesWithinWatermark(["identity"])
    )


def progress(increments: DataFrame) -> DataFrame:
    """Running counters per job (update or complete mode)."""
    return incremental.job_progress(increments)


def maintain(
    stream: DataFrame, root: str, name: str, bound: Callable[[DataFrame], DataFrame], checkpoint: str, key: list[str], buckets: int = 64
) -> DataStreamWriter:
    """Keep a bounded table (last turns, audits, episodes, preferences) current from a stream.

    Rows are stored in ``buckets`` partitions by ``key``, the columns within which ``bound`` works. A batch reads and
    replaces only the buckets it has rows for: each becomes bound(stored rows + new rows). A bucket names
    the batch that wrote it last, so a batch that is replayed after a failure leaves finished buckets alone.
    """
    layout = (["_bucket"], key)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        mark = f"{checkpoint}/{batch_id}"
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        touched = rows.select("_bucket").distinct()
        finished = tables.written_by(spark, root, name, mark)
        if finished is not None:
            touched = touched.withColumn(tables.PART, tables.part(["_bucket"])).join(finished, tables.PART, "left_anti").drop(tables.PART)
        touched = cut_lineage(touched)
        if touched.isEmpty():
            return
        stored = tables.get(spark, root, name)
        if stored is not None:
            rows = stored.unionByName(rows)
        rows = rows.join(touched, "_bucket", "left_semi").drop("_bucket")
        kept = bound(rows).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        tables.replace(spark, root, name, cut_lineage(kept), touched, mark, layout)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
