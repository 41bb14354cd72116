"""Session set-up and the two run-time habits every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCOPE = ["repository_id", "revision"]


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("srcgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by spark.checkpoint.dir; invent one only for local runs."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Like a reliable checkpoint it survives lost executors, but it is compressed by column and later reads
    pick columns; a checkpoint keeps every row as it is in memory.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is; for tables that are already computed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that one task of ``dealt`` takes on average.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` by hash of ``keys`` over as many tasks as ``rows`` take, the session's shuffle partitions at least.

    What follows by these keys, or by more, needs no other shuffle, and a task's memory does not grow with the input.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT_ROWS))
    return df.repartition(parts, *keys)


def lookup_join(
    left: DataFrame,
    index: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    hot_keys: int = 256,
    salts: int = 32,
) -> DataFrame:
    """N:1 join that stays even when a few keys hold most rows of ``left``.

    ``index`` has one row, or a few, per key. The ``hot_keys`` most frequent keys of ``left`` (a row
    count fixed by the argument, so broadcasting them is safe at any scale) are spread over
    ``salts`` sub-keys and their index rows are repeated once per sub-key; every other key joins
    as usual.
    """
    frequent = F.broadcast(
        left.groupBy(*keys)
        .count()
        .orderBy(F.col("count").desc(), *keys)
        .limit(hot_keys)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted_left = left.join(frequent, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    salted_index = index.join(frequent, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return salted_left.drop("_hot").join(salted_index.drop("_hot"), [*keys, "_salt"], how).drop(
        "_salt"
    )


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key with their rank; Spark prunes groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def running_last(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key in ``order``.

    A key may own a large part of the table, so rows are windowed per (key, bucket) and only one
    summary row per bucket is windowed per key. ``bucket`` must not decrease along ``order``.
    """
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    group = [*keys, "_bucket"]
    position = F.struct(*order)
    summary = bucketed.filter(F.col("_value").isNotNull()).groupBy(*group).agg(
        F.max_by("_value", position).alias("_value")
    )
    every = bucketed.select(*group).distinct().join(summary, group, "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*group, F.last("_value", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, group, "left")
        .withColumn(name, F.coalesce("_inside", "_before"))
        .drop("_bucket", "_value", "_inside", "_before")
    )


def ranked_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row number per key for keys of any size.

    Rows are range-partitioned by key and order, so one key may span many partitions; each
    partition numbers its own rows and adds the row counts of the key's earlier partitions.
    """
    parts = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    group = [*keys, "_part"]
    inside = Window.partitionBy(*group).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*group)
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    return (
        parts.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_part", "_inside", "_offset")
    )
