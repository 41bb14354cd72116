"""Corpus sources: directory scan, revision precedence, snapshot markers, corpus metadata."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions.ids import content_hash
from srcgraph.session import SCOPE, cut_lineage

_LISTED = "folder string, name string, is_folder boolean, length bigint"
_READ = "repository_id string, revision string, file_path string, content binary, length bigint, origin string"
#: A task hands over the files it has read after this many bytes.
READ_BATCH_BYTES = 32_000_000
#: Files that one task reads at most on average; many small files cost requests, not bytes.
FILES_PER_TASK = 5_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder (root, folder relative to the root)."""
    for batch in batches:
        for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, base = fs.FileSystem.from_uri(root)
            local = isinstance(system, fs.LocalFileSystem)
            place = f"{base}/{folder}" if folder else base
            found = [
                entry for entry in system.get_file_info(fs.FileSelector(place))
                # A link to a folder may lead back to one of its parents.
                if not (local and entry.type == fs.FileType.Directory and os.path.islink(entry.path))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([folder] * len(found), pa.string()),
                    pa.array([entry.base_name for entry in found], pa.string()),
                    pa.array([entry.type == fs.FileType.Directory for entry in found], pa.bool_()),
                    pa.array([entry.size or 0 for entry in found], pa.int64()),
                ],
                names=["folder", "name", "is_folder", "length"],
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the files (uri, repository_id, revision, file_path, origin)."""
    schema = pa.schema(
        [("repository_id", pa.string()), ("revision", pa.string()), ("file_path", pa.string()),
         ("content", pa.binary()), ("length", pa.int64()), ("origin", pa.string())]
    )
    systems: dict[str, tuple] = {}
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            root = row["root"]
            if root not in systems:
                systems[root] = fs.FileSystem.from_uri(root)
            system, base = systems[root]
            with system.open_input_stream(f"{base}/{row['inside']}", compression=None) as stream:
                content = stream.read()
            rows.append({name: row.get(name) for name in schema.names} | {"content": content, "length": len(content)})
            held += len(content)
            if held >= READ_BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def list_folder(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """(root, inside, repository_id, revision, file_path, length, origin) of the files under ``path``.

    The layout is <path>/<repository>/[revisions/<revision>/]files. Tasks list the folders of one
    depth at a time, on any file system that Arrow can open, so a wide or deep tree is never walked by
    one task or the driver. Ignored and hidden folders of a snapshot are not entered; names that begin
    with an underscore count, which Spark's file sources leave out. Links to folders are not followed.
    """
    root = _uri(path)
    folders = spark.createDataFrame([(root, "")], "root string, folder string")
    levels: list[DataFrame] = []
    while True:
        # Listing is cut from its lineage, so that a folder is read once however many steps follow.
        entries = cut_lineage(folders.mapInArrow(_listed, _LISTED)).withColumn(
            "inside", F.concat_ws("/", F.nullif("folder", F.lit("")), "name")
        )
        levels.append(entries.filter(~F.col("is_folder") & F.endswith("name", F.lit(suffix))).select("inside", "length"))
        parts = F.split("inside", "/")
        # Names of repositories and of revisions are free.
        free = (F.size(parts) == 1) | ((F.size(parts) == 3) & (F.get(parts, F.lit(1)) == "revisions"))
        deeper = entries.filter(F.col("is_folder") & (free | ~is_ignored(F.col("name"))))
        if deeper.isEmpty():
            break
        folders = deeper.select(F.lit(root).alias("root"), F.col("inside").alias("folder")).repartition("folder")
    files = reduce(DataFrame.unionByName, levels)
    parts = F.split("inside", "/")
    stored = F.get(parts, F.lit(1)) == "revisions"
    inner = F.when(stored, F.slice(parts, 4, F.size(parts))).otherwise(F.slice(parts, 2, F.size(parts)))
    return (
        files.select(
            F.lit(root).alias("root"), "inside",
            F.get(parts, F.lit(0)).alias("repository_id"),
            F.when(stored, F.get(parts, F.lit(2))).alias("revision"),
            F.array_join(inner, "/").alias("file_path"), "length",
            F.when(stored, "snapshot").otherwise("checkout").alias("origin"),
        )
        .filter(F.col("file_path") != "")
    )


def _uri(path: str) -> str:
    """A path without a scheme is a local one; Spark's ``file:/x`` is what Arrow calls ``file:///x``."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def scan_folder(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """Files under ``path`` (see ``list_folder``) with their bytes.

    Files are dealt to as many tasks as their bytes need at ``spark.sql.files.maxPartitionBytes``.
    ``__init__.py``, hidden and empty files are returned; which of them count is decided by
    ``source_files`` on the relative path.
    """
    found = list_folder(spark, path, suffix)
    total = found.agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).first()
    split = _bytes_setting(spark)
    tasks = max(1, -(-(total.bytes or 0) // split), -(-total.files // FILES_PER_TASK))
    tasks = max(tasks, min(total.files, spark.sparkContext.defaultParallelism))
    return (
        found.repartition(tasks, "inside")
        .select("root", "inside", "repository_id", "revision", "file_path", "origin")
        .mapInArrow(_read, _READ)
        .withColumn("content_hash", content_hash(F.col("content")))
    )


def _bytes_setting(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB").strip().lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    return int(text[:-1] if scale else text) << scale


def write_folder(files: DataFrame, path: str) -> None:
    """Write (repository_id, revision, file_path, content) in the layout that ``scan_folder`` reads; a
    null revision is the checkout. A task that runs again writes the same files again."""
    root = _uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for inside, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{inside}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target, compression=None) as stream:
                    stream.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["written"])

    inside = F.concat_ws("/", "repository_id", F.concat(F.lit("revisions/"), F.col("revision")), "file_path")
    rows = files.select(inside.alias("inside"), F.coalesce("content", F.lit(b"")).cast("binary").alias("content"))
    rows.mapInArrow(run, "written bigint").write.format("noop").mode("overwrite").save()


def is_ignored(path: Column) -> Column:
    """True if any part of the relative path is hidden or one of the ignored directories."""
    return F.exists(
        F.split(path, "/"),
        lambda part: part.isin(*rules.IGNORED_DIRECTORIES) | F.startswith(part, F.lit(".")),
    )


def source_files(files: DataFrame) -> DataFrame:
    """Python files that belong to the corpus."""
    return files.filter(F.endswith("file_path", F.lit(".py")) & ~is_ignored(F.col("file_path")))


def prefer_snapshot(
    snapshots: DataFrame, checkouts: DataFrame, wanted: DataFrame, per_file: bool = True
) -> DataFrame:
    """Files for the wanted (repository, revision) rows: its snapshot wins over the checkout.

    Per file, a path missing from the snapshot is taken from the checkout; otherwise the checkout
    counts only for revisions without any snapshot. ``checkouts`` has no meaningful revision.
    """
    revisions = wanted.select(*SCOPE).distinct()
    exact = snapshots.join(revisions, SCOPE, "left_semi")
    fallback = checkouts.drop("revision").join(revisions, "repository_id")
    # Only keys of the snapshot meet the checkout, so snapshot contents are never shuffled.
    covered = exact.select(*SCOPE, "file_path") if per_file else exact.select(*SCOPE).distinct()
    missing = fallback.join(covered, covered.columns, "left_anti")
    return exact.unionByName(missing.select(*exact.columns))


def marker_rows(markers: DataFrame) -> DataFrame:
    """Acquisition metadata from marker files (SCOPE, content JSON).

    A marker counts only if it is an object whose revision is the requested one; values of the
    wrong type and unreadable timestamps become null.
    """
    def value(name: str) -> Column:
        """The member if it is a JSON string, else null (numbers and objects are not accepted)."""
        raw = F.try_variant_get(F.col("_json"), f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get(F.col("_json"), f"$.{name}", "variant"))
        return F.when(kind == "STRING", raw)

    parsed = markers.withColumn("_json", F.try_parse_json("content"))
    return parsed.filter(value("revision") == F.col("revision")).select(
        *SCOPE,
        value("remote_url").alias("remote_url"),
        value("requested_ref").alias("requested_ref"),
        F.try_to_timestamp(value("commit_timestamp")).alias("commit_timestamp"),
        F.try_to_timestamp(value("captured_at")).alias("captured_at"),
    )


def corpus_metadata(files: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """File count, Python file count and bytes per snapshot; ignored paths do not count."""
    totals = (
        files.filter(~is_ignored(F.col("file_path")))
        .groupBy(*SCOPE)
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.count_if(F.endswith("file_path", F.lit(".py"))).alias("python_file_count"),
            F.sum("length").cast("bigint").alias("total_bytes"),
        )
    )
    return totals if markers is None else totals.join(marker_rows(markers), SCOPE, "left")


def manifest_entries(manifest: DataFrame, repositories: DataFrame) -> DataFrame:
    """All manifest entries of the given repositories (column ``repository_id``)."""
    return manifest.join(repositories.select("repository_id"), "repository_id", "left_semi")
