"""Driver tables as engine tables: whole tables in, derived with plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import ids

FILE_SCHEMA = ["repository_id", "revision", "file_path", "content", "length", "content_hash"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Documents that one task takes of an input with few files; a task parses a few thousand in seconds.
TASK_ROWS = 4_096


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give every core work, and no task more than a few thousand rows, when the input has few files.

    ``rows`` is the number of rows where ``df`` is more than a scan, whose count is a metadata check. Inputs of
    many files already come in many splits and are left alone, so nothing is shuffled there.
    """
    many = df.count() if rows is None else rows
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-many // TASK_ROWS))
    return df.repartition(parts) if len(df.inputFiles()) < parts else df


def with_hash(files: DataFrame) -> DataFrame:
    return files.select(
        "repository_id",
        "revision",
        "file_path",
        "content",
        F.octet_length("content").cast("bigint").alias("length"),
        ids.content_hash(F.col("content")).alias("content_hash"),
    )


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a source file of its source's repository, revision r1."""
    documents = spread(table(spark, folder, "documents"))
    return with_hash(
        documents.select(
            F.col("source").alias("repository_id"),
            F.lit("r1").alias("revision"),
            F.concat("lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
            F.col("text").alias("content"),
        )
    )


def next_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Revision r2 of the same repositories.

    Toxic documents are deleted, low-quality ones are edited, unlabelled ones move to another
    folder, the other labelled ones stay, and every benchmark item is added to repository src0.
    """
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    judged = documents.join(labels, "doc_id", "left").filter(
        F.coalesce(F.col("toxic"), F.lit(0)) == 0
    )
    moved = F.when(F.col("quality").isNull(), F.lit("moved/")).otherwise(F.lit(""))
    kept = judged.select(
        F.col("source").alias("repository_id"),
        F.concat(moved, "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.when(F.col("quality") == 0, F.concat("text", F.lit("\nedited")))
        .otherwise(F.col("text"))
        .alias("content"),
    )
    added = table(spark, folder, "benchmark").select(
        F.lit("src0").alias("repository_id"),
        F.concat(F.lit("benchmark/"), F.col("item_id"), F.lit(".txt")).alias("file_path"),
        F.col("text").alias("content"),
    )
    return with_hash(kept.unionByName(added).withColumn("revision", F.lit("r2")))


# Python text written for each document. {text}, {id}, {parent}, {size} and {next} are columns.
CODE_TEMPLATE = '''"""{text}"""
import os.path
from pkg.m{parent} import C{parent} as Base
from . import m{parent} as sibling
from .m{parent} import *

@register
class C{id}(Base, sibling.Mixin):
    """Class {id}."""
    limit = compute({size})

    @cached(limit)
    def run(self, a, *args, flag: bool = True, **kw) -> int:
        """Run {id}."""
        if a > {size}:
            return self.step(a)
        for item in args:
            os.path.join(item, str(flag))
        return Base.run(self, a)

    async def step(self, a):
        try:
            await fetch(a)
        except ValueError:
            raise KeyError(a)
        return helper_{id}(a)

def helper_{id}(x, gate=Depends(limit)):
    from .m{parent} import C{parent}
    while x:
        x = size_{next}(x)
    return helper_{parent}(x)

def size_{size}(y):
    """Not unique: one per file of this length.

    Second paragraph.
    """
    return C{id}(y)
'''
BROKEN_CODE = "def broken(:\n"


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the literal pieces of a template with columns, left to right."""
    pieces: list[Column] = []
    rest = template
    while rest:
        literal, brace, rest = rest.partition("{")
        pieces.append(F.lit(literal))
        if brace:
            name, _, rest = rest.partition("}")
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """One Python file per document; repository is the language, toxic documents do not parse.

    The whole document text is the module docstring, so extraction reads every byte of it.
    """
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    escaped = F.replace(
        F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')
    )
    code = _fill(
        CODE_TEMPLATE,
        {
            "text": escaped,
            "id": F.col("doc_id"),
            "parent": F.expr("doc_id div 2"),
            "size": F.col("n_chars"),
            "next": F.col("n_chars") + 1,
        },
    )
    return with_hash(
        spread(documents.join(labels, "doc_id", "left"), documents.count()).select(
            F.col("lang").alias("repository_id"),
            F.lit("r1").alias("revision"),
            F.concat(F.lit("pkg/m"), F.col("doc_id"), F.lit(".py")).alias("file_path"),
            F.when(F.col("toxic") == 1, F.lit(BROKEN_CODE)).otherwise(code).alias("content"),
        )
    )
