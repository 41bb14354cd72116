"""What the training-data operators share: table access, word rules, staged tables, binary search."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.session import ensure_checkpoint_dir

#: A word is a run of characters outside ASCII white space; bytes.split() in Python cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def fold(remainder: int, of: int, key: str = "doc_id") -> Column:
    """True for rows whose crc32 of the key as text leaves ``remainder``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == remainder, F.lit(False))


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Like a reliable checkpoint it survives lost executors, but later reads can pick columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_HELD: dict = {}


def held(name: object, make):
    """In a Python worker: what ``make`` gives, kept for later tasks of the same operator.

    A worker holds one such thing at a time, so the memory of a pipeline's stages does not add up.
    """
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """In a Python worker: drop what earlier operators kept, and give unused memory back."""
    import ctypes
    import gc

    import pyarrow

    _HELD.clear()
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: freed memory stays with the worker


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
