"""Cells of an inverted vector index: centroids, the cell stored with each chunk, and how many cells to ask.

A chunk is stored with the cell of its nearest centroid; a query meets only the chunks of the cells nearest to
it, with exact scores inside. How many cells that takes for a wanted recall is measured: the exact best chunks
of a bounded sample of queries say at which place of the query's cell order each of them lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.session import SCOPE

#: Rows the centroids are fitted on, most centroids, queries that the number of cells is measured on.
SAMPLE, MOST_CELLS, QUERIES = 8_192, 1_024, 256
RECALL = 0.95


@dataclass(frozen=True)
class Cells:
    """Unit centroids, and how many of the nearest ones a query asks."""

    centroids: np.ndarray
    probes: int


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def _centroids(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    different = np.unique(rows, axis=0)
    centroids = different[np.random.default_rng(0).permutation(len(different))[:count]]
    for _ in range(rounds):
        near = np.argmax(rows @ centroids.T, axis=1)
        for k in np.unique(near):
            centroids[k] = rows[near == k].mean(axis=0)
        centroids = unit(centroids)
    return centroids


def _drawn(df: DataFrame, rows: int, key: str) -> DataFrame:
    """About ``rows`` rows, at most twice as many, the same ones on every run."""
    many = max(df.count(), 1)
    return df.filter(F.pmod(F.xxhash64(*SCOPE, key), F.lit(many)) < rows).limit(2 * rows)


def fit(chunks: DataFrame, count: int | None = None) -> Cells | None:
    """Cells for ``chunks`` (SCOPE, entity_id, embedding); None without vectors. They ask every cell until measured."""
    known = chunks.filter(F.col("embedding").isNotNull())
    rows = [r[0] for r in _drawn(known, SAMPLE, "entity_id").select("embedding").collect()] or [r[0] for r in known.select("embedding").limit(1).collect()]
    if not rows:
        return None
    count = count or int(np.clip(np.sqrt(known.count()) / 2, 4, MOST_CELLS))
    centroids = _centroids(unit(np.array(rows)), count)
    return Cells(centroids, len(centroids))


def nearest(embedding: Column, cells: Cells, count: int) -> Column:
    """The ``count`` nearest cells of a vector, nearest first."""
    centroids = cells.centroids

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors) == 0:
                yield pd.Series([], dtype=object)
                continue
            scores = unit(np.stack(vectors.to_numpy())) @ centroids.T
            yield pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :count].astype(np.int32)))

    return order(embedding)


def assign(chunks: DataFrame, cells: Cells) -> DataFrame:
    """``chunks`` with their ``cell``, to be stored with them; chunks without a vector are in none."""
    known = chunks.filter(F.col("embedding").isNotNull())
    return known.withColumn("cell", F.element_at(nearest(F.col("embedding"), cells, 1), 1))


def asked(queries: DataFrame, cells: Cells) -> DataFrame:
    """One row per query and cell that it asks."""
    return queries.filter(F.col("embedding").isNotNull()).withColumn("cell", F.explode(nearest(F.col("embedding"), cells, cells.probes)))


def measured(cells: Cells, stored: DataFrame, queries: DataFrame, limit: int, recall: float = RECALL) -> Cells:
    """``cells`` asking as few cells as give ``recall`` of the best ``limit`` chunks over a sample of ``queries``."""
    from srcgraph.operators.vectors import cosine_top_k

    sample = _drawn(queries.select("query_id", *SCOPE, "embedding"), QUERIES, "query_id").cache()
    best = cosine_top_k(stored, sample, limit).select("query_id", "entity_id")
    order = sample.withColumn("order", nearest(F.col("embedding"), cells, len(cells.centroids)))
    places = (
        best.join(order.select("query_id", *SCOPE, "order"), "query_id")
        .join(stored.select(*SCOPE, "entity_id", "cell"), [*SCOPE, "entity_id"])
        .groupBy(F.array_position("order", F.col("cell")).cast("int").alias("place"))
        .count()
        .collect()
    )
    sample.unpersist()
    found = np.zeros(len(cells.centroids) + 1)
    for row in places:
        found[row["place"]] = row["count"]
    if not found.sum():
        return cells
    return replace(cells, probes=max(int(np.searchsorted(np.cumsum(found) / found.sum(), recall)), 1))
