"""Chunk vectors: text, embedding, cosine top-k (exact or by stored cells), carry-forward."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import ids, text, vectors
from srcgraph.operators import cells
from srcgraph.operators.cells import Cells
from srcgraph.session import SCOPE, cut_lineage, lookup_join, ranked_within, top_per

SEARCHABLE_KINDS = ["class", "function", "method"]  # fixed values
MAXIMUM_CHARACTERS = 4_000  # fixed value
#: Rows of one side that a task holds at a time, and scores it holds; larger blocks are copied less often.
QUERY_BLOCK = 16_384
CHUNK_BLOCK = 65_536
SCORES = 4_194_304
#: Queries of one vector that meet its hits in one task.
QUERIES_TOGETHER = 4_096


def chunk_texts(
    entities: DataFrame, files: DataFrame, maximum_characters: int | None = MAXIMUM_CHARACTERS
) -> DataFrame:
    """One text per class, function and method: heading, path, its source lines.

    Cut to ``maximum_characters`` as the embedding model wants it; None keeps whole definitions.
    """
    key = [*SCOPE, "file_path"]
    wanted = (
        entities.filter(F.col("kind").isin(*SEARCHABLE_KINDS))
        .select(
            *key, F.col("id").alias("entity_id"), "kind", "name", "qualified_name", "start_line",
            "end_line", "content_hash",
        )
    )
    lined = files.select(*key, text.lines(F.col("content").cast("string")).alias("lines"))
    span = F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    heading = F.concat(
        "kind", F.lit(" "), "qualified_name", F.lit("\nFile: "), "file_path", F.lit("\n")
    )
    whole = F.concat(heading, F.array_join(span, "\n"))
    kept = whole if maximum_characters is None else F.substring(whole, 1, maximum_characters)
    return wanted.join(lined, key).withColumn("text", kept).drop("lines")


def index_chunks(
    entities: DataFrame,
    files: DataFrame,
    embedder: str = "hash",
    maximum_characters: int | None = MAXIMUM_CHARACTERS,
) -> DataFrame:
    """Chunk texts with their vector and name-based id."""
    chunks = chunk_texts(entities, files, maximum_characters)
    return vectors.with_embedding(chunks, "text", embedder).withColumn(
        "point_id",
        ids.vector_id(F.col("repository_id"), F.col("revision"), F.col("entity_id")),
    )


def carry_vectors(chunks: DataFrame, carried: DataFrame) -> DataFrame:
    """Copy chunks to another revision. ``carried``: SCOPE, file_path, target_revision."""
    return (
        chunks.join(carried, [*SCOPE, "file_path"])
        .withColumn("revision", F.col("target_revision"))
        .withColumn(
            "point_id",
            ids.vector_id(F.col("repository_id"), F.col("revision"), F.col("entity_id")),
        )
        .select(*chunks.columns)
    )


def file_vectors(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows with vectors of the wanted files (SCOPE, file_path), without a cap."""
    return chunks.join(wanted.select(*SCOPE, "file_path").distinct(), [*SCOPE, "file_path"], "left_semi")


def _unit(matrix: list) -> np.ndarray:
    values = np.array([np.asarray(row, dtype=np.float64) for row in matrix])
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(length == 0, 1.0, length)


def _best(queries: pd.DataFrame, chunks: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Exact best ``limit`` chunks of one block for each query; ties by number."""
    chunks = chunks.sort_values("chunk")
    numbers, asked = chunks["chunk"].to_numpy(), queries["asked"].to_numpy()
    right, left = _unit(chunks["embedding"].tolist()).T, _unit(queries["embedding"].tolist())
    step = max(SCORES // len(numbers), 1)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), step):
        scores = np.round(left[at : at + step] @ right, 9)
        least = np.full(len(scores), -np.inf)
        if len(numbers) > limit:
            least = np.partition(scores, -limit, axis=1)[:, -limit]
        for query, row, bound in zip(asked[at : at + step], scores, least):
            near = np.flatnonzero(row >= bound)
            kept = near[np.argsort(-row[near], kind="stable")][:limit]
            parts.append((np.full(len(kept), query), numbers[kept], row[kept]))
    return pd.DataFrame(dict(zip(("asked", "chunk", "score"), map(np.concatenate, zip(*parts)))))


def _block_hits(chunks: DataFrame, queries: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Fixed-size blocks of chunks meet fixed-size blocks of queries of the same ``keys``.

    Block counts per key come from row counts, so no group outgrows a task however large a
    repository or a cell is. Rows go by number (asked, chunk), since ids would be most of what is shuffled.
    """

    def block_counts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = block_counts(chunks, CHUNK_BLOCK, "chunk_blocks").join(
        block_counts(queries, QUERY_BLOCK, "query_blocks"), keys
    )

    def assign(df: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        # Fresh column identities, since both sides may stem from one table.
        return (
            df.select(*[F.col(c).alias(c) for c in df.columns])
            .join(sizes, keys)
            .withColumn(own[:-1], F.pmod(F.xxhash64(id_column), F.col(own)).cast("int"))
            .withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("chunk_blocks", "query_blocks")
            .select(*[F.col(c).alias(c) for c in (*df.columns, own[:-1], other[:-1])])
        )

    group = [*keys, "chunk_block", "query_block"]
    left = assign(queries, "asked", "query_blocks", "chunk_blocks").groupBy(*group)
    right = assign(chunks, "chunk", "chunk_blocks", "query_blocks").groupBy(*group)

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"asked": [], "chunk": [], "score": []})
        return _best(q, c, limit)

    return left.cogroup(right).applyInPandas(score, "asked long, chunk long, score double")


def _asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with the number of their vector (columns asked, salt), and each different vector of a scope once
    (asked, salts, SCOPE, embedding)."""
    rows = cut_lineage(queries)
    salts = F.ceil(F.count(F.lit(1)) / QUERIES_TOGETHER).cast("int")
    different = cut_lineage(
        rows.groupBy(*SCOPE, "embedding").agg(salts.alias("salts")).withColumn("asked", F.monotonically_increasing_id())
    )
    salt = F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")
    numbered = lookup_join(rows, different, [*SCOPE, "embedding"], ["query_id"]).withColumn("salt", salt)
    return numbered.drop("embedding", "salts"), different


def nearest(
    chunks: DataFrame, queries: DataFrame, limit: int, index: Cells | None = None
) -> tuple[DataFrame, DataFrame]:
    """Queries with the number of their vector, and the hits of each vector (asked, salts, SCOPE, entity_id, score, rank).

    Queries of a scope with equal vectors have the same hits, so their vector is searched once; ``with_hits``
    brings both together. See ``cosine_top_k`` for the rest.
    """
    keys = list(SCOPE) if index is None else [*SCOPE, "cell"]
    # Numbers in order of id, so that ties by number are ties by id.
    numbered = ranked_within(chunks.select(*keys, "entity_id", "embedding"), [], ["entity_id", *keys], "chunk")
    rows, different = _asked_once(queries)
    asked = different.drop("salts") if index is None else cells.asked(different.drop("salts"), index)
    hits = _block_hits(numbered.drop("entity_id"), asked.select("asked", *keys, "embedding"), limit, keys)
    best = top_per(hits, ["asked"], [F.col("score").desc(), F.col("chunk")], limit)
    found = best.join(numbered.select("chunk", "entity_id"), "chunk").join(different.drop("embedding"), "asked")
    return rows, found.select("asked", "salts", *SCOPE, "entity_id", "score", "rank")


def with_hits(rows: DataFrame, found: DataFrame, hit: Column) -> DataFrame:
    """``rows`` with the hits of their vector as array ``hits`` of ``hit``, made of the columns of ``found``."""
    listed = found.groupBy("asked", "salts").agg(F.collect_list(hit).alias("hits"))
    salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return rows.join(salted, ["asked", "salt"]).drop("asked", "salt")


def cosine_top_k(chunks: DataFrame, queries: DataFrame, limit: int, index: Cells | None = None) -> DataFrame:
    """Cosine top-k per query inside its repository and revision.

    ``chunks``: SCOPE, entity_id, embedding; ``queries``: query_id, SCOPE, embedding. Any
    number of queries takes the same plan: both sides are cut into blocks. Without ``index`` all chunks of
    a repository are compared and the result is exact. With it, ``chunks`` also have the cell they were stored
    with, and a query meets the chunks of the cells it asks. Scores are rounded to nine places so that equal
    vectors tie by id.
    """
    rows, found = nearest(chunks, queries.select("query_id", *SCOPE, "embedding"), limit, index)
    shown = with_hits(rows, found, F.struct("entity_id", "score", "rank"))
    return shown.select("query_id", F.explode("hits").alias("hit")).select("query_id", "hit.*")


def embedded(questions: DataFrame, embedder: str = "hash") -> DataFrame:
    """Questions with their vector; blank ones are left out."""
    return questions.filter(text.strip(F.col("query")) != "").withColumn(
        "embedding", vectors.embed(F.col("query"), embedder)
    )


def search(
    chunks: DataFrame, questions: DataFrame, limit: int, embedder: str = "hash", index: Cells | None = None
) -> DataFrame:
    """Embed questions (query_id, SCOPE, query) and search; blank questions give nothing."""
    return cosine_top_k(chunks, embedded(questions, embedder), limit, index)
