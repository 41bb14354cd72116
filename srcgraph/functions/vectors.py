"""Vector expressions and embedders: the offline one, and models registered by a session."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.session import cut_lineage, lookup_join

DIMENSION = 64
_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+")


def normalise(vector: Column) -> Column:
    length = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(
        F.transform(vector, lambda x: x.cast("double"))
    )


@lru_cache(maxsize=65_536)
def _slot(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:2], "big") % DIMENSION


def hash_vector(text: str) -> np.ndarray:
    """Counts of identifier tokens in hashed slots: stands in for a language model offline."""
    slots = [_slot(token) for token in _TOKEN.findall(text.lower())]
    counts = np.bincount(slots, minlength=DIMENSION).astype(np.float64)
    length = np.sqrt((counts * counts).sum())
    return counts / length if length else counts


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: hash_vector(text).astype(np.float32))


# One loaded model per name in each Python worker, kept while Spark reuses the worker.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


@dataclass(frozen=True)
class Embedder:
    """``column`` maps a text column to its vectors. With ``once``, equal texts are embedded once."""

    column: Callable[[Column], Column]
    once: bool = False


def model_embedder(
    name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], rows: int = 256
) -> Embedder:
    """Embedder of a model that ``load`` returns: a function of a list of texts to a matrix.

    A worker loads it at its first batch and keeps it; the model sees ``rows`` texts at a time, and no
    text twice. A null text has no vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            present = texts[texts.notna()]
            made = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for first in range(0, len(present), rows):
                block = present.iloc[first : first + rows]
                if name not in _LOADED:
                    _LOADED[name] = load()
                matrix = np.asarray(_LOADED[name](block.tolist()), dtype=np.float32)
                if len(matrix) != len(block):
                    raise ValueError(f"{name} returned {len(matrix)} vectors for {len(block)} texts")
                for index, vector in zip(block.index, matrix):
                    made.at[index] = vector
            yield made

    return Embedder(embedding, once=True)


# A session with a model at hand registers its own here. The hash embedder costs less than the shuffle
# that finds equal texts.
EMBEDDERS = {"hash": Embedder(hash_embedding)}


def embed(text: Column, embedder: str = "hash") -> Column:
    return EMBEDDERS[embedder].column(text)


def with_embedding(rows: DataFrame, text: str, embedder: str = "hash") -> DataFrame:
    """``rows`` with the column ``embedding``. For a model, texts meet by content hash: one row of each
    text is embedded and its vector joined back, spread where one text holds many rows."""
    if not EMBEDDERS[embedder].once:
        return rows.withColumn("embedding", embed(F.col(text), embedder))
    # The rows are read twice; written first, so that what made them runs once.
    keyed = cut_lineage(rows.withColumn("_text_key", F.unhex(F.sha2(F.col(text), 256))))
    texts = keyed.filter(F.col(text).isNotNull()).select("_text_key", F.col(text).alias("_text"))
    # Written too: a lost executor or a second use of the vectors must not run the model again.
    made = cut_lineage(
        texts.dropDuplicates(["_text_key"]).select("_text_key", embed(F.col("_text"), embedder).alias("embedding"))
    )
    return lookup_join(keyed, made, ["_text_key"], rows.columns[:1], how="left").drop("_text_key")
