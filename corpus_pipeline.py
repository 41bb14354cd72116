"""Corpus pipeline: documents without toxic and languageless ones, one of each near-duplicate group,
mixed to target weights and packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
checkpoint folder as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm import language, mixing, ngram_join, packing, toxicity
from srcgraph.llm.common import fresh, staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; the model is fitted on their labels."""
    name = fresh(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter go; all stay where no language could be learned."""
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    model = language.fit(docs)
    return docs if model is None else language.predict(docs, model, names).filter(F.col(names[0]) != "und").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the Jaccard similarity of five-word shingles, 0.8 or more."""
    return ngram_join.one_of_each(docs, stored=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("ngram_jaccard_join", without_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: Model scores and random draws decide rows, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
