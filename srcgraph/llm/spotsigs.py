"""Document fingerprints: SpotSigs.

A spot is a common word; its signature is the word with the chain of the next ``CHAIN`` content words.
So that texts without common words and short ones have signatures too, each of the first ``HEAD`` words
and every word whose hash is a multiple of ``EVERY`` is a spot as well. One rule holds for texts of all
lengths and languages: which words are spots changes by as many words as an edit does.
The fingerprint is the set of a text's signatures, written as base64 of the sorted 32-bit hashes, so
no part of a text is left out. Two fingerprints are compared by Jaccard; the set lengths bound it and
prune pairs before any signature is looked at. ``near_duplicates`` finds all pairs over a threshold:
sets meet through their rarest signatures, only within the length bound.

The query compares each document with its successor and with its own text edited by the successor's
beginning. Documents are dealt to ranges of doc_id; the first document of each range is sent to the
range before it too, so one shuffle brings every document next to its successor, and a task reads its
sorted ranges as a stream.

Defined results: null text is empty; an empty text has an empty fingerprint, and two empty ones are
alike (1.0); a text too short for one whole chain has one signature, the hash of all of it; equal doc_ids are ordered
by a hash of their texts; a null doc_id comes first; a lone document is its own successor; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import shuffle_partitions, table, whole
from srcgraph.llm.components import components
from srcgraph.llm.ngram_join import links

CHAIN = 2
HEAD, EVERY = 32, 8
MEMO = 300_000
MAX_RANGES, RANGE_CHARS = 65_536, 64_000_000

#: Common words of the languages in the corpus, in lower case.
SPOTS = frozenset(
    "the a an and of to in is that it for was with as be by on are this from at or "
    "der die das und ist zu den mit von ein eine auf im nicht sich für als des dem "
    "le la les et un une est en que pour dans sur pas par au du il elle qui "
    "el los las y es por con para se no una lo como".split()
)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to its hash; the lowest bit tells a common word, the next one another spot."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = h & ~3 | (h // 4 % EVERY == 0) << 1 | (word.decode("utf-8", "replace") in SPOTS)
        self[word] = h
        return h


def signatures(text: str, words: _Words) -> np.ndarray:
    """Sorted distinct 32-bit signatures of the whole text."""
    tokens = text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    hashes = np.array([words[t] for t in tokens], dtype=np.uint64)
    common = (hashes & np.uint64(1)).astype(bool)
    spot = (hashes & np.uint64(3)).astype(bool)
    spot[:HEAD] = True
    # Where the content words after each spot begin.
    content, ahead = hashes[~common], np.cumsum(~common)[spot]
    inside = ahead + CHAIN <= len(content)
    ahead = ahead[inside]
    # Mixed first: a spot can be equal to the word that follows it.
    h = hashes[spot][inside] * _MIX
    for k in range(CHAIN):
        h = (h ^ content[ahead + k]) * _MIX
        h ^= h >> np.uint64(31)
    if len(h) == 0:
        return np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))] if text else [], dtype="<u4")
    return np.unique((h >> np.uint64(32)).astype("<u4"))


def encoded(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode("ascii")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0.0 at once where their lengths rule ``at_least`` out."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small == 0 or small < at_least * large:
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, signatures) of each row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [signatures(t or "", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encoded(f) for f in found], pa.string()), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "fingerprint", "signatures"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, component_id): documents linked by fingerprints at the threshold; empty texts with none."""
    prints = fingerprints(docs).withColumn("set_key", F.unhex(F.md5("fingerprint")))
    classes = prints.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("signatures").alias("signatures"))
    placed = classes.select("set_key", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    counts = placed.groupBy("signature").agg(F.count("*").alias("count"))
    sets = (
        placed.join(counts, "signature")
        .groupBy("set_key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("count", "signature"))).alias("listed"))
        .select(
            "set_key", "n", F.col("listed.signature").alias("grams"),
            (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int").alias("head"),
        )
    )
    labels = components(links(sets, percent)).withColumnRenamed("node", "set_key")
    joined = classes.select("set_key", "least").join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    groups = joined.groupBy("label").agg(F.min("least").alias("component"))
    final = joined.join(groups, "label").select("set_key", "component")
    return prints.select("doc_id", "set_key", "fingerprint").join(final, "set_key").select(
        "doc_id", F.when(F.col("fingerprint") == "", F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))

    def step(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        up = (span["lo"] < span["hi"]) & (F.get(listed, middle) <= key)
        return F.struct(
            F.when(up, middle + 1).otherwise(span["lo"]).alias("lo"),
            F.when(up | (span["lo"] >= span["hi"]), span["hi"]).otherwise(middle).alias("hi"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]


def beside_successor(docs: DataFrame) -> DataFrame:
    """Rows (range, guest, doc_id, text), sorted in each partition; in its range every document is
    followed by its successor, which stands there as a guest if its own range is another."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", whole("text").alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_key"))
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MAX_RANGES, max(4 * shuffle_partitions(spark), chars // RANGE_CHARS))
    cuts = [k / n for k in range(1, n)]
    bounds = keyed.agg(F.percentile_approx("_key", cuts, 10_000)).first()[0] or []
    ranged = keyed.withColumn("_range", _range_of(F.col("_key"), sorted(set(bounds))))
    # At most MAX_RANGES rows: the first document of each range, and the range before it.
    firsts = sorted(ranged.groupBy("_range").agg(F.min("_key")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    if not before:
        return ranged.select("_range", F.lit(False).alias("guest"), "doc_id", "text")
    guests = F.broadcast(spark.createDataFrame(before, "_key long, _to int"))
    dealt = ranged.join(guests, "_key", "left").select(
        F.explode(
            F.when(
                F.col("_to").isNotNull(),
                F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("guest"))),
            ).otherwise(F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("guest"))))
        ).alias("at"),
        "_key", "doc_id", "text",
    )
    return (
        dealt.select("at.*", "_key", "doc_id", "text")
        .repartition(shuffle_partitions(spark), "_range")
        .sortWithinPartitions("_range", "guest", "_key", F.xxhash64("text"))
        .select("_range", "guest", "doc_id", "text")
    )


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the successor's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _Words(), None
        for batch in batches:
            rows = []
            for place, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                mine = signatures(text, words)
                if last is not None and last[0] == place and not last[1]:
                    _, _, before, own, print_ = last
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    changed = signatures(edited, words)
                    rows.append((
                        before, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(print_), encoded(changed),
                        likeness(print_, changed), likeness(print_, mine),
                    ))
                last = (place, guest, doc, text, mine)
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return beside_successor(docs).mapInArrow(run, _COMPARED)


def op6(spark, folder: str) -> DataFrame:
    return compared(table(spark, folder, "documents"))
