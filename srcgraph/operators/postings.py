"""Piece index of entity names: which entities hold a piece of them.

Entities of a repository and revision are numbered in order of qualified name. Pieces of one to three letters
are written at indexing: a posting row holds one block of 4,096 numbers of one piece as 64 words of bits, and a
name that short is such a piece. Three letters are in nearly every block of a large table, so longer names do
not read postings: both ends of a name, as long as the name allows, are looked up among the pieces of the same
length of runs of 64 entities, and the name meets the runs that hold its rarer end. Postings pay where an index is
stored and asked again; a batch of questions over an index without them looks up short names by runs too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.session import SCOPE, cut_lineage, ranked_within, staged

GRAM = 3
WORD, BLOCK = 64, 4_096
#: Lengths of the ends that longer names are looked up by; a name takes the longest that fits.
ENDS = (4, 5, 6, 7, 8, 12, 16, 24, 32)
#: Sub-keys of a piece that is in many blocks, or in more runs than this.
SPREAD, HOT = 8, 1_024


@dataclass(frozen=True)
class PieceIndex:
    """``names``: SCOPE, number, id, kind, name, qualified_name; ``postings``: SCOPE, piece, block, entries, bits, or None."""

    names: DataFrame
    postings: DataFrame | None = None


def grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - F.lit(size - 1))
    return F.when(
        F.length(text) >= size,
        F.transform(starts, lambda start: F.substr(text, start, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def haystack(name: str = "name", qualified: str = "qualified_name") -> Column:
    """Both names, lowered, with a separator that is in no name."""
    return F.lower(F.concat_ws("\0", name, qualified))


def scoped_rows(df: DataFrame) -> DataFrame:
    """``df`` with both scope columns; a table without them is one scope."""
    return df.withColumns({c: F.lit("") for c in SCOPE if c not in df.columns})


def number(entities: DataFrame) -> PieceIndex:
    """Number the entities; the index has no postings."""
    kind = F.col("kind") if "kind" in entities.columns else F.lit(None).cast("string")
    narrow = scoped_rows(entities).select(*SCOPE, "id", kind.alias("kind"), "name", "qualified_name")
    numbered = ranked_within(narrow, list(SCOPE), ["qualified_name", "id"], "number")
    return PieceIndex(cut_lineage(numbered.withColumn("number", F.col("number").cast("long") - 1)))


def build(entities: DataFrame) -> PieceIndex:
    """Number the entities and write their postings."""
    names = number(entities).names
    pieces = F.array_distinct(F.concat(*[grams(haystack(), size) for size in range(1, GRAM + 1)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    words = (
        names.select(*SCOPE, F.floor(F.col("number") / WORD).alias("word"), bit.alias("bit"), F.explode(pieces).alias("piece"))
        .groupBy(*SCOPE, "piece", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    place = F.pmod("word", F.lit(BLOCK // WORD)).cast("int")
    held = F.map_from_entries(F.collect_list(F.struct(place.alias("place"), "bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // WORD - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long")))
    postings = (
        words.groupBy(*SCOPE, "piece", F.floor(F.col("word") * WORD / BLOCK).cast("long").alias("block"))
        .agg(held.alias("held"), F.sum(F.bit_count("bits")).alias("entries"))
        .select(*SCOPE, "piece", "block", "entries", dense.alias("bits"))
    )
    return PieceIndex(names, cut_lineage(postings))


def _unfolded(bits: str) -> Column:
    """Places of the set bits of an array of words."""
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    inside = lambda word, at: F.transform(
        F.filter(places, lambda b: F.call_function("shiftrightunsigned", word, b).bitwiseAND(1) == 1), lambda b: at * WORD + b
    )
    return F.flatten(F.transform(F.col(bits), lambda word, at: F.when(word == 0, F.array().cast("array<int>")).otherwise(inside(word, at))))


def candidates(index: PieceIndex, queries: DataFrame, scoped: bool) -> DataFrame:
    """(query, SCOPE, number) of the entities that hold a query's name of at most three letters.

    ``queries`` are asked in their own scope, or in all of them.
    """
    meet = [*SCOPE, "piece"] if scoped else ["piece"]
    term = F.lower("name")
    asked = queries.filter(F.length(term).between(1, GRAM)).select(
        F.struct(*queries.columns).alias("query"), *meet[:-1], term.alias("piece"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"),
    )
    salt = F.pmod("block", F.lit(SPREAD)).cast("int")
    found = asked.join(index.postings.withColumn("salt", salt), [*meet, "salt"])
    return found.select("query", *SCOPE, F.col("block"), F.explode(_unfolded("bits")).alias("place")).select(
        "query", *SCOPE, (F.col("block") * BLOCK + F.col("place")).alias("number")
    )


def runs(names: DataFrame, columns: Column) -> DataFrame:
    """``names`` in runs of 64 consecutive numbers of a scope, as array ``rows`` of ``columns``."""
    return names.groupBy(*SCOPE, F.floor(F.col("number") / WORD).alias("run")).agg(F.collect_list(columns).alias("rows"))


def candidate_runs(index: PieceIndex, queries: DataFrame, scoped: bool) -> DataFrame | None:
    """(query, SCOPE, run) of the runs that hold both ends of a query's name, by its rarer end.

    Names that postings answer are left out; None if that leaves none. Pieces are compared by hash and neighbours share most of them, so a run has few rows; the caller compares names.
    """
    meet = [*SCOPE, "piece"] if scoped else ["piece"]
    term = F.lower("name")
    lengths = ENDS if index.postings is not None else (*range(1, GRAM + 1), *ENDS)
    size = F.coalesce(*[F.when(F.length(term) >= s, F.lit(s)) for s in reversed(lengths)])
    sizes = [row[0] for row in queries.select(size.alias("size")).distinct().collect() if row[0]]
    if not sizes and index.postings is not None:
        return None
    ends = F.array_distinct(F.array(F.xxhash64(F.substr(term, F.lit(1), size)), F.xxhash64(F.right(term, size))))
    asked = queries.filter(F.length(term) >= lengths[0]).select(
        F.struct(*queries.columns).alias("query"), *meet[:-1], F.size(ends).alias("many"), F.explode(ends).alias("piece")
    )
    wanted = asked.select(*meet).distinct()
    # A simple name is mostly part of the qualified one, which then has all its pieces.
    text = F.when(F.contains(F.lower("qualified_name"), F.lower("name")), F.lower("qualified_name")).otherwise(haystack())

    def hashed(row: Column) -> Column:
        return F.flatten(F.array(*[F.transform(grams(row, s), lambda piece: F.xxhash64(piece)) for s in sorted(sizes or lengths[:1])]))

    pieces = F.array_distinct(F.flatten(F.transform(F.array_distinct("rows"), hashed)))
    held = staged(
        runs(index.names, text).select(*SCOPE, "run", F.explode(pieces).alias("piece")).join(wanted, meet, "left_semi")
    )
    frequency = held.groupBy(*meet).agg(F.count(F.lit(1)).alias("frequency"))
    rarer = (
        asked.join(frequency, meet)
        .groupBy("query", *meet[:-1], "many")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("frequency", "piece")).alias("end"))
        .filter(F.col("known") == F.col("many"))
    )
    hot = F.broadcast(frequency.filter(F.col("frequency") > HOT).select(*meet, F.lit(True).alias("hot")))
    parts = F.when(F.col("end.frequency") > HOT, F.lit(SPREAD - 1)).otherwise(F.lit(0))
    first = rarer.select("query", *meet[:-1], F.col("end.piece").alias("piece"), F.explode(F.sequence(F.lit(0), parts)).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod("run", F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    salted = held.join(hot, meet, "left").withColumn("salt", salt).drop("hot")
    return first.join(salted, [*meet, "salt"]).select("query", *SCOPE, "run")
