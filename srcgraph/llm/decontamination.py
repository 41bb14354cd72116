"""Benchmark decontamination as a prefix-filtered set join of documents with item windows.

1. Every item gives its windows of ``window`` words (a shorter item is one window); a window is the
   sequence of its shingles of ``shingle`` words, or one shingle where it is shorter.
2. Each document is read once. A bit table of the shingles of all windows, of bounded size, says which of
   its shingles may be of a window. A window occurs only inside a run of such shingles, so runs that
   are shorter than the shortest window (length bound) go; of the others the words are kept.
3. Shingles are counted over all runs. A window with a shingle that stands in no run occurs nowhere. The
   shingles of every other window are ordered by rarity; the whole window must be contained, so its
   necessary prefix is one shingle, the rarest: n - ceil(1.0 n) + 1.
4. The prefix shingles are joined with the shingles of the runs. The place of the shingle in the window
   gives the only place where the window can start (positional bound: inside the run, all of its words).
5. The words of that place, as many as the window has, are compared with those of the window.

The bit table only saves rows: where it fills up, more runs pass to the join, and the result is the
same. Joins are left to Spark, which broadcasts a side by the size of its written table or sorts both
and splits a shingle that holds many rows.

Defined results: a null text has no words; an item without words has no window; rows of one item_id are
one item, a null item_id hits words but is not listed; repeated documents, and rows of a null doc_id, are
answered each; without items nothing is hit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm.common import staged, table

WINDOW, SHINGLE = 10, 5
#: Bytes of text that are cut to words at once, and of documents whose shingles are looked up at once.
PIECE_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
#: Bits of the table per shingle, and the most bits it may have (8 MB).
BITS_PER_SHINGLE, MOST_BITS = 64, 26

_PRIMES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(_PRIMES[3])
    return values ^ (values >> np.uint64(29))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case, a space where it is in no word; and a random number for each of them."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ascii_word = [*range(48, 58), *range(65, 91), *range(97, 123)]
    out = np.setdiff1d(np.arange(128), ascii_word)
    lower[out] = 32
    number = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_PRIMES[0]))
    number[32] = 0
    return lower, number


_LOWER, _NUMBER = _byte_tables()
_POWERS = np.array([pow(_PRIMES[1], k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


@dataclass
class _Words:
    """Words of neighbouring texts: where they start and end in ``data``, of which text, and a number for each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    number: np.ndarray

    def between(self, first: int, last: int) -> str:
        """Words ``first`` to ``last``, with one space between them."""
        return b" ".join(self.data[self.start[first] : self.end[last]].tobytes().split()).decode("utf-8", "replace")


def cut_words(data: np.ndarray, offsets: np.ndarray) -> _Words:
    """Cut the texts, text k being ``data[offsets[k]:offsets[k + 1]]``, to words."""
    data = _LOWER[data]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets >= 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    # A word ends before the next one, less the bytes outside words between them.
    bound = np.append(start[1:], len(data))
    last = np.flatnonzero(inside & ~np.append(inside[1:] & ~first[1:], False))
    number = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(start, start[at] + PIECE_BYTES)), at + 1)
        lo, hi = int(start[at]), int(bound[to - 1])
        place = np.arange(lo, hi) - np.repeat(start[at:to], bound[at:to] - start[at:to])
        values = _NUMBER[data[lo:hi]] * _POWERS[place & 63]
        number[at:to] = np.add.reduceat(values, start[at:to] - lo)
        at = to
    text = np.searchsorted(offsets, start, side="right") - 1
    return _Words(data, start, last + 1, text, number)


def shingle_numbers(words: _Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the ``size`` words from each place on, and whether they stand in one text."""
    count = max(len(words.number) - size + 1, 0)
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = _mixed(out + words.number[k : k + count])
    return out, words.text[:count] == words.text[size - 1 : size - 1 + count]


def _slots(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return numbers >> shift, (numbers * np.uint64(_PRIMES[2])) >> shift


class _Bits:
    """A bit table of shingle numbers with two bits each."""

    def __init__(self, bits: int, words: bytes):
        self.bits, self.words = bits, np.frombuffer(words, np.uint64)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        found = np.ones(len(numbers), bool)
        for slot in _slots(numbers, self.bits):
            found &= (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return found


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, _Words]]:
    """Texts ``first`` to ``to`` - 1 and their words, a few megabytes at a time."""
    data, offsets = _buffers(texts)
    first = 0
    while first < len(texts):
        to = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, side="right")) - 1
        to = min(max(to, first + 1), len(texts))
        yield first, to, cut_words(data[offsets[first] : offsets[to]], offsets[first : to + 1] - offsets[first])
        first = to


_SHINGLES = "item_id string, window string, n_words int, size int, offset int, shingle string, number long"


def item_shingles(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Per window of an item (item_id, text), one row per shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, _, words in _groups(batch.column(1)):
                rows: list[list] = [[] for _ in range(7)]
                edges = np.flatnonzero(np.diff(words.text, prepend=-1, append=-1))
                numbers = {k: shingle_numbers(words, k)[0] for k in range(1, shingle + 1)}
                for lo, hi in zip(edges[:-1], edges[1:]):
                    long = min(window, int(hi - lo))
                    size = min(shingle, long)
                    pieces = words.between(lo, hi - 1).split(" ")
                    for at in range(int(hi - lo) - long + 1):
                        for k in range(long - size + 1):
                            part = pieces[at + k : at + k + size]
                            number = int(numbers[size][lo + at + k].astype(np.int64))
                            row = names[first + int(words.text[lo])], " ".join(pieces[at : at + long]), long, size, k, " ".join(part), number
                            for column, value in zip(rows, row):
                                column.append(value)
                    if len(rows[0]) > 20_000:
                        yield _shingle_batch(rows)
                        rows = [[] for _ in range(7)]
                yield _shingle_batch(rows)

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, _SHINGLES)


def _shingle_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    names = ["item_id", "window", "n_words", "size", "offset", "shingle", "number"]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)


def bit_table(numbers: DataFrame, count: int) -> tuple[int, bytes]:
    """Bits of the distinct ``numbers``, put together as 64-bit words; at most 2^(MOST_BITS - 6) rows come to the driver."""
    bits = int(min(max((max(count, 1) * BITS_PER_SHINGLE - 1).bit_length(), 10), MOST_BITS))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array(batch.column(0)).astype(np.int64).view(np.uint64)
            slot = np.unique(np.concatenate(_slots(number, bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))],
                names=["word", "bit"],
            )

    rows = numbers.mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return bits, words.tobytes()


_RUNS = "doc_id long, n_words long, runs array<struct<size:int,start:int,words:string>>"


def runs(docs: DataFrame, bits: int, words_broadcast, least: dict[int, int]) -> DataFrame:
    """Per document (doc_id, text): its number of words and its runs of shingles that may be of a window.

    ``least`` gives for each shingle size the words of the shortest window that has such shingles.
    """

    def found(words: _Words, many: int, known: _Bits) -> list[list]:
        out: list[list] = [[] for _ in range(many)]
        begin = np.searchsorted(words.text, np.arange(many))
        for size, shortest in least.items():
            number, valid = shingle_numbers(words, size)
            mark = valid & known.has(number)
            if not mark.any():
                continue
            joined = mark[1:] & mark[:-1] & (words.text[1 : len(mark)] == words.text[: len(mark) - 1])
            head = np.flatnonzero(mark & ~np.insert(joined, 0, False))
            tail = np.flatnonzero(mark & ~np.append(joined, False))
            for lo, hi in zip(head, tail):
                if hi - lo + size >= shortest:
                    text = int(words.text[lo])
                    out[text].append((size, int(lo - begin[text]), words.between(lo, hi + size - 1)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Bits(bits, words_broadcast.value)
        kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("words", pa.string())]))
        for batch in batches:
            for first, to, words in _groups(batch.column(1)):
                spans = found(words, to - first, known) if least else [[] for _ in range(to - first)]
                rows = [[dict(zip(("size", "start", "words"), s)) for s in doc] for doc in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, to - first), pa.array(np.bincount(words.text, minlength=to - first), pa.int64()), pa.array(rows, kind)],
                    names=["doc_id", "n_words", "runs"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _RUNS)


def _covered(spans: Column) -> Column:
    """Words in the union of ``spans``, an array of (start, end) in order."""
    step = lambda seen, span: F.struct(
        F.greatest(seen["to"], span["end"]).alias("to"),
        (seen["words"] + F.greatest(span["end"] - F.greatest(seen["to"], span["start"]), F.lit(0))).alias("words"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("words")), step, lambda seen: seen["words"].cast("long"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every place where a window of an item stands in a document.

    Three tables: documents (row, doc_id, n_words), a row per row of ``docs`` (doc_id, text); places (row, start, n_words,
    window), counted from 0; and windows (window, item_id).
    """
    spark = docs.sparkSession
    shingles = staged(item_shingles(items, window, shingle))
    sizes = {r["size"]: r["least"] for r in shingles.groupBy("size").agg(F.min("n_words").alias("least")).collect()}
    numbers = shingles.select("number").distinct()
    bits, words = bit_table(numbers, shingles.select(F.approx_count_distinct("number")).first()[0])
    found = staged(runs(docs, bits, spark.sparkContext.broadcast(words), sizes).select(F.monotonically_increasing_id().alias("row"), "*"))

    spans = found.select("row", F.explode("runs").alias("run")).select("row", "run.size", "run.start", F.split("run.words", " ").alias("words"))
    # The words around a shingle that a window with it can hold: at most window - size before and after.
    near = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("size")),
        lambda at: F.struct(
            at.alias("at"),
            F.array_join(F.slice("words", at + 1, F.col("size")), " ").alias("shingle"),
            F.least(at, F.lit(window) - F.col("size")).alias("before"),
            F.slice("words", at + 1 - F.least(at, F.lit(window) - F.col("size")), F.least(at, F.lit(window) - F.col("size")) + window).alias("near"),
        ),
    )
    posted = spans.select("row", "size", "start", F.explode(near).alias("s")).select(
        "row", "size", (F.col("start") + F.col("s.at")).alias("at"), "s.shingle", "s.before", "s.near"
    )
    windows = shingles.select("window", "n_words", "size", "offset", "shingle").distinct()
    rarity = posted.groupBy("size", "shingle").agg(F.count("*").alias("count"))
    ordered = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset"))
    prefix = (
        windows.join(rarity, ["size", "shingle"], "left")
        .groupBy("window", "n_words", "size")
        .agg(ordered.alias("rarest"))
        .filter("rarest.count > 0")
        .select("window", F.col("n_words").alias("long"), "size", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    )
    inside = (F.col("offset") <= F.col("before")) & (F.col("before") - F.col("offset") + F.col("long") <= F.size("near"))
    places = (
        posted.join(staged(prefix), ["size", "shingle"])
        .filter(inside)
        .filter(F.array_join(F.slice("near", F.col("before") - F.col("offset") + 1, F.col("long")), " ") == F.col("window"))
        .select("row", (F.col("at") - F.col("offset")).alias("start"), F.col("long").alias("n_words"), "window")
    )
    return found.select("row", "doc_id", "n_words"), places, shingles.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, ``spans`` (start and end of each place of a window, in words), ``item_ids`` (sorted strings), n_hit."""
    documents, places, windows = occurrences(docs, items, window, shingle)
    places = staged(places)
    spans = (
        places.groupBy("row", "start")
        .agg(F.max(F.col("start") + F.col("n_words")).alias("end"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    named = (
        places.select("row", "window").distinct().join(windows, "window")
        .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        documents.join(spans.join(named, "row"), "row", "left")
        .withColumn("spans", F.coalesce("spans", none))
        .select("doc_id", "n_words", "spans", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), _covered(F.col("spans")).alias("n_hit"))
    )


def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS words FROM benchmark),
longs AS (SELECT item_id, words, least(len(words), {WINDOW}) AS n FROM i WHERE len(words) > 0),
at_item AS (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM longs),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM at_item),
sizes AS (SELECT DISTINCT n FROM windows),
at_doc AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, sizes WHERE len(words) >= n),
doc_windows AS (SELECT r, n, s, array_to_string(words[s:s + n - 1], ' ') AS w FROM at_doc),
hits AS (SELECT r, s, n, item_id FROM doc_windows JOIN windows USING (n, w)),
hit_words AS (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hits),
n_hits AS (SELECT r, count(*) AS n_hit FROM hit_words GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) AS x GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits USING (r) LEFT JOIN ids USING (r)
"""
