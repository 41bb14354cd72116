"""Stupid-backoff language-model scores, computed from the corpus that is scored.

Each task turns batches of documents into sorted distinct n-grams of order 1 to ``ORDER`` with their
counts in the batch, cut by hash range. The n-gram count tables are partitioned by that hash: one
group per order and range adds up the counts of all batches and answers every batch with the corpus
counts of its n-grams, in their order. A second scan sends each batch's words to its counts; there the
n-grams, exploded to positions, are joined to them and their logarithms summed per document.

Counts are left-one-out: a document's own occurrences do not count for it. With c the counts of the
others, a word w after (u, v) scores c(uvw) / c(uv) if c(uvw) > 0, else 0.4 times c(vw) / c(v) if
c(vw) > 0, else 0.4 times c(w) / N; a word no other document has counts half. A word with a shorter
history in its document starts at that order.

Defined results: null, empty and word-less texts have no words, score 0 and a null mean; repeated rows
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import shuffle_partitions, table, word_count

ORDER = 3
BACKOFF = 0.4
BATCH_DOCS, BATCH_WORDS = 20_000, 2_000_000  # fewer, larger batches send an n-gram less often
BLOCK_WORDS = 4_000_000

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ROWS = "block long, batch long, a binary, b binary, c binary, ids array<long>"
SCORES = "doc_id long, n_words long, log_score double, found_longest long, unseen_words long"


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, bytes of equal rank together: compression finds runs and frequent values there."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :size].T.tobytes())


def _unplanes(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.reshape(-1).view("<u8")


def _keys(sorted_keys: np.ndarray, size: int) -> bytes:
    """Sorted keys as steps from one to the next, which need about as many bits less as there are keys in powers of two."""
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)), size)


def _unkeys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unplanes(data, size), dtype=np.uint64)


def key_bytes(blocks: int) -> int:
    """Bytes for the bits of a 64-bit hash below those that give its block: two n-grams are one only if their whole hashes are."""
    return (64 - (blocks.bit_length() - 1) + 7) // 8


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "batch", "a", "b", "c", "ids"])


def _ngrams(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where an n-gram of one document ends, and the hashes of these n-grams."""
    ends = np.arange(order - 1, len(words))
    ends = ends[doc[ends] == doc[ends - order + 1]] if len(ends) else ends
    h = np.full(len(ends), order, dtype=np.uint64)
    for k in range(order):
        h = (h ^ words[ends - order + 1 + k]) * _MIX[k % 3]
        h ^= h >> np.uint64(31)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return ends, h


def packed(docs: DataFrame, order: int, blocks: int, texts: bool) -> DataFrame:
    """Rows per order, hash range and batch: ``a`` n-gram keys, ``b`` counts. With ``texts`` instead one
    row per batch: ``a`` words as places in the hashes ``b``, ``c`` words per id of ``ids``.

    Both read the same splits in the same order, so their batches are the same.
    """
    bits = np.uint64(blocks.bit_length() - 1)

    def pack(batch: int, vocabulary: dict[bytes, int], words: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        places = np.concatenate(words) if words else np.zeros(0, np.int64)
        if texts:
            # Frequent words get small places, whose upper bytes compress away.
            often = np.argsort(-np.bincount(places, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            yield _record([(-1, batch, _planes(rank[places], 4), hashes[often].tobytes(), sizes.astype("<u4").tobytes(), ids)])
            return
        rows = []
        text, doc = hashes[places], np.repeat(np.arange(len(sizes)), sizes)
        for k in range(1, order + 1):
            keys, counts = np.unique(_ngrams(text, doc, k)[1], return_counts=True)
            edges = np.searchsorted(keys >> (np.uint64(64) - bits), np.arange(blocks + 1, dtype=np.uint64))
            rest = keys & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))
            for b in np.flatnonzero(np.diff(edges)):
                at = slice(edges[b], edges[b + 1])
                rows.append(((k - 1) * blocks + int(b), batch, _keys(rest[at], key_bytes(blocks)), _planes(counts[at], 4), None, None))
                if len(rows) >= 256:
                    yield _record(rows)
                    rows = []
        if rows:
            yield _record(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held = 0, 0
        vocabulary: dict[bytes, int] = {}
        words: list[np.ndarray] = []
        ids: list[int] = []
        for record in batches:
            if batch == 0 and record.num_rows:
                batch = (record.column(2)[0].as_py() + 1) << 24
            for at in range(0, record.num_rows, 256):
                piece = record.slice(at, 256)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found = (text or "").encode("utf-8", "surrogatepass").split()
                    place = vocabulary.setdefault
                    words.append(np.array([place(w, len(vocabulary)) for w in found], dtype=np.int64))
                    ids.append(doc)
                    held += len(found)
                    if held >= BATCH_WORDS or len(ids) >= BATCH_DOCS:
                        yield from pack(batch, vocabulary, words, ids)
                        batch, held, vocabulary, words, ids = batch + 1, 0, {}, [], []
        if ids:
            yield from pack(batch, vocabulary, words, ids)

    # The partition of the scan, which stays the same wherever the plan is used.
    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, _ROWS)


def counted(rows: DataFrame, blocks: int) -> DataFrame:
    """The same rows with the corpus counts in ``b`` and without keys."""
    size = key_bytes(blocks)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys = [_unkeys(x, size) for x in rows.column("a").to_pylist()]
        counts = np.concatenate([_unplanes(x, 4) for x in rows.column("b").to_pylist()])
        names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(names), dtype=np.uint64)
        np.add.at(total, inverse, counts)
        answers = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
        batches = rows.column("batch").to_pylist()
        return pa.Table.from_batches([_record([(block, batch, None, _planes(a, 8), None, None) for batch, a in zip(batches, answers)])])

    return rows.groupBy("block").applyInArrow(run, _ROWS)


def _batch_scores(places, hashes, sizes, counts: list[np.ndarray], total: int, order: int):
    """Per document: sum of log scores, words found at the longest order, words no other document has."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    words = hashes[places]
    n = len(words)
    # others[k]: occurrences in other documents of the (k+1)-gram that ends at each position.
    others = []
    for k in range(1, order + 1):
        ends, h = _ngrams(words, doc, k)
        names, inverse = np.unique(h, return_inverse=True)
        if len(names) != len(counts[k - 1]):
            raise RuntimeError("the two scans of the documents gave different batches")
        _, pair, own = np.unique(doc[ends] * (len(counts[k - 1]) + 1) + inverse, return_inverse=True, return_counts=True)
        left = np.zeros(n, dtype=np.float64)
        left[ends] = counts[k - 1][inverse].astype(np.float64) - own[pair]
        others.append(left)
    first = np.cumsum(sizes) - sizes
    history = np.minimum(np.arange(n) - first[doc], order - 1)
    rest = np.maximum(total - sizes[doc], 1)
    log = np.log(np.maximum(others[0], 0.5) / rest)
    level = np.zeros(n, dtype=np.int64)
    for k in range(1, order):
        (at,) = np.nonzero((history >= k) & (others[k] > 0))
        log[at] = np.log(others[k][at] / others[k - 1][at - 1])
        level[at] = k
    log += np.log(BACKOFF) * (history - level)
    longest = (level == order - 1).astype(np.int64)
    unseen = (others[0] <= 0).astype(np.int64)
    sums = lambda x: np.bincount(doc, weights=x, minlength=len(sizes)).astype(np.float64)
    return sums(log), sums(longest).astype(np.int64), sums(unseen).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row of ``SCORES`` per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(word_count("text"))).first()[0] or 0
    wanted = max(2 * shuffle_partitions(spark), total // BLOCK_WORDS, 2)
    blocks = 1 << (wanted - 1).bit_length()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = np.array(rows.column("block").to_pylist())
        a, b, c = (rows.column(x).to_pylist() for x in "abc")
        (head,) = np.flatnonzero(block < 0)
        places = _unplanes(a[head], 4).astype(np.int64)
        hashes, sizes = np.frombuffer(b[head], "<u8"), np.frombuffer(c[head], "<u4").astype(np.int64)
        ids = rows.column("ids")[int(head)].as_py()
        counts = []
        for k in range(order):
            parts = [i for i in np.argsort(block, kind="stable") if k * blocks <= block[i] < (k + 1) * blocks]
            counts.append(np.concatenate([_unplanes(b[i], 8) for i in parts] or [np.zeros(0, "<u8")]))
        log, longest, unseen = _batch_scores(places, hashes, sizes, counts, total, order)
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(log), pa.array(longest), pa.array(unseen)],
            names=["doc_id", "n_words", "log_score", "found_longest", "unseen_words"],
        )

    counts = counted(packed(docs, order, blocks, texts=False), blocks)
    return counts.unionByName(packed(docs, order, blocks, texts=True)).groupBy("batch").applyInArrow(run, SCORES)


def op2(spark, folder: str) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scores(table(spark, folder, "documents")).select("doc_id", "n_words", mean.alias("mean_log_score"), "found_longest", "unseen_words")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
t AS (
  SELECT doc_id, i, words[i] AS w1, CASE WHEN i > 1 THEN [words[i-1], words[i]] END AS w2,
    CASE WHEN i > 2 THEN [words[i-2], words[i-1], words[i]] END AS w3, least(i - 1, 2) AS history
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY doc_id, w1) AS c1,
    count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY doc_id, w2) AS c2,
    count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
  FROM t),
p AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM c),
s AS (
  SELECT doc_id, history = 2 AND c3 > 0 AS longest, c1 <= 0 AS unseen,
    CASE WHEN history = 2 AND c3 > 0 THEN ln(c3 / p2)
      WHEN history >= 1 AND c2 > 0 THEN ln(c2 / p1) + (history - 1) * ln(0.4)
      ELSE ln(greatest(c1, 0.5) / greatest(rest, 1)) + history * ln(0.4) END AS score
  FROM p)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(g.total / nullif(len(words), 0), 6) AS mean_log_score,
  CAST(coalesce(g.longest, 0) AS BIGINT) AS found_longest, CAST(coalesce(g.unseen, 0) AS BIGINT) AS unseen_words
FROM w LEFT JOIN (
  SELECT doc_id, sum(score) AS total, count(*) FILTER (longest) AS longest, count(*) FILTER (unseen) AS unseen FROM s GROUP BY doc_id) g USING (doc_id)
"""
