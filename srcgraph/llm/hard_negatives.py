"""Hard-negative mining over an inverted multi-index.

1. Vectors are cut in two halves. A codebook per half is fitted on a bounded sample (``SAMPLE`` rows); the
   pair of nearest codewords of a vector is its cell. Every row is indexed. A cell of more than ``BLOCK``
   rows is dealt to several blocks.
2. The score of an anchor with any row of a half-cell is at most anchor half x codeword + norm of the anchor
   half x radius of the codeword (its farthest row). A heap visits cells in falling order of the sum of
   both half bounds (multi-sequence order). Bounds carry a slack for rounding, so they never fall short.
3. Positives first: each round an anchor visits its next cells, up to a quota of rows that grows from
   round to round, and meets their blocks in one cogroup. Its best rows so far give a floor: a row
   below its last wanted score cannot matter. It stops when the next cell's bound is below the floor.
4. Then negatives in the same way. The scores of the positives fix a window of allowed scores for each of
   them; a window is certified when no cell left could hold a better row for it, which the floor, the
   least over all windows, says.

All results are exact; the index only saves work where bounds are tight. Where they are not (directions
without any structure), every cell is visited.

What the driver and every task hold: 2 x 256 codewords with radii and at most 65,536 cell sizes. Rows,
anchors, visits and results stay in tables; a task sees one block and at most ``ANCHORS`` anchors.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a
shorter vector counts as if zeros followed; repeated rows are rows of their own, and a repeated anchor is
answered each time; a null id comes after all others; scores are exact as long as they fit 64 bits; fewer
rows than wanted give fewer results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import staged, table

#: Rows drawn for the codebooks, most codewords of a half, rows of a block, anchors a task sees at once.
SAMPLE, CODEWORDS, BLOCK, ANCHORS = 8_192, 256, 2_048, 100_000
#: Rows an anchor may visit in its first round, and how much more in each round after it.
FIRST, MORE = 16_384, 16
#: Anchors scored in one product.
TOGETHER = 256
LAST_ID = (1 << 63) - 1


@dataclass
class MultiIndex:
    """Two codebooks with radii (0 below a codeword without rows: minus infinity), rows per cell, and the indexed rows."""

    dim: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    rows: DataFrame

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.dim // 2], x[..., self.dim // 2 :]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, as int64, with zeros after the shorter ones."""
    length = np.array(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < length[:, None]] = np.array(column.flatten(), dtype=np.int64)
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    small = (x >= -(1 << 15)).all(axis=1) & (x < 1 << 15).all(axis=1)
    return [row.astype("<i2").tobytes() if short else row.astype("<i8").tobytes() for row, short in zip(x, small)]


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8") for r in rows], np.int64).reshape(-1, dim)


def codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of ``x``; as many as wanted, or as there are different rows."""
    start = np.unique(x, axis=0)
    words = start[np.random.default_rng(0).permutation(len(start))[:size]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, words)
        filled = np.unique(near)
        for k in filled:
            words[k] = x[near == k].mean(axis=0)
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    norms = (words * words).sum(axis=1)
    for at in range(0, len(x), 4_096):
        out[at : at + 4_096] = np.argmin(norms[None, :] - 2 * (x[at : at + 4_096] @ words.T), axis=1)
    return out


def build(vectors: DataFrame, anchor: Column) -> MultiIndex | None:
    """Index ``vectors`` (id long, label, vec array<long>); ``anchor`` says which rows are anchors. None without rows."""
    many, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not many:
        return None
    dim = max(dim, 2)
    drawn = vectors.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(many)) < SAMPLE).select("vec").limit(2 * SAMPLE).toArrow()
    sample = _matrix(drawn.column(0).combine_chunks(), dim) if drawn.num_rows else np.zeros((1, dim), np.int64)
    sample = np.unique(sample, axis=0).astype(np.float64)
    size = int(min(max(np.ceil(np.sqrt(4 * many / BLOCK)), 2), CODEWORDS))
    words = codebook(sample[:, : dim // 2], size), codebook(sample[:, dim // 2 :], size)
    second = len(words[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), dim)
            parts = x[:, : dim // 2].astype(np.float64), x[:, dim // 2 :].astype(np.float64)
            near = [_nearest(p, w) for p, w in zip(parts, words)]
            far = [np.sqrt(((p - w[n]) ** 2).sum(axis=1)) for p, w, n in zip(parts, words, near)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array((near[0] * second + near[1]).astype(np.int32)), *map(pa.array, far), pa.array(_packed(x), pa.binary())],
                names=["id", "label", "anchor", "cell", "far_1", "far_2", "vec"],
            )

    named = vectors.select(F.coalesce("id", F.lit(LAST_ID)).alias("id"), F.col("label").cast("long"), anchor.alias("anchor"), F.col("vec").cast("array<long>"))
    indexed = named.mapInArrow(assign, "id long, label long, anchor boolean, cell int, far_1 double, far_2 double, vec binary")
    indexed = staged(indexed.withColumn("row", F.monotonically_increasing_id()))
    cells = indexed.groupBy("cell").agg(F.count("*").alias("count"), F.max("far_1").alias("far_1"), F.max("far_2").alias("far_2")).toPandas()
    counts = np.zeros(len(words[0]) * second, np.int64)
    counts[cells["cell"]] = cells["count"]
    radii = np.full(len(words[0]), -np.inf), np.full(second, -np.inf)
    np.maximum.at(radii[0], cells["cell"] // second, cells["far_1"])
    np.maximum.at(radii[1], cells["cell"] % second, cells["far_2"])
    return MultiIndex(dim, words, radii, counts, indexed)


def _half_bounds(q: np.ndarray, words: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used codewords in falling order of the most any of their rows can score with ``q``, and these bounds."""
    q = q.astype(np.float64)
    norm = np.sqrt(q @ q)
    size = np.sqrt((words * words).sum(axis=1))
    used = np.flatnonzero(radii > -np.inf)
    bound = (words @ q + norm * np.maximum(radii, 0))[used]
    bound += 1e-9 * norm * (size + np.maximum(radii, 0))[used] + 1e-6
    order = np.argsort(-bound, kind="stable")
    return used[order], bound[order]


def cells_in_order(q: tuple[np.ndarray, np.ndarray], words: tuple, radii: tuple, counts: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) of every cell that has rows, in falling order of bound."""
    (one, first), (two, second) = (_half_bounds(q[k], words[k], radii[k]) for k in (0, 1))
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        # A row of the grid of pairs enters when the one before it has given its first pair.
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
        if j + 1 < len(two):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        cell = int(one[i]) * len(words[1]) + int(two[j])
        if counts[cell]:
            yield -bound, cell


_ANCHOR = "row long, label long, vec binary, seen int, floor long, lows array<long>, highs array<long>"


def _visits(index: MultiIndex, state: DataFrame, quota: int) -> DataFrame:
    """``state`` with the blocks (cell, part) each anchor visits next and the cells it has seen after that."""
    held = state.sparkSession.sparkContext.broadcast((index.words, index.radii, index.counts))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, radii, counts = held.value
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())]))
        for batch in batches:
            x = _unpacked(batch.column(2), dim)
            seen, floors = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            blocks, after = [], []
            for q, done, floor in zip(x, seen, floors):
                mine, rows, at = [], 0, 0
                for bound, cell in cells_in_order((q[: dim // 2], q[dim // 2 :]), words, radii, counts):
                    if rows >= quota or (floor is not None and bound < floor):
                        break
                    at += 1
                    if at > done:
                        rows += int(counts[cell])
                        mine += [{"cell": cell, "part": p} for p in range(-(-int(counts[cell]) // BLOCK))]
                blocks.append(mine)
                after.append(max(at, done))
            columns = [*(batch.column(k) for k in range(3)), pa.array(after, pa.int32()), *(batch.column(k) for k in range(4, 7)), pa.array(blocks, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "blocks"])

    return state.mapInArrow(run, f"{_ANCHOR}, blocks array<struct<cell:int,part:int>>")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as exact integers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(x.shape[1], 1)
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, among: np.ndarray, wanted: int) -> np.ndarray:
    """The best of the places ``among``: higher scores first, then smaller ids."""
    if len(among) > wanted:
        least = np.partition(score[among], len(among) - wanted)[len(among) - wanted]
        among = among[score[among] >= least]
    return among[np.lexsort((rows[among], ids[among], -score[among]))][:wanted]


_FOUND = "row long, slot int, score long, id long, other long"


def _meet(index: MultiIndex, visits: DataFrame, negatives: bool, wanted: int, batches: int) -> DataFrame:
    """What anchors find in the blocks they visit: at most ``wanted`` rows per anchor, block and window."""
    dim = index.dim

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        ids, rows, labels = (np.array(right.column(c)) for c in ("id", "row", "label"))
        if left.num_rows and right.num_rows:
            x = _unpacked(right.column("vec"), dim)
            label_of = np.array(left.column("label"))
            order = np.argsort(label_of, kind="stable")
            left, label_of = left.take(pa.array(order)), label_of[order]
            q, anchor = _unpacked(left.column("vec"), dim), np.array(left.column("row"))
            floors, lows, highs = (left.column(c).to_pylist() for c in ("floor", "lows", "highs"))
            edges = np.flatnonzero(np.diff(label_of, prepend=label_of[0] - 1, append=label_of[-1] + 1))
            for lo, hi in zip(edges[:-1], edges[1:]):
                mine = np.flatnonzero((labels != label_of[lo]) if negatives else (labels == label_of[lo]))
                for at in range(lo, hi, TOGETHER):
                    scores = _scores(q[at : min(at + TOGETHER, hi)], x[mine])
                    for k, score in enumerate(scores, at):
                        floor = floors[k]
                        some = np.flatnonzero(score >= floor) if floor is not None else np.arange(len(score))
                        if negatives:
                            for slot, (low, high) in enumerate(zip(lows[k], highs[k])):
                                among = some[(score[some] >= low) & (score[some] <= high)]
                                best = _first(score, ids[mine], rows[mine], among, wanted)
                                _add(out, anchor[k], slot, score, ids[mine], rows[mine], best)
                        else:
                            some = some[rows[mine][some] != anchor[k]]
                            best = _first(score, ids[mine], rows[mine], some, wanted)
                            _add(out, anchor[k], 0, score, ids[mine], rows[mine], best)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        columns[1] = columns[1].astype(np.int32)
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["row", "slot", "score", "id", "other"])

    spread = lambda part: F.pmod(F.xxhash64("row"), part)
    visiting = visits.select("*", F.explode("blocks").alias("b")).select("row", "label", "vec", "floor", "lows", "highs", "b.cell", "b.part")
    visiting = visiting.withColumn("batch", spread(F.lit(batches)))
    parts = index.rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    wanted_blocks = visiting.select("cell", "part").distinct()
    rows = index.rows.select("id", "row", "label", "vec", "cell").join(F.broadcast(parts), "cell").withColumn("part", spread(F.col("parts")).cast("int"))
    rows = rows.join(wanted_blocks, ["cell", "part"], "left_semi").select("id", "row", "label", "vec", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))
    keys = ["cell", "part", "batch"]
    return visiting.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, _FOUND)


def _add(out: list[list], anchor: int, slot: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: np.ndarray) -> None:
    if len(best):
        for column, values in zip(out, (np.full(len(best), anchor), np.full(len(best), slot), score[best], ids[best], rows[best])):
            column.append(values)


def _search(index: MultiIndex, anchors: DataFrame, negatives: bool, wanted: int, batches: int) -> DataFrame:
    """The ``wanted`` best rows per anchor and window (row, slot, rank, score, id, other); exact when it returns.

    ``anchors`` has a row per anchor, with lows and highs, the windows of allowed scores, for negatives.
    """
    best = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id", "other")
    state, found, quota = anchors, None, FIRST
    while True:
        visits = staged(_visits(index, state, quota))
        if visits.filter(F.size("blocks") > 0).isEmpty():
            return found
        more = _meet(index, visits, negatives, wanted, batches)
        every = more if found is None else more.unionByName(found.select(*more.columns))
        found = staged(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted))
        # Below the last wanted score of a window, or below the window, no row matters for it.
        full = found.filter(F.col("rank") == wanted).select("row", "slot", F.col("score").alias("last"))
        if negatives:
            windows = visits.select("row", F.posexplode("lows").alias("slot", "low"), "highs").filter(F.col("low") <= F.element_at("highs", F.col("slot") + 1))
            floors = windows.join(full, ["row", "slot"], "left").groupBy("row").agg(F.min(F.coalesce("last", "low")).alias("floor"))
        else:
            floors = full.select("row", F.col("last").alias("floor"))
        state = visits.drop("floor", "blocks").join(floors, "row", "left").select("row", "label", "vec", "seen", "floor", "lows", "highs")
        quota *= MORE


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has id, label and vec (array of integers, without nulls). For each row that ``anchor`` marks, its
    ``positives`` best rows of the same label; for each of them, the ``negatives`` best rows of another label
    with ``least`` * positive score <= 100 * negative score <= ``most`` * positive score.
    """
    spark = vectors.sparkSession
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(vectors, anchor)
    if index is None:
        return spark.createDataFrame([], kinds)
    marked = index.rows.filter("anchor")
    many = marked.count()
    if not many:
        return spark.createDataFrame([], kinds)
    batches = -(-many // ANCHORS)
    none = F.lit(None).cast("array<long>")
    first = marked.select("row", "label", "vec", F.lit(0).alias("seen"), F.lit(None).cast("long").alias("floor"), none.alias("lows"), none.alias("highs"))
    near = _search(index, first, False, positives, batches)
    positive = near.select("row", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    windows = near.groupBy("row").agg(scores.alias("scores"))
    low = lambda s: F.ceil(s * least / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = lambda s: F.floor(s * most / F.lit(100).cast("decimal(3,0)")).cast("long")
    lows, highs = F.transform("scores", lambda s: low(s.cast("decimal(19,0)"))), F.transform("scores", lambda s: high(s.cast("decimal(19,0)")))
    # The least lower end of a window that is not empty; an anchor without one visits nothing.
    open_ends = F.filter(F.zip_with(lows, highs, lambda a, b: F.when(a <= b, a)), lambda a: a.isNotNull())
    second = (
        marked.join(windows, "row")
        .select("row", "label", "vec", F.lit(0).alias("seen"), F.array_min(open_ends).alias("floor"), lows.alias("lows"), highs.alias("highs"))
        .filter(F.col("floor").isNotNull())
    )
    hard = _search(index, second, True, negatives, batches)
    if hard is None:
        return spark.createDataFrame([], kinds)
    real = lambda name: F.when(F.col(name) != LAST_ID, F.col(name))
    return (
        hard.select("row", "slot", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
        .join(positive, ["row", "slot"])
        .join(marked.select("row", F.col("id").alias("anchor_id")), "row")
        .select(real("anchor_id").alias("anchor_id"), real("positive_id").alias("positive_id"), F.col("rank").cast("int"), real("negative_id").alias("negative_id"), "positive_score", "negative_score")
    )


def op12(spark: SparkSession, folder: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    vectors = table(spark, folder, "embeddings").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), steps.alias("vec"))
    return hard_negatives(rows, F.coalesce(F.col("id") % 100 == 0, F.lit(False)))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b) AS k
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5
"""
