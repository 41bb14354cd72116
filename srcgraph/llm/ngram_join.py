"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

1. Each task turns batches of documents into blocks of the incidence matrix: for every range of n-gram
   hashes one packed row of (hash, document of the batch). Equal sets of a batch are one row of it.
2. A column block (a hash range) counts in how many rows each n-gram stands and sends back only
   n-grams of two rows or more; all others cannot overlap.
3. A row block (a batch) orders each set by (count, hash). Two sets of similarity t share an n-gram
   among the first n - ceil(t n) + 1 of each, or they are below the bound. Most sets have more n-grams
   of their own than that and are out.
4. Sets that share such an n-gram meet: lists of few sets pair up, within the size bound, and each
   distinct pair's overlap is counted once. Sets that meet in long lists (hot groups) are joined to
   clusters; a cluster, sorted by size, is cut into blocks, and each pair of blocks within the size
   bound is one product of two small incidence matrices, giving only links that span what it found.
5. Connected components over the links, on classes of equal sets.

No stage emits the pairs of a hot group, holds one, or sends its documents anywhere but in blocks.

Defined results: null and word-less texts have no n-grams and link with nothing; a text with fewer
words than n has its whole sequence as its one n-gram; equal texts, and repeated rows, are one class;
a null doc_id takes part, and its component is the least id it reaches, null if there is none; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import fresh, release, shuffle_partitions, staged, table
from srcgraph.llm.components import components
from srcgraph.session import ranked_within

MEMO = 300_000
BATCH_DOCS, BATCH_GRAMS = 8_192, 1_000_000
BLOCK_CHARS = 4_000_000
LONG_LIST, TILE, COLUMNS = 64, 128, 8_192
KEY_BYTES = 6
#: Bits of a row number for the place in its file.
PLACE_BITS = 36

_M = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def text(self, text: str | None) -> np.ndarray:
        words, parts = (text or "").encode("utf-8", "surrogatepass").lower().split(), []
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            if len(self) + len(part) > MEMO:
                self.clear()
            parts.append(np.fromiter(map(self.__getitem__, part), dtype=np.uint64, count=len(part)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of a shorter sequence, its own."""
    if len(words) == 0:
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ words[k : len(words) - size + 1 + k]) * _M[k % 3]
        h ^= h >> np.uint64(29)
    h *= _M[3]
    h ^= h >> np.uint64(32)
    return np.unique(h)


_ROWS = "block long, batch long, a binary, b binary, c binary, ids array<long>"


def planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, bytes of equal rank together: compression finds runs there."""
    return values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :size].T.tobytes()


def unplanes(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.reshape(-1).view("<u8")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "batch", "a", "b", "c", "ids"])


def incidence(docs: DataFrame, n: int, blocks: int) -> DataFrame:
    """Packed blocks: ``a`` hashes (``KEY_BYTES`` below those of the block), ``b`` rows of the batch. One more row per batch, with a block of its
    own, holds its documents: ``a`` set keys, ``b`` set sizes, ``c`` the row of each id in ``ids``."""
    bits = np.uint64(max(1, (blocks - 1).bit_length()))

    def pack(batch: int, sets: dict, members: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        header = (
            blocks + batch % blocks, batch,
            b"".join(sets), np.array([len(s) for s in sets.values()], "<u4").tobytes(),
            np.array([k for _, k in members], "<u4").tobytes(), [i for i, _ in members],
        )
        rows.append(header)
        arrays = list(sets.values())
        every = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(arrays), dtype=np.uint16), [len(s) for s in arrays])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        edges = np.searchsorted(every >> (np.uint64(64) - bits), np.arange(2 ** int(bits) + 1, dtype=np.uint64))
        rest = (every << bits) >> np.uint64(64 - 8 * KEY_BYTES)
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            rows.append((int(k), batch, planes(rest[at], KEY_BYTES), planes(owner[at], 2), None, None))
            if len(rows) >= 256:
                yield _record(rows)
                rows = []
        if rows:
            yield _record(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, batch = _WordHashes(), TaskContext.get().partitionId() << 24
        sets: dict[bytes, np.ndarray] = {}
        place: dict[bytes, int] = {}
        members: list[tuple[int, int]] = []
        held = 0
        for record in batches:
            for at in range(0, record.num_rows, 256):
                piece = record.slice(at, 256)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found = grams(known.text(text), n)
                    key = xxhash.xxh3_128_digest(found.tobytes())
                    if key not in sets:
                        sets[key], place[key] = found, len(sets)
                        held += len(found)
                    members.append((doc, place[key]))
                    if held >= BATCH_GRAMS or len(members) >= BATCH_DOCS:
                        yield from pack(batch, sets, members)
                        batch, sets, place, members, held = batch + 1, {}, {}, [], 0
        if members:
            yield from pack(batch, sets, members)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def shared_grams(blocks: DataFrame, header_from: int) -> DataFrame:
    """Per column block and batch, the entries whose n-gram stands in two rows or more, with that count (``c``)."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= header_from:
            return rows
        batches = rows.column("batch").to_pylist()
        hashes = [unplanes(x, KEY_BYTES) for x in rows.column("a").to_pylist()]
        owners = [unplanes(x, 2) for x in rows.column("b").to_pylist()]
        sizes = [len(h) for h in hashes]
        every, owner = np.concatenate(hashes), np.concatenate(owners)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        df = count[inverse]
        some = df > 1
        every, owner, piece, df = every[some], owner[some], piece[some], df[some]
        edges = np.searchsorted(piece, np.arange(len(sizes) + 1))
        out = [
            (key[0].as_py(), batches[k], planes(every[at], KEY_BYTES), planes(owner[at], 2), planes(df[at], 4), None)
            for k in np.flatnonzero(np.diff(edges))
            for at in [slice(edges[k], edges[k + 1])]
        ]
        return pa.Table.from_batches([_record(out)])

    return blocks.groupBy("block").applyInArrow(run, _ROWS)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(percent/100 n) + 1."""
    return n - -(-percent * n // 100) + 1


_SETS = "set_key binary, n int, ids array<long>, head int, grams array<long>"


def sets_of_batches(parts: DataFrame, percent: int, header_from: int) -> DataFrame:
    """Per class of a batch: key, size, ids; if it can link, its shared n-grams, rarest first, of which the
    first ``head`` must meet those of a partner."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = np.array(rows.column("block").to_pylist())
        a, b, c = (rows.column(x).to_pylist() for x in "abc")
        (at,) = np.flatnonzero(block >= header_from)
        keys = [a[at][i : i + 16] for i in range(0, len(a[at]), 16)]
        n, place = np.frombuffer(b[at], "<u4").astype(np.int64), np.frombuffer(c[at], "<u4")
        ids = rows.column("ids")[int(at)].as_py()
        members: list[list] = [[] for _ in keys]
        for i, k in zip(ids, place):
            members[k].append(i)
        body = [i for i in range(len(block)) if i != at]
        join = lambda x, size: np.concatenate([unplanes(x[i], size) for i in body] or [np.zeros(0, np.uint64)])
        rest, owner, df = join(a, KEY_BYTES), join(b, 2), join(c, 4)
        # The block gives the first bits of a hash, so that equal n-grams are equal everywhere.
        of_block = np.repeat(block[body].astype(np.uint64), [len(a[i]) // KEY_BYTES for i in body])
        bits = np.uint64(header_from.bit_length() - 1)
        gram = (of_block << (np.uint64(64) - bits)) | ((rest << np.uint64(64 - 8 * KEY_BYTES)) >> bits)
        order = np.lexsort((gram, df, owner))
        gram, owner = gram[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(keys) + 1))
        head = prefix_lengths(n, percent) - (n - np.diff(edges))
        head[n == 0] = 0
        found = gram.astype("<u8").view("<i8")
        lists = [found[edges[k] : edges[k + 1]] if head[k] > 0 else None for k in range(len(keys))]
        return pa.Table.from_arrays(
            [
                pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(members, pa.list_(pa.int64())),
                pa.array(np.maximum(head, 0), pa.int32()), pa.array(lists, pa.list_(pa.int64())),
            ],
            names=["set_key", "n", "ids", "head", "grams"],
        )

    return parts.groupBy("batch").applyInArrow(run, _SETS)


def _tile_links(left: list[dict], right: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that span what the product of two blocks finds at the threshold."""
    rows = [np.array(x["grams"], dtype=np.int64) for x in left + right]
    n = np.array([x["n"] for x in left + right], dtype=np.int64)
    names, at = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    i = len(left)
    overlap = np.zeros((i, len(rows) - i), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for start in range(0, len(names), COLUMNS):
        lo, hi = np.searchsorted(at, (start, start + COLUMNS))
        part = np.zeros((len(rows), min(COLUMNS, len(names) - start)), dtype=np.float32)
        part[owner[lo:hi], at[lo:hi] - start] = 1
        overlap += part[:i] @ part[i:].T
    linked = (100 + percent) * overlap >= percent * (n[:i, None] + n[None, i:]) - 1e-6
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys, out = [x["set_key"] for x in left + right], []
    for x, y in zip(*np.nonzero(linked)):
        p, q = find(int(x)), find(int(y) + i)
        if p != q and keys[p] != keys[q]:
            parent[q] = p
            out.append((keys[int(x)], keys[int(y) + i]))
    return out


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): keys of linked classes, enough of them to span every component. ``sets`` has one row per class."""
    posted = sets.select("set_key", "n", F.explode(F.slice("grams", F.lit(1), F.col("head"))).alias("gram"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1")
    met = staged(posted.join(counts, "gram"))
    fits = lambda x, y: x["n"] * 100 >= y["n"] * percent
    few = (
        met.filter(F.col("m") <= LONG_LIST)
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("n", "set_key"))).alias("list"))
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "list",
                        lambda y, j: F.transform(
                            F.filter(F.slice(F.col("list"), F.lit(1), j), lambda x: fits(x, y)),
                            lambda x: F.struct(x["set_key"].alias("a"), y["set_key"].alias("b")),
                        ),
                    )
                )
            ).alias("pair")
        )
        .select("pair.*")
        .distinct()
    )
    side = lambda name: sets.select(F.col("set_key").alias(name), F.col("n").alias(f"n_{name}"), F.col("grams").alias(f"grams_{name}"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    cold = (
        few.join(side("a"), "a").join(side("b"), "b")
        .filter(overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        .select("a", "b")
    )
    hot = met.filter(F.col("m") > LONG_LIST)
    if hot.isEmpty():
        return cold
    return cold.union(_hot_links(sets, hot, percent))


def _hot_links(sets: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    named = hot.select("set_key", F.concat(F.lit(b"gram"), F.col("gram").cast("string").cast("binary")).alias("list"))
    clusters = components(named.select(F.col("set_key").alias("a"), F.col("list").alias("b")))
    members = hot.select("set_key", "n").distinct().join(clusters.select(F.col("node").alias("set_key"), F.col("label").alias("cluster")), "set_key")
    placed = ranked_within(members, ["cluster"], ["n", "set_key"]).withColumn("tile", F.floor((F.col("rank") - 1) / TILE))
    tiles = staged(
        placed.select("set_key", "cluster", "tile").join(sets.select("set_key", "n", "grams"), "set_key")
        .groupBy("cluster", "tile")
        .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list(F.struct("set_key", "n", "grams")).alias("rows"))
    )
    bounds = tiles.select("cluster", "tile", "least", "most")
    left = bounds.select("cluster", F.col("tile").alias("i"), F.col("most").alias("most_i"))
    right = bounds.select("cluster", F.col("tile").alias("j"), F.col("least").alias("least_j"))
    # Tiles are in order of size: beyond the size bound two tiles have no pair.
    pairs = left.join(right, "cluster").filter((F.col("i") <= F.col("j")) & (F.col("most_i") * 100 >= F.col("least_j") * percent)).select("cluster", "i", "j")
    work = (
        pairs.join(tiles.select("cluster", F.col("tile").alias("i"), F.col("rows").alias("left")), ["cluster", "i"])
        .join(tiles.select("cluster", F.col("tile").alias("j"), F.col("rows").alias("right")), ["cluster", "j"])
        .select("left", "right")
        .repartition(max(shuffle_partitions(sets.sparkSession), 1))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _tile_links(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"]
                )

    return work.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_grams, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = max(4 * shuffle_partitions(spark), chars // BLOCK_CHARS, 2)
    blocks = 1 << (wanted - 1).bit_length()
    packed = shared_grams(incidence(docs, n, blocks), blocks)
    classes = staged(sets_of_batches(packed, percent, blocks))
    candidates = (
        classes.filter("head > 0")
        .groupBy("set_key")
        .agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("grams").alias("grams"))
    )
    labels = components(links(staged(candidates), percent))
    own = classes.groupBy("set_key").agg(F.min(F.array_min("ids")).alias("least"))
    joined = own.join(labels.withColumnRenamed("node", "set_key"), "set_key")
    groups = joined.groupBy("label").agg(F.min("least").alias("group_least"))
    grouped = joined.join(groups, "label").select("set_key", "group_least")
    final = own.join(grouped, "set_key", "left").select("set_key", F.coalesce("group_least", "least").alias("component"))
    # Ids are unfolded after the join: a set of many copies is one row per batch until then.
    rows = classes.select("set_key", "n", "ids").join(final, "set_key").select("n", "component", F.explode("ids").alias("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_grams"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def _numbered(docs: DataFrame, row: str, stored: bool) -> DataFrame:
    """``docs`` with a number per row that is the same on every read.

    Rows of a stored table are numbered by their file and their place in it, others are written once with their numbers.
    """
    file, at = fresh(docs, "file"), fresh(docs, "at")
    if stored:
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
        except AnalysisException:
            stored = False
    if not stored:
        return staged(docs.withColumn(row, F.monotonically_increasing_id()))
    files = ranked_within(placed.select(file).distinct().withColumn("every", F.lit(0)), ["every"], [file])
    numbers = staged(files.select(file, F.col("rank").cast("long").alias(row)))
    return placed.join(numbers, file).withColumn(row, F.shiftleft(row, PLACE_BITS) + F.col(at)).drop(file, at)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """The documents that stay: of each group one row of the least doc_id; rows without an id come after those with one.

    Rows are told apart by a number of their own, so different texts of one doc_id are different documents.
    Texts without n-grams are copies of each other only under the same doc_id. ``stored`` says that ``docs`` are
    rows of a table of files, each at most once; then they are not written again.
    """
    row = fresh(docs, "row")
    numbered = _numbered(docs, row, stored)
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), n, percent)
    groups = found.withColumnRenamed("doc_id", row).join(numbered.select(row, "doc_id"), row)
    bare = F.when((F.col("n_grams") == 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)).alias("first")
    kept = groups.groupBy(bare.alias("bare"), F.when(bare.isNull(), F.col("component_id")).alias("component")).agg(first).select(F.col(f"first.{row}").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def op4(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n=4, percent=85).select(
        "doc_id", F.col("n_grams").alias("n_shingles"), "component_id"
    )
