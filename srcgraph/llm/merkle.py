"""Merkle manifest of a dataset by time-forward processing over blocks of a sorted table.

1. Every row becomes a leaf digest. Leaves are range-partitioned and sorted by (source, order); that sorted
   shuffle is the external part of the priority queue: it brings leaves to their block in label order.
2. A block holds the 16^3 leaves below one node three levels up. Inside it, digests travel as messages in
   a priority queue ordered by the label of the receiving node, (last leaf below it, level): a node is
   taken out when all of its children have reported, and sends its digest to its parent. The queue
   holds at most 16 messages per level. Blocks report to the next round, which is three levels higher,
   until each source is one node, the subroot. Subroots, in order of source, are the leaves of the top tree.
3. The sweep back goes through the same nodes in reverse order: a node hands each child its own proof
   suffix behind the digests of the child's siblings, from the root to the subroots and on to the leaves.

A proof is a sequence of levels: position in the run (one byte), number of siblings (one byte), siblings (32
bytes each), leaf upwards. ``fold`` recomputes the root from a leaf and its proof.

A source may hold any share of the rows: blocks have a fixed size and rows are numbered by the counts of
sorted partitions. Only the root, one digest, comes to the driver.

Defined results: a null value is marked as such in the leaf; rows without source are a source of their
own, before all others; rows of one order value, a null one first, follow the order of their digests, and
repeated rows are leaves of their own; a source of one row is its leaf; the root of one source is its
subroot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import staged, table
from srcgraph.session import ranked_within

RUN, LEVELS = 16, 3
SPAN = RUN**LEVELS


def leaf_digest(*values: str | Column) -> Column:
    """sha256, as lowercase hex, of the values' lengths in bytes and texts."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def forward(leaves: list[bytes], height: int) -> tuple[list[tuple[int, int, list[bytes]]], bytes]:
    """Nodes (level, index, digests of the children) over ``leaves`` in the order they are finished, and the last one's digest."""
    queue: list[tuple[int, int, int, bytes]] = []
    nodes, top = [], leaves[0]

    def send(level: int, index: int, digest: bytes) -> None:
        parent = index // RUN
        heapq.heappush(queue, ((parent + 1) * RUN ** (level + 1), level + 1, index, digest))

    for i, leaf in enumerate(leaves):
        if height:
            send(0, i, leaf)
        until = i + 1 if i + 1 < len(leaves) else RUN**height
        while queue and queue[0][0] <= until:
            label, children = queue[0][:2], []
            while queue and queue[0][:2] == label:
                _, level, child, digest = heapq.heappop(queue)
                children.append(digest)
            top = joined(children)
            nodes.append((level, child // RUN, children))
            if level < height:
                send(level, child // RUN, top)
    return nodes, top


def backward(nodes: list[tuple[int, int, list[bytes]]], count: int, height: int, suffix: bytes) -> list[bytes]:
    """Proof of each of ``count`` leaves, given the proof of the node on top."""
    held = {(height, 0): suffix}
    for level, index, children in reversed(nodes):
        own = held.pop((level, index))
        for k, _ in enumerate(children):
            held[(level - 1, index * RUN + k)] = b"".join([bytes((k, len(children) - 1)), *children[:k], *children[k + 1 :], own])
    return [held[(0, i)] for i in range(count)]


def proof_levels(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(position, siblings) from the leaf upwards."""
    at = 0
    while at < len(proof):
        place, many = proof[at], proof[at + 1]
        at += 2
        yield place, [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(many)]
        at += 32 * many


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that ``leaf`` and ``proof`` lead to."""
    for place, siblings in proof_levels(proof):
        leaf = joined([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def _height(count: Column) -> Column:
    """Levels above ``count`` leaves until one node is left."""
    powers = F.array(*[F.lit(RUN**k).cast("long") for k in range(15)])
    return F.size(F.filter(powers, lambda p: p < count)).cast("int")


def _sorted_block(rows: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    rows = rows.sort_by("idx")
    return rows, rows.column("digest").to_pylist(), min(rows.column("height")[0].as_py(), LEVELS)


def _report(key: tuple, rows: pa.Table) -> pa.Table:
    rows, digests, height = _sorted_block(rows)
    _, top = forward(digests, height)
    return pa.table(
        {
            "tree": pa.array([key[0].as_py()], pa.int64()),
            "idx": pa.array([key[1].as_py()], pa.int64()),
            "height": pa.array([rows.column("height")[0].as_py() - height], pa.int32()),
            "digest": pa.array([top], pa.binary()),
        }
    )


def _block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / SPAN).cast("long"))


def _upwards(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes (tree, idx, height, digest) that still have levels above them, lowest first, and the tops of all trees."""
    rounds, tops = [], nodes.filter("height = 0").select("tree", "digest")
    rest = nodes.filter("height > 0")
    while not rest.isEmpty():
        rounds.append(rest)
        plain = _block(rest.select("tree", "idx", "height", "digest"))
        up = staged(plain.groupBy("tree", "block").applyInArrow(_report, "tree long, idx long, height int, digest binary"))
        tops = tops.unionByName(up.filter("height = 0").select("tree", "digest"))
        rest = up.filter("height > 0")
    return rounds, tops


def _hand_down(kept: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, digests, height = _sorted_block(left.select(kept))
        subroot, proof = right.column("subroot")[0].as_py(), right.column("proof")[0].as_py()
        proofs = backward(forward(digests, height)[0], len(digests), height, proof)
        return rows.append_column("subroot", pa.array([subroot] * len(digests), pa.binary())).append_column("proof", pa.array(proofs, pa.binary()))

    return run


def _downwards(rounds: list[DataFrame], starts: DataFrame | None) -> DataFrame:
    """Rows of the lowest round with the proof of each. ``starts`` (tree, subroot, proof) has the proofs of the tops; None: they are empty."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        nodes = _block(rounds[k])
        kept = [c for c in nodes.columns if c != "block"]
        # The trees that end with this round begin their way back here; the others come from the round above.
        ending = nodes.filter(f"idx = 0 and height <= {LEVELS}").select("tree")
        begun = ending.select("tree", F.lit(b"").alias("subroot"), F.lit(b"").alias("proof")) if starts is None else starts.join(ending, "tree")
        begun = begun.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "proof")
        given = begun if above is None else begun.unionByName(above.select("tree", F.col("idx").alias("block"), "subroot", "proof"))
        schema = nodes.select(*kept).schema

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        above = nodes.groupBy("tree", "block").cogroup(given.groupBy("tree", "block")).applyInArrow(_hand_down(kept), f"{types}, subroot binary, proof binary")
        if k:
            above = staged(above)
    return above


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (number of the source), idx (place in it) and height; and the trees (tree, name)."""
    order = ["named", "name", "key", "digest", "row"]
    laid = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = staged(laid.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    group = ["named", "name", "part"]
    pieces = laid.groupBy(*group).agg(F.count("*").alias("count"), F.min("at").alias("first"))
    source = Window.partitionBy("named", "name")
    before = source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("all", F.sum("count").over(source))
    names = pieces.select("named", "name").distinct().withColumn("every", F.lit(0))
    trees = ranked_within(names, ["every"], ["named", "name"]).select("named", "name", (F.col("rank") - 1).cast("long").alias("tree"))
    pieces = staged(pieces.join(trees, ["named", "name"]).select(*group, "tree", "first", "before", _height(F.col("all")).alias("height")))
    placed = laid.join(pieces, group).select(
        "tree", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "height", "digest", *[c for c in leaves.columns if c not in (*order, "digest")], "key"
    )
    return placed, pieces.select("tree").distinct()


def manifest(docs: DataFrame, leaf: Column, source: str = "source", key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, …) per row of ``docs``; digests as bytes, and the columns of ``keep``.

    ``leaf`` is the digest of a row as hex text; leaves of a ``source`` ascend by ``key``.
    """
    keep = keep or {}
    own = {f"kept_{k}": c for k, c in enumerate(keep.values())}
    leaves = docs.select(
        F.col(source).isNotNull().cast("int").alias("named"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"), F.col(key).alias("key"),
        F.unhex(leaf).alias("digest"), *[c.alias(n) for n, c in own.items()], F.monotonically_increasing_id().alias("row"),
    )
    placed, trees = _numbered(staged(leaves))
    rounds, tops = _upwards(placed)
    tops = staged(tops)
    count = trees.count()
    top_nodes = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), _height(F.lit(count)).alias("height"), "digest")
    if count > 1:
        top_rounds, root = _upwards(staged(top_nodes))
        root = root.first()["digest"]
        starts = _downwards(top_rounds, None).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "proof")
    else:
        root = (tops.first() or {"digest": b""})["digest"]
        starts = tops.select("tree", F.col("digest").alias("subroot"), F.lit(b"").alias("proof"))
    starts = staged(starts)
    columns = ["key", "digest", *own, "subroot", "proof"]
    found = placed.filter("height = 0").join(starts, "tree").select(*columns)
    if rounds:
        found = found.unionByName(_downwards(rounds, starts).select(*columns))
    return found.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(bytearray(root)).alias("root"), "proof", *[F.col(n).alias(k) for n, k in zip(own, keep)]
    )


def checked(rows: DataFrame, leaf: str) -> DataFrame:
    """``rows`` of a manifest with proof_sha256, the digest of all siblings of the proof, and folded_root, from the digests in column ``leaf``."""
    extra = "proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, leaves = batch.column("proof").to_pylist(), batch.column(leaf).to_pylist()
            seen = [joined([s for _, siblings in proof_levels(p) for s in siblings]).hex() for p in proofs]
            folded = [fold(x, p).hex() for x, p in zip(leaves, proofs)]
            kept = [c for c in batch.schema.names if c != "proof"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seen), pa.array(folded)], names=[*kept, "proof_sha256", "folded_root"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("proof").schema)
    return rows.mapInArrow(run, f"{kinds}, {extra}")


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    leaf = leaf_digest("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    other = F.when(tampered, F.unhex(leaf_digest("doc_id", "source", "lang", "n_chars", F.translate("text", _CAPITALS, _SMALL))))
    rows = manifest(docs, leaf, keep={"tampered": other}).withColumn("given", F.coalesce("tampered", "leaf")).drop("tampered")
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return checked(rows, "given").select(
        "doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified")
    )


def _sql(levels: int = 7) -> str:
    """The same by SQL: a table per level, siblings by a join of each level with itself."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    shift = "lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = (
        "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)), "
        f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {shift})), 4294967295)"
    )
    small = f"translate(text, '{_CAPITALS}', '{_SMALL}')"
    parts = [
        f"base AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, "
        f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS given FROM documents)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM base)",
        "a0 AS (SELECT tree, idx, n, leaf AS d FROM placed)",
        "w0 AS (SELECT r, tree, idx, n, given AS f, '' AS p FROM placed)",
    ]

    def climb(a: str, w: str) -> None:
        for k in range(levels):
            parts.append(
                f"{a}{k + 1} AS (SELECT tree, idx // 16 AS idx, CAST(ceil(n / 16) AS BIGINT) AS n, "
                f"CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE min(d) END AS d FROM {a}{k} GROUP BY tree, idx // 16, n)"
            )
            parts.append(
                f"{a}s{k} AS (SELECT x.tree, x.idx, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lo, "
                f"coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS hi "
                f"FROM {a}{k} AS x JOIN {a}{k} AS y ON x.tree = y.tree AND x.idx // 16 = y.idx // 16 AND x.n > 1 GROUP BY x.tree, x.idx)"
            )
            parts.append(
                f"{w}{k + 1} AS (SELECT r, w.tree, w.idx // 16 AS idx, CAST(ceil(n / 16) AS BIGINT) AS n, "
                f"CASE WHEN n > 1 THEN sha256(lo || f || hi) ELSE f END AS f, CASE WHEN n > 1 THEN p || lo || hi ELSE p END AS p "
                f"FROM {w}{k} AS w LEFT JOIN {a}s{k} AS s ON w.tree = s.tree AND w.idx = s.idx)"
            )

    climb("a", "w")
    parts.append(f"subroots AS (SELECT tree, d FROM a{levels})")
    parts.append("b0 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, d FROM subroots)")
    parts.append(f"v0 AS (SELECT r, 0 AS tree, tree AS idx, (SELECT count(*) FROM subroots) AS n, f, p FROM w{levels})")
    climb("b", "v")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = t.d AS verified "
        f"FROM placed AS x JOIN subroots AS s ON x.tree = s.tree JOIN v{levels} AS v ON x.r = v.r CROSS JOIN b{levels} AS t"
    )


OP13_SQL = _sql()
