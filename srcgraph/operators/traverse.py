"""Bounded graph traversal as a bit-parallel frontier join, 64 roots to a row."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.session import cut_lineage, sized_broadcast

# Edge kinds that count as dependencies, and the depth bounds.
DEPENDENCY_KINDS = ["DEPENDS_ON", "CALLS", "IMPORTS", "INHERITS_FROM"]
MAX_DEPTH = 5
ROOTS = 64
#: Edges of one node that stay together; a node with more is spread over as many sub-keys as it takes.
EDGES_TOGETHER = 10_000


def _laid_out(usable: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """Edges laid out by (node, salt), each once, and the nodes that have several salts (node, salts)."""
    degrees = usable.groupBy("node").agg(F.ceil(F.count("*") / EDGES_TOGETHER).cast("int").alias("salts"))
    hubs = sized_broadcast(cut_lineage(degrees.filter("salts > 1")))
    partitions = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Duplicates of an edge share its node and salt, so they are dropped without another shuffle.
    # A persisted table keeps its hash layout (a checkpoint does not), so every step joins it in
    # place; blocks of a lost executor are rebuilt from the edge table.
    edges = (
        usable.join(hubs, "node", "left")
        .withColumn("salt", F.pmod(F.xxhash64(end), F.coalesce("salts", F.lit(1))).cast("int"))
        .drop("salts")
        .repartition(partitions, "node", "salt")
        .distinct()
        .persist(StorageLevel.DISK_ONLY)
    )
    return edges, hubs


def _at_edges(edges: DataFrame, hubs: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier rows beside the edges of their node; a hub is asked once per block of roots and salt."""
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    asked = frontier.join(hubs, "node", "left").withColumn("salt", F.explode(salts)).drop("salts")
    return edges.join(asked, ["node", "salt"])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def traverse(
    edges: DataFrame,
    roots: DataFrame,
    kinds: list[str],
    max_depth: int = 1,
    incoming: bool = False,
) -> DataFrame:
    """Edges within ``max_depth`` steps of each root, each once with its least depth.

    ``edges``: source_id, kind, target_id, resolved; ``roots``: root. Edges to external symbols
    are not followed or returned.

    Roots are numbered and 64 of them share a frontier row (node, block, bits). A step joins the rows
    with the edges of their nodes and ORs the bits per node reached, first in each task, so roots that
    meet go on as one row. Bits a node has had before are taken out; the walk ends when none are
    left. Only at the end are the edges of all steps joined with their bits and unfolded per root.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    start, end = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    usable = (
        edges.filter(F.col("resolved") & F.col("kind").isin(*kinds))
        .select("source_id", "kind", "target_id")
        .withColumn("node", F.col(start))
    )
    number = F.monotonically_increasing_id()
    numbered = cut_lineage(roots.select("root").filter("root IS NOT NULL").distinct().select("root", number.alias("number"))).select(
        "root", F.floor(F.col("number") / ROOTS).alias("block"), (F.col("number") % ROOTS).cast("int").alias("place")
    )
    laid_out, hubs = _laid_out(usable, end)
    frontier = numbered.select(F.col("root").alias("node"), "block", _bit(F.col("place")).alias("bits"))
    steps = [frontier]
    while len(steps) < max_depth:
        reached = (
            _at_edges(laid_out, hubs, frontier)
            .groupBy(F.col(end).alias("node"), "block")
            .agg(F.bit_or("bits").alias("bits"))
        )
        before = reduce(DataFrame.unionByName, steps).groupBy("node", "block").agg(F.bit_or("bits").alias("had"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        frontier = cut_lineage(
            reached.join(before, ["node", "block"], "left").select("node", "block", fresh.alias("bits")).filter("bits <> 0")
        )
        if frontier.isEmpty():
            break
        steps.append(frontier)
    # A node has a root's bit in one step only, its least distance, so no edge appears twice for a root.
    walked = reduce(DataFrame.unionByName, [s.withColumn("depth", F.lit(k)) for k, s in enumerate(steps, 1)])
    found = _at_edges(laid_out, hubs, walked).join(sized_broadcast(numbered), "block")
    found = found.filter(F.call_function("shiftrightunsigned", "bits", "place").bitwiseAND(1) == 1)
    found = cut_lineage(found.select("root", "source_id", "kind", "target_id", "depth"))
    laid_out.unpersist()
    return found


def dependencies(edges: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    return traverse(edges, roots, DEPENDENCY_KINDS, max_depth)


def dependents(edges: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    return traverse(edges, roots, DEPENDENCY_KINDS, max_depth, incoming=True)


def trace_imports(
    edges: DataFrame, entities: DataFrame, modules: DataFrame, max_depth: int = 3
) -> DataFrame:
    """IMPORTS edges from modules given by qualified name (column ``module``)."""
    known = entities.filter(F.col("kind") == "module").select(
        F.col("qualified_name").alias("module"), F.col("id").alias("root")
    )
    roots = modules.select("module").distinct().join(known, "module")
    found = traverse(edges, roots.select("root"), ["IMPORTS"], max_depth)
    return found.join(roots, "root")


def find_related(edges: DataFrame, roots: DataFrame, kind: str, max_depth: int = 1) -> DataFrame:
    return traverse(edges, roots, [kind], max_depth)


def with_entities(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Attach the entity struct of both ends to traversal rows."""
    described = F.struct(
        *[c for c in entities.columns if c not in ("metadata", "content_hash", "ord")]
    )
    lookup = entities.select(F.col("id").alias("end_id"), described.alias("entity"))
    for end in ("source", "target"):
        relations = (
            relations.join(lookup, relations[f"{end}_id"] == lookup["end_id"])
            .withColumnRenamed("entity", end)
            .drop("end_id")
        )
    return relations
