"""Graph lookup, traversal, statistics and graph upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.catalog.code import _EDGE_COLUMNS, CODE, EDGES, _rows
from srcgraph.catalog.shared import code_index
from srcgraph.operators import lookup, stats, traverse, upsert
from srcgraph.sources.adapters import table

# Foreign keys as edges. Open orders ('P') are unresolved and must not be followed.
EDGE_SQL = """
WITH RECURSIVE edge AS (
  SELECT DISTINCT source_id, kind, target_id FROM (
    SELECT 'nation:' || n_nationkey AS source_id, 'IMPORTS' AS kind, 'region:' || n_regionkey AS target_id FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'CALLS', 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'INHERITS_FROM', 'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'DEPENDS_ON', 'customer:' || o_custkey FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'line:' || l_orderkey || '-' || l_linenumber, 'DEPENDS_ON', 'order:' || l_orderkey FROM lineitem
    UNION ALL SELECT 'line:' || l_orderkey || '-' || l_linenumber, 'CALLS', 'supplier:' || l_suppkey FROM lineitem
    UNION ALL SELECT 'line:' || l_orderkey || '-' || l_linenumber, 'CONTAINS', 'part:' || l_partkey FROM lineitem))
"""


def key_edges(spark: SparkSession, folder: str) -> DataFrame:
    def edges(name: str, source, kind: str, target: str, column: str, resolved=F.lit(True)) -> DataFrame:
        return table(spark, folder, name).select(
            source.alias("source_id"),
            F.lit(kind).alias("kind"),
            F.concat(F.lit(f"{target}:"), column).alias("target_id"),
            resolved.alias("resolved"),
        )

    def one(prefix: str, column: str):
        return F.concat(F.lit(f"{prefix}:"), column)

    line = F.concat(F.lit("line:"), "l_orderkey", F.lit("-"), "l_linenumber")
    parts = [
        edges("nation", one("nation", "n_nationkey"), "IMPORTS", "region", "n_regionkey"),
        edges("customer", one("customer", "c_custkey"), "CALLS", "nation", "c_nationkey"),
        edges("supplier", one("supplier", "s_suppkey"), "INHERITS_FROM", "nation", "s_nationkey"),
        edges(
            "orders", one("order", "o_orderkey"), "DEPENDS_ON", "customer", "o_custkey",
            F.col("o_orderstatus") != "P",
        ),
        edges("lineitem", line, "DEPENDS_ON", "order", "l_orderkey"),
        edges("lineitem", line, "CALLS", "supplier", "l_suppkey"),
        edges("lineitem", line, "CONTAINS", "part", "l_partkey"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _walk_sql(roots: str, depth: int, incoming: bool, kinds: str) -> str:
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    return (
        EDGE_SQL
        + f""", used AS (SELECT * FROM edge WHERE kind IN ({kinds})),
walk AS (SELECT root, root AS node, 0 AS d FROM ({roots})
  UNION SELECT w.root, e.{far}, w.d + 1 FROM walk w JOIN used e ON e.{near} = w.node WHERE w.d < {depth})
SELECT root, source_id, kind, target_id, min(d + 1)::INTEGER AS depth
FROM walk JOIN used ON used.{near} = walk.node WHERE d < {depth} GROUP BY ALL"""
    )


DEPENDENCY = "'DEPENDS_ON', 'CALLS', 'IMPORTS', 'INHERITS_FROM'"


@query(
    "dependents",
    _walk_sql("SELECT 'region:' || r_regionkey AS root FROM region", 3, True, DEPENDENCY),
)
def dependents(spark: SparkSession, folder: str) -> DataFrame:
    """What depends on each region, three steps: nations, customers and suppliers, orders and lines."""
    roots = table(spark, folder, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("root"))
    return traverse.dependents(key_edges(spark, folder), roots, 3)


@query(
    "dependencies",
    _walk_sql("SELECT 'order:' || o_orderkey AS root FROM orders", 5, False, DEPENDENCY),
)
def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Everything each order leads to; hundreds of thousands of roots in one walk at scale."""
    roots = table(spark, folder, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("root"))
    return traverse.dependencies(key_edges(spark, folder), roots, 5)


@query(
    "find_related",
    _walk_sql("SELECT 'part:' || p_partkey AS root FROM part", 1, True, "'CONTAINS'"),
)
def find_related(spark: SparkSession, folder: str) -> DataFrame:
    """One edge kind only: the lines that contain each part."""
    roots = table(spark, folder, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("root"))
    return traverse.traverse(key_edges(spark, folder), roots, ["CONTAINS"], 1, incoming=True)


_MODULE_IMPORTS = [edge for edge in EDGES if edge[0] == "IMPORTS" and edge[1] == "module"]


@query(
    "trace_imports",
    CODE
    + f"""SELECT repo AS repository_id, module, target_name AS imported, 1 AS depth
FROM ({_rows(_MODULE_IMPORTS, _EDGE_COLUMNS)})""",
)
def trace_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Import edges reached from every module of the code corpus."""
    index = code_index(spark, folder)
    modules = index.entities_of("module").select(
        F.col("qualified_name").alias("module")
    )
    found = traverse.trace_imports(index.edges, index.entities, modules, 3)
    names = index.entities.select(
        F.col("id").alias("target_id"), F.col("qualified_name").alias("imported"), "repository_id"
    )
    return found.join(names, "target_id").select("repository_id", "module", "imported", "depth")


_CALL_DEPTH = """
WITH RECURSIVE code AS (
  SELECT d.doc_id AS id, d.doc_id // 2 AS parent, d.lang AS repo, coalesce(l.toxic, 0) = 1 AS broken
  FROM documents d LEFT JOIN labels l USING (doc_id)),
link AS (SELECT g.repo, g.id, g.parent FROM code g JOIN code p ON p.repo = g.repo AND p.id = g.parent
  WHERE NOT g.broken AND NOT p.broken),
walk AS (SELECT repo, id AS root, id, 0 AS d FROM code WHERE NOT broken
  UNION SELECT w.repo, w.root, l.parent, w.d + 1 FROM walk w JOIN link l ON l.repo = w.repo AND l.id = w.id
  WHERE w.d < 5)
SELECT w.repo AS repository_id, 'pkg.m' || w.root || '.C' || w.root AS root_name,
       'pkg.m' || l.id || '.C' || l.id AS source_name, 'pkg.m' || l.parent || '.C' || l.parent AS target_name,
       min(w.d + 1)::INTEGER AS depth
FROM walk w JOIN link l ON l.repo = w.repo AND l.id = w.id WHERE w.d < 5 GROUP BY ALL"""


@query("class_ancestry", _CALL_DEPTH)
def class_ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """Base classes of every class, five steps, over the resolved code graph."""
    index = code_index(spark, folder)
    classes = index.entities_of("class")
    found = traverse.find_related(
        index.edges, classes.select(F.col("id").alias("root")), "INHERITS_FROM", 5
    )
    described = traverse.with_entities(found, classes)
    names = classes.select(F.col("id").alias("root"), F.col("qualified_name").alias("root_name"))
    return described.join(names, "root").select(
        F.col("source.repository_id").alias("repository_id"), "root_name",
        F.col("source.qualified_name").alias("source_name"),
        F.col("target.qualified_name").alias("target_name"), "depth",
    )


@query(
    "missing_roots",
    """SELECT o_orderkey, kind || ':' || o_custkey AS identifier
  FROM orders, (VALUES ('customer'), ('supplier')) v(kind)
  WHERE (kind = 'customer' AND o_custkey NOT IN (SELECT c_custkey FROM customer))
     OR (kind = 'supplier' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier))""",
)
def missing_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Each order asks for its customer and for a supplier of the same number."""
    roots = table(spark, folder, "orders").select(
        "o_orderkey",
        F.explode(
            F.array(*[F.concat(F.lit(f"{k}:"), "o_custkey") for k in ("customer", "supplier")])
        ).alias("identifier"),
    )
    known = [
        table(spark, folder, name).select(
            F.concat(F.lit(f"{name}:"), key).alias("id"),
            F.col(label).alias("qualified_name"),
            F.lit(name).alias("kind"),
        )
        for name, key, label in (
            ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"),
        )
    ]
    return lookup.missing_roots(roots, known[0].unionByName(known[1]))


@query(
    "bounded_query",
    """SELECT o_orderkey, o_totalprice, true AS truncated FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def bounded_query(spark: SparkSession, folder: str) -> DataFrame:
    """A user's query over a registered view, cut at 50 rows with a flag."""
    table(spark, folder, "orders").createOrReplaceTempView("bounded_orders")
    return stats.bounded_sql(
        spark, "SELECT o_orderkey, o_totalprice FROM bounded_orders ORDER BY o_totalprice DESC, o_orderkey"
    )


_KIND_COUNTS = (
    CODE
    + """, counted AS (SELECT repo, v.kind, sum(v.n)::BIGINT AS entity_count,
  sum(v.out + CASE WHEN v.kind = 'module' AND parent_ok THEN 2 ELSE 0 END)::BIGINT AS relationship_count
FROM file, (VALUES ('file', 1, 1), ('module', 1, 8), ('class', 1, 6), ('method', 2, 16),
  ('function', 2, 8), ('parameter', 10, 0), ('decorator', 2, 0), ('import', 5, 0), ('docstring', 4, 0))
  v(kind, n, out) GROUP BY ALL)
"""
)


@query("kind_counts", _KIND_COUNTS + "SELECT repo || ':r1' AS revision_id, kind, entity_count, relationship_count FROM counted")
def kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = code_index(spark, folder)
    return stats.kind_counts(upsert.memberships(index.entities), index.entities, index.edges)


@query(
    "graph_statistics",
    _KIND_COUNTS
    + """SELECT repo || ':r1' AS revision_id, sum(entity_count)::BIGINT AS entity_count,
  sum(relationship_count)::BIGINT AS relationship_count,
  string_agg(kind || '=' || entity_count, ', ' ORDER BY kind) AS entities_by_kind FROM counted GROUP BY repo""",
)
def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    index = code_index(spark, folder)
    found = stats.graph_statistics(upsert.memberships(index.entities), index.entities, index.edges)
    entries = F.transform(
        F.map_entries("entities_by_kind"), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return found.withColumn("entities_by_kind", F.array_join(F.array_sort(entries), ", "))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
  GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "entity_upsert",
    """SELECT 'customer:' || c_custkey AS id, coalesce(n.kind, c_mktsegment) AS kind,
  coalesce(n.start_line, 0) AS start_line FROM customer
  LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS kind, max(o_orderkey) AS start_line
             FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey
  UNION ALL SELECT 'customer:' || o_custkey, arg_max(o_orderpriority, o_orderkey), max(o_orderkey)
  FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
)
def entity_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Stored customers, redefined by their orders; the last order wins."""
    old = table(spark, folder, "customer").select(
        F.concat(F.lit("customer:"), "c_custkey").alias("id"),
        F.col("c_mktsegment").alias("kind"),
        F.lit(0).cast("bigint").alias("start_line"),
        F.lit(0).cast("bigint").alias("ord"),
    )
    new = table(spark, folder, "orders").select(
        F.concat(F.lit("customer:"), "o_custkey").alias("id"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_orderkey").alias("start_line"),
        F.col("o_orderkey").alias("ord"),
    )
    return upsert.upsert_entities(old, new).drop("ord")


_LINE_EDGES = """
WITH new AS (SELECT 'order:' || l_orderkey AS source_id, 'CALLS' AS kind, 'part:' || l_partkey AS target_id,
    l_linenumber AS line, l_returnflag = 'R' AS resolved, 'supplier:' || l_suppkey AS file_path,
    l_orderkey FROM lineitem)
"""


def _line_edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.lit("tpch").alias("repository_id"),
        F.lit("r1").alias("revision"),
        F.concat(F.lit("order:"), "l_orderkey").alias("source_id"),
        F.lit("CALLS").alias("kind"),
        F.concat(F.lit("part:"), "l_partkey").alias("target_id"),
        F.concat(F.lit("supplier:"), "l_suppkey").alias("file_path"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("resolved"),
        F.col("l_linenumber").cast("bigint").alias("place"),
    )


@query(
    "edge_upsert",
    _LINE_EDGES
    + """SELECT source_id, kind, target_id, max(line) AS line FROM new
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL""",
)
def edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Order-to-part call sites collapse per pair; open orders are no entities, so their rows drop."""
    new = _line_edges(spark, folder)
    old = new.filter(F.lit(False))
    entities = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("id")
    )
    external = table(spark, folder, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return upsert.upsert_edges(old, new, entities, external).select(
        "source_id", "kind", "target_id", "line"
    )


@query(
    "stale_edges",
    _LINE_EDGES
    + """SELECT source_id, kind, target_id, file_path, line, resolved FROM new o
WHERE resolved OR NOT EXISTS (SELECT 1 FROM new n WHERE n.resolved AND n.source_id = o.source_id
  AND n.kind = o.kind AND n.file_path = o.file_path AND n.line = o.line)""",
)
def stale_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved lines fall where a returned line has the same order, supplier and number."""
    edges = _line_edges(spark, folder)
    return upsert.without_stale(edges, edges).drop("repository_id", "revision", "place")


@query(
    "revision_upsert",
    """SELECT coalesce(c_custkey, s_suppkey) AS id,
  coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_mktsegment) AS branch_or_tag,
  coalesce(s_nationkey, c_nationkey) AS index_job_id
  FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
)
def revision_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as stored revisions, suppliers of the same number as the update; gaps keep values."""
    old = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("branch_or_tag"),
        F.col("c_nationkey").alias("index_job_id"),
    )
    new = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("branch_or_tag"),
        F.col("s_nationkey").alias("index_job_id"),
    )
    return upsert.upsert_revisions(old, new)
