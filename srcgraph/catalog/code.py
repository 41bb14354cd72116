"""Extraction, analysis and resolution over the code corpus derived from ``documents``.

The oracle texts state, per document, what its file must yield; they never look at the extractor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.catalog.shared import code_index
from srcgraph.functions import ids
from srcgraph.operators import extract, facts, resolve, responses, vectors
from srcgraph.sources.adapters import CODE_TEMPLATE

# e is the last line of the module docstring; all later lines of a file are counted from it.
CODE = """
WITH code AS (
  SELECT d.doc_id AS id, d.doc_id // 2 AS parent, d.n_chars AS size, d.n_chars + 1 AS next, d.text,
         d.lang AS repo, 'pkg/m' || d.doc_id || '.py' AS path, 'pkg.m' || d.doc_id AS module,
         1 + length(d.text) - length(replace(d.text, chr(10), '')) AS e,
         coalesce(l.toxic, 0) = 1 AS broken
  FROM documents d LEFT JOIN labels l USING (doc_id)),
good AS (SELECT * FROM code WHERE NOT broken),
sized AS (SELECT repo, size, count(*) AS copies FROM good GROUP BY repo, size),
file AS (
  SELECT g.*, p.id IS NOT NULL AS parent_ok, coalesce(s.copies, 0) = 1 AS next_ok
  FROM good g LEFT JOIN good p ON p.repo = g.repo AND p.id = g.parent
  LEFT JOIN sized s ON s.repo = g.repo AND s.size = g.next)
"""


def _expr(template: str) -> str:
    """SQL concatenation for a text with {columns} and {e+n} line numbers."""
    parts = re.split(r"\{([^}]+)\}", template)
    pieces = [
        f"CAST({part} AS VARCHAR)" if i % 2 else "'" + part.replace("'", "''") + "'"
        for i, part in enumerate(parts)
        if part
    ]
    return "(" + " || ".join(pieces or ["''"]) + ")"


def _rows(rows: list[tuple], columns: list[str], source: str = "file") -> str:
    """UNION ALL of one SELECT per template row; strings are templates, other values literal."""
    selects = []
    for row in rows:
        values = [
            _expr(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in row
        ]
        named = ", ".join(f"{v} AS {c}" for v, c in zip(values, columns))
        selects.append(f"SELECT id, repo, path, module, {named} FROM {source}")
    return " UNION ALL ".join(selects)


# kind, name, qualified name, first line, last line
ENTITIES = [
    ("file", "{path}", "{path}", "1", "{e+38}"),
    ("module", "m{id}", "{module}", "1", "{e+38}"),
    ("docstring", "__doc__", "{module}.__doc__", "1", "{e}"),
    ("import", "os.path", "{module}.__import__.{e+1}.0", "{e+1}", "{e+1}"),
    ("import", "pkg.m{parent}.C{parent}", "{module}.__import__.{e+2}.0", "{e+2}", "{e+2}"),
    ("import", ".m{parent}", "{module}.__import__.{e+3}.0", "{e+3}", "{e+3}"),
    ("import", ".m{parent}", "{module}.__import__.{e+4}.0", "{e+4}", "{e+4}"),
    ("class", "C{id}", "{module}.C{id}", "{e+7}", "{e+25}"),
    ("decorator", "register", "{module}.C{id}.__decorator__.0", "{e+6}", "{e+6}"),
    ("docstring", "__doc__", "{module}.C{id}.__doc__", "{e+8}", "{e+8}"),
    ("method", "run", "{module}.C{id}.run", "{e+12}", "{e+18}"),
    ("decorator", "cached(limit)", "{module}.C{id}.run.__decorator__.0", "{e+11}", "{e+11}"),
    ("parameter", "self", "{module}.C{id}.run.self", "{e+12}", "{e+12}"),
    ("parameter", "a", "{module}.C{id}.run.a", "{e+12}", "{e+12}"),
    ("parameter", "args", "{module}.C{id}.run.args", "{e+12}", "{e+12}"),
    ("parameter", "flag", "{module}.C{id}.run.flag", "{e+12}", "{e+12}"),
    ("parameter", "kw", "{module}.C{id}.run.kw", "{e+12}", "{e+12}"),
    ("docstring", "__doc__", "{module}.C{id}.run.__doc__", "{e+13}", "{e+13}"),
    ("method", "step", "{module}.C{id}.step", "{e+20}", "{e+25}"),
    ("parameter", "self", "{module}.C{id}.step.self", "{e+20}", "{e+20}"),
    ("parameter", "a", "{module}.C{id}.step.a", "{e+20}", "{e+20}"),
    ("function", "helper_{id}", "{module}.helper_{id}", "{e+27}", "{e+31}"),
    ("parameter", "x", "{module}.helper_{id}.x", "{e+27}", "{e+27}"),
    ("parameter", "gate", "{module}.helper_{id}.gate", "{e+27}", "{e+27}"),
    (
        "import", ".m{parent}.C{parent}", "{module}.helper_{id}.__import__.{e+28}.0", "{e+28}",
        "{e+28}",
    ),
    ("function", "size_{size}", "{module}.size_{size}", "{e+33}", "{e+38}"),
    ("parameter", "y", "{module}.size_{size}.y", "{e+33}", "{e+33}"),
    ("docstring", "__doc__", "{module}.size_{size}.__doc__", "{e+34}", "{e+37}"),
]
ENTITY_ROWS = _rows(
    ENTITIES, ["kind", "name", "qualified_name", "start_text", "end_text"]
)
ENTITY_CTE = (
    CODE
    + f", entity AS (SELECT *, start_text::INTEGER AS start_line, end_text::INTEGER AS end_line, "
    "kind || ':' || sha256(repo || '|' || path || '|' || kind || '|' || qualified_name) AS eid "
    f"FROM ({ENTITY_ROWS}))"
)


@query(
    "extract_entities",
    ENTITY_CTE
    + """
SELECT repo AS repository_id, eid AS id, kind, name, qualified_name, path AS file_path, start_line,
       end_line FROM entity""",
)
def extract_entities(spark: SparkSession, folder: str) -> DataFrame:
    return code_index(spark, folder).entities.select(
        "repository_id", "id", "kind", "name", "qualified_name", "file_path", "start_line",
        "end_line",
    )


@query(
    "module_docstrings",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, module || '.__doc__' AS qualified_name,
       length(text) AS characters, sha256(text) AS text_hash FROM good""",
)
def module_docstrings(spark: SparkSession, folder: str) -> DataFrame:
    """Docstring text of every module, whole: its digest must be that of the document."""
    text = F.col("metadata")["text"]
    modules = code_index(spark, folder).entities_of("docstring").filter(
        F.col("qualified_name") == F.concat(ids.module_name(F.col("file_path")), F.lit(".__doc__"))
    )
    return modules.select(
        "repository_id", "file_path", "qualified_name",
        F.length(text).cast("bigint").alias("characters"), F.sha2(text, 256).alias("text_hash"),
    )


@query(
    "parameter_metadata",
    CODE
    + """
SELECT p.kind AS parameter_kind, p.annotation, p."default", count(*) AS parameters
FROM good, (VALUES ('positional', NULL, NULL), ('positional', NULL, NULL),
  ('var_positional', NULL, NULL), ('keyword_only', 'bool', 'True'), ('var_keyword', NULL, NULL),
  ('positional', NULL, NULL), ('positional', NULL, NULL), ('positional', NULL, NULL),
  ('positional', NULL, 'Depends(limit)'), ('positional', NULL, NULL)) p(kind, annotation, "default")
GROUP BY ALL""",
)
def parameter_metadata(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("metadata")
    return (
        code_index(spark, folder)
        .entities_of("parameter")
        .groupBy(
            value["parameter_kind"].alias("parameter_kind"),
            value["annotation"].alias("annotation"),
            value["default"].alias("default"),
        )
        .agg(F.count(F.lit(1)).alias("parameters"))
    )


@query(
    "parse_issues",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, 1 AS line, true AS fatal
FROM code WHERE broken""",
)
def parse_issues(spark: SparkSession, folder: str) -> DataFrame:
    return extract.parse_issues(code_index(spark, folder).facts).drop("revision", "message")


@query(
    "stable_ids",
    """SELECT source AS repository_id, lang || '/' || doc_id || '.txt' AS file_path,
  sha256(text) AS content_hash,
  'file:' || sha256(source || '|' || lang || '/' || doc_id || '.txt|file|' || lang || '/' || doc_id
    || '.txt') AS entity_id,
  'symbol:function:' || sha256(source || '|function|' || lang) AS symbol_id,
  source || ':r1' AS revision_id FROM documents""",
)
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    from srcgraph.sources.adapters import text_files

    path = F.col("file_path")
    language = F.substring_index(path, "/", 1)
    repository = F.col("repository_id")
    return text_files(spark, folder).select(
        "repository_id", "file_path", "content_hash",
        ids.entity_id(repository, path, F.lit("file"), path).alias("entity_id"),
        ids.symbol_id(repository, F.lit("function"), language).alias("symbol_id"),
        ids.revision_id(repository, F.col("revision")).alias("revision_id"),
    )


@query(
    "module_name",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source || '.' || lang
  ELSE source || '.' || lang || '.d' || doc_id END AS module FROM documents""",
)
def module_name(spark: SparkSession, folder: str) -> DataFrame:
    """English documents stand for package markers, the others for plain modules."""
    from srcgraph.sources.adapters import table

    leaf = F.when(F.col("lang") == "en", F.lit("__init__")).otherwise(F.concat(F.lit("d"), "doc_id"))
    path = F.concat(F.concat_ws("/", "source", "lang", leaf), F.lit(".py"))
    return table(spark, folder, "documents").select("doc_id", ids.module_name(path).alias("module"))


@query(
    "absolute_import",
    """SELECT o_orderkey,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'a.b.c.k' WHEN '2' THEN 'a.b.k' WHEN '3' THEN 'a.k'
    ELSE 'k' END || o_orderkey AS relative,
  'top.k' || o_orderkey AS absolute FROM orders""",
)
def absolute_import(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys imported into package a.b.c with as many dots as their priority, and with none."""
    from srcgraph.sources.adapters import table

    name = F.concat(F.lit("k"), "o_orderkey")
    dots = F.repeat(F.lit("."), F.substring("o_orderpriority", 1, 1).cast("int"))
    package = F.lit("a.b.c")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        ids.absolute_import(F.concat(dots, name), package).alias("relative"),
        ids.absolute_import(F.concat(F.lit("top."), name), package).alias("absolute"),
    )


# kind, source kind, source name, target name, line, recorded as resolved
EDGES = [
    ("CONTAINS", "file", "{path}", "{module}", "1", "true"),
    ("DOCUMENTED_BY", "module", "{module}", "{module}.__doc__", "1", "true"),
    ("IMPORTS", "module", "{module}", "{module}.__import__.{e+1}.0", "{e+1}", "true"),
    ("IMPORTS", "module", "{module}", "{module}.__import__.{e+2}.0", "{e+2}", "true"),
    ("IMPORTS", "module", "{module}", "{module}.__import__.{e+3}.0", "{e+3}", "true"),
    ("IMPORTS", "module", "{module}", "{module}.__import__.{e+4}.0", "{e+4}", "true"),
    ("CONTAINS", "module", "{module}", "{module}.C{id}", "{e+7}", "true"),
    ("INHERITS_FROM", "class", "{module}.C{id}", "Base", "{e+7}", "false"),
    ("INHERITS_FROM", "class", "{module}.C{id}", "sibling.Mixin", "{e+7}", "false"),
    ("DECORATED_BY", "class", "{module}.C{id}", "{module}.C{id}.__decorator__.0", "{e+6}", "true"),
    ("DOCUMENTED_BY", "class", "{module}.C{id}", "{module}.C{id}.__doc__", "{e+8}", "true"),
    ("CONTAINS", "class", "{module}.C{id}", "{module}.C{id}.run", "{e+12}", "true"),
    (
        "DECORATED_BY", "method", "{module}.C{id}.run", "{module}.C{id}.run.__decorator__.0",
        "{e+11}", "true",
    ),
    ("HAS_PARAMETER", "method", "{module}.C{id}.run", "{module}.C{id}.run.self", "{e+12}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.run", "{module}.C{id}.run.a", "{e+12}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.run", "{module}.C{id}.run.args", "{e+12}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.run", "{module}.C{id}.run.flag", "{e+12}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.run", "{module}.C{id}.run.kw", "{e+12}", "true"),
    ("DOCUMENTED_BY", "method", "{module}.C{id}.run", "{module}.C{id}.run.__doc__", "{e+13}", "true"),
    ("CALLS", "method", "{module}.C{id}.run", "self.step", "{e+15}", "false"),
    ("CALLS", "method", "{module}.C{id}.run", "os.path.join", "{e+17}", "false"),
    ("CALLS", "method", "{module}.C{id}.run", "str", "{e+17}", "false"),
    ("CALLS", "method", "{module}.C{id}.run", "Base.run", "{e+18}", "false"),
    ("CONTAINS", "class", "{module}.C{id}", "{module}.C{id}.step", "{e+20}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.step", "{module}.C{id}.step.self", "{e+20}", "true"),
    ("HAS_PARAMETER", "method", "{module}.C{id}.step", "{module}.C{id}.step.a", "{e+20}", "true"),
    ("CALLS", "method", "{module}.C{id}.step", "fetch", "{e+22}", "false"),
    ("CALLS", "method", "{module}.C{id}.step", "KeyError", "{e+24}", "false"),
    ("CALLS", "method", "{module}.C{id}.step", "helper_{id}", "{e+25}", "false"),
    ("CONTAINS", "module", "{module}", "{module}.helper_{id}", "{e+27}", "true"),
    ("HAS_PARAMETER", "function", "{module}.helper_{id}", "{module}.helper_{id}.x", "{e+27}", "true"),
    (
        "HAS_PARAMETER", "function", "{module}.helper_{id}", "{module}.helper_{id}.gate", "{e+27}",
        "true",
    ),
    (
        "IMPORTS", "function", "{module}.helper_{id}",
        "{module}.helper_{id}.__import__.{e+28}.0", "{e+28}", "true",
    ),
    ("CALLS", "function", "{module}.helper_{id}", "size_{next}", "{e+30}", "false"),
    ("CALLS", "function", "{module}.helper_{id}", "helper_{parent}", "{e+31}", "false"),
    ("CONTAINS", "module", "{module}", "{module}.size_{size}", "{e+33}", "true"),
    ("HAS_PARAMETER", "function", "{module}.size_{size}", "{module}.size_{size}.y", "{e+33}", "true"),
    (
        "DOCUMENTED_BY", "function", "{module}.size_{size}", "{module}.size_{size}.__doc__",
        "{e+34}", "true",
    ),
    ("CALLS", "function", "{module}.size_{size}", "C{id}", "{e+38}", "false"),
]
_EDGE_COLUMNS = ["kind", "source_kind", "source_name", "target_name", "line_text", "resolved_text"]


@query(
    "extract_edges",
    CODE
    + f"""
SELECT repo AS repository_id, kind,
  source_kind || ':' || sha256(repo || '|' || path || '|' || source_kind || '|' || source_name)
    AS source_id,
  target_name AS target_qualified_name, resolved_text = 'true' AS resolved, path AS file_path,
  line_text::INTEGER AS line FROM ({_rows(EDGES, _EDGE_COLUMNS)})""",
)
def extract_edges(spark: SparkSession, folder: str) -> DataFrame:
    return code_index(spark, folder).references.select(
        "repository_id", "kind", "source_id", "target_qualified_name", "resolved", "file_path",
        "line",
    )


# What each reference must resolve to: (condition, target, strategy); unlisted ones stay open.
_HIT = {
    "Base": ("parent_ok", "pkg.m{parent}.C{parent}", "import_alias"),
    "self.step": ("true", "{module}.C{id}.step", "instance_method"),
    "Base.run": ("parent_ok", "pkg.m{parent}.C{parent}.run", "import_alias"),
    "helper_{id}": ("true", "{module}.helper_{id}", ""),
    "size_{next}": ("next_ok", None, "unique_repository_symbol"),
    "C{id}": ("true", "{module}.C{id}", "module_scope"),
}


def _resolution_sql() -> str:
    selects = []
    for kind, _, source, target, line, resolved in EDGES:
        if resolved == "true":
            continue
        condition, name, strategy = _HIT.get(target, ("false", target, ""))
        if target == "helper_{parent}":
            condition, name = "parent_ok", "pkg.m{parent}.helper_{parent}"
            label = "CASE WHEN parent = id THEN '' ELSE 'unique_repository_symbol' END"
        elif target == "C{id}":
            label = "CASE WHEN parent = id THEN 'import_alias' ELSE 'module_scope' END"
        else:
            label = f"'{strategy}'"
        hit = "next_target" if name is None else _expr(name)
        selects.append(
            f"SELECT repo, path, '{kind}' AS kind, {_expr(source)} AS source_name, "
            f"CASE WHEN {condition} THEN {hit} ELSE {_expr(target)} END AS target_name, "
            f"({condition}) AS resolved, CASE WHEN {condition} THEN {label} ELSE '' END AS strategy, "
            f"{_expr(line)}::INTEGER AS line FROM wide"
        )
    return (
        CODE
        + """, wide AS (SELECT f.*, n.module || '.size_' || f.next AS next_target FROM file f
  LEFT JOIN good n ON f.next_ok AND n.repo = f.repo AND n.size = f.next)
SELECT repo AS repository_id, kind, path AS file_path, line, source_name,
       target_name AS target_qualified_name, resolved, strategy FROM ("""
        + " UNION ALL ".join(selects)
        + ")"
    )


def _strategy() -> object:
    return F.coalesce(F.col("metadata")["resolution_strategy"], F.lit("")).alias("strategy")


RESOLUTION = _resolution_sql()


@query("resolve_repository", RESOLUTION)
def resolve_repository(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and bases after both passes, with the strategy of the corpus-wide pass."""
    return (
        code_index(spark, folder)
        .edges.filter(F.col("kind").isin("CALLS", "INHERITS_FROM"))
        .select(
            "repository_id", "kind", "file_path", "line", "source_name", "target_qualified_name",
            "resolved", _strategy(),
        )
    )


@query(
    "resolve_local",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, e + 25 AS line,
       module || '.helper_' || id AS target_qualified_name FROM file
UNION ALL
SELECT repo, path, e + 31, module || '.helper_' || id FROM file WHERE parent = id""",
)
def resolve_local(spark: SparkSession, folder: str) -> DataFrame:
    """References the file-local pass settles on its own."""
    local = resolve.local_resolution(code_index(spark, folder).references)
    return local.filter(F.col("resolved") & F.col("kind").isin("CALLS", "INHERITS_FROM")).select(
        "repository_id", "file_path", F.col("line").cast("bigint").alias("line"),
        "target_qualified_name",
    )


@query(
    "import_depends_on",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, line, module AS source_name,
       target AS target_qualified_name, '1.0' AS confidence,
       'import:' || sha256(repo || '|' || path || '|import|' || module || '.__import__.' || line
         || '.0') AS import_entity_id
FROM (SELECT *, e + 2 AS line, 'pkg.m' || parent || '.C' || parent AS target FROM file
      UNION ALL SELECT *, e + 3, 'pkg.m' || parent FROM file
      UNION ALL SELECT *, e + 4, 'pkg.m' || parent FROM file)
WHERE parent_ok""",
)
def import_depends_on(spark: SparkSession, folder: str) -> DataFrame:
    return code_index(spark, folder).edges.filter(F.col("kind") == "DEPENDS_ON").select(
        "repository_id", "file_path", F.col("line").cast("bigint").alias("line"), "source_name",
        "target_qualified_name",
        F.col("metadata")["resolution_confidence"].alias("confidence"),
        F.col("metadata")["import_entity_id"].alias("import_entity_id"),
    )


@query(
    "alias_map",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, binding, absolute FROM good,
  LATERAL (SELECT * FROM (VALUES ('os', 'os'), ('Base', 'pkg.m' || parent || '.C' || parent),
    ('sibling', 'pkg.m' || parent), ('m' || parent, 'pkg.m' || parent),
    ('C' || parent, 'pkg.m' || parent || '.C' || parent)) v(binding, absolute))""",
)
def alias_map(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.alias_map(code_index(spark, folder).references).drop("revision")


@query(
    "unresolved_symbols",
    CODE
    + """
SELECT DISTINCT repo AS repository_id, name AS qualified_name,
  'symbol:' || kind || ':' || sha256(repo || '|' || kind || '|' || name) AS id
FROM (SELECT repo, kind, name FROM file, (VALUES ('function', 'os.path.join'), ('function', 'str'),
        ('function', 'fetch'), ('function', 'KeyError'), ('class', 'sibling.Mixin')) v(kind, name)
  UNION ALL SELECT repo, 'class', 'Base' FROM file WHERE NOT parent_ok
  UNION ALL SELECT repo, 'function', 'Base.run' FROM file WHERE NOT parent_ok
  UNION ALL SELECT repo, 'function', 'helper_' || parent FROM file WHERE NOT parent_ok
  UNION ALL SELECT repo, 'function', 'size_' || next FROM file WHERE NOT next_ok)""",
)
def unresolved_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.unresolved_symbols(code_index(spark, folder).edges)


# name, signature, bases, methods, parameters, calls, awaits, returns, raises, control flow,
# explanation; lists are joined with "; "
_ANALYSES = [
    (
        "C{id}", "class", "class C{id}(Base, sibling.Mixin)", "Base; sibling.Mixin", "run; step", "",
        "Base.run; KeyError; cached; compute; fetch; helper_{id}; os.path.join; self.step; str",
        "fetch(a)", "Base.run(self, a); helper_{id}(a); self.step(a)", "KeyError(a)",
        "line {e+14}: if a > {size}; line {e+16}: for item in args; "
        "line {e+21}: try/except handles ValueError",
        "C{id} is a class with 2 directly declared methods and 2 base classes.",
    ),
    (
        "C{id}.run", "method", "def run(self, a, *args, flag, **kw)", "", "",
        "self; a; *args; flag; **kw", "Base.run; cached; os.path.join; self.step; str", "",
        "Base.run(self, a); self.step(a)", "",
        "line {e+14}: if a > {size}; line {e+16}: for item in args",
        "C{id}.run is a synchronous callable with 5 parameters and 5 distinct calls.",
    ),
    (
        "C{id}.step", "method", "async def step(self, a)", "", "", "self; a",
        "KeyError; fetch; helper_{id}", "fetch(a)", "helper_{id}(a)", "KeyError(a)",
        "line {e+21}: try/except handles ValueError",
        "C{id}.step is an asynchronous callable with 2 parameters and 3 distinct calls.",
    ),
    (
        "helper_{id}", "function", "def helper_{id}(x, gate)", "", "", "x; gate",
        "Depends; helper_{parent}; size_{next}", "", "helper_{parent}(x)", "",
        "line {e+29}: while x",
        "helper_{id} is a synchronous callable with 2 parameters and 3 distinct calls.",
    ),
    (
        "size_{size}", "function", "def size_{size}(y)", "", "", "y", "C{id}", "", "C{id}(y)", "", "",
        "size_{size} is a synchronous callable with 1 parameters and 1 distinct calls.",
    ),
]
_ANALYSIS_COLUMNS = [
    "local_name", "kind", "signature", "bases", "methods", "parameters", "calls", "awaits", "returns",
    "raises", "control_flow", "explanation",
]


def _joined_lists(analysed: DataFrame) -> DataFrame:
    lists = ["bases", "methods", "parameters", "calls", "awaits", "returns", "raises", "control_flow"]
    return analysed.withColumns({name: F.array_join(name, "; ") for name in lists})


@query(
    "fact_bounds",
    CODE
    + f"SELECT repo AS repository_id, path AS file_path, {', '.join(_ANALYSIS_COLUMNS)} "
    + f"FROM ({_rows(_ANALYSES, _ANALYSIS_COLUMNS)})",
)
def fact_bounds(spark: SparkSession, folder: str) -> DataFrame:
    analysed = code_index(spark, folder).analyses
    return _joined_lists(analysed).select("repository_id", "file_path", *_ANALYSIS_COLUMNS)


@query(
    "locate_entity",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, name, allowed,
  CASE WHEN broken OR NOT hit THEN 'not_found' ELSE 'found' END AS status,
  CASE WHEN NOT broken AND hit THEN local END AS local_name
FROM code, LATERAL (SELECT * FROM (VALUES
  ('run', 'any', true, 'C' || id || '.run'), ('C' || id || '.step', 'function', true, 'C' || id || '.step'),
  ('C' || id, 'class', true, 'C' || id), ('C' || id, 'function', false, NULL),
  ('nowhere', 'any', false, NULL)) v(name, allowed, hit, local))""",
)
def locate_entity(spark: SparkSession, folder: str) -> DataFrame:
    index = code_index(spark, folder)
    own = F.concat(F.lit("C"), F.regexp_extract("file_path", "m(\\d+)\\.py$", 1))
    asked = F.array(
        F.struct(F.lit("run").alias("name"), F.lit("any").alias("allowed")),
        F.struct(F.concat(own, F.lit(".step")).alias("name"), F.lit("function").alias("allowed")),
        F.struct(own.alias("name"), F.lit("class").alias("allowed")),
        F.struct(own.alias("name"), F.lit("function").alias("allowed")),
        F.struct(F.lit("nowhere").alias("name"), F.lit("any").alias("allowed")),
    )
    requests = index.files.select(
        "repository_id", "revision", "file_path", F.posexplode(asked).alias("n", "asked")
    ).select(
        F.concat_ws("/", "repository_id", "file_path", "n").alias("request_id"),
        "repository_id", "revision", "file_path", "asked.*",
    )
    return facts.locate(facts.definitions(index.facts), requests).select(
        "repository_id", "file_path", "name", "allowed", "status", "local_name"
    )


@query(
    "pattern_rows",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, kind, entity_name, rationale, line FROM good,
  LATERAL (SELECT * FROM (VALUES
    ('inheritance', 'C' || id, 'Inherits from Base, sibling.Mixin.', e + 7),
    ('decorator', 'C' || id, 'Uses decorator register.', e + 6),
    ('decorator', 'run', 'Uses decorator cached(limit).', e + 11),
    ('async_io', 'step', 'Declared with async def.', e + 20),
    ('dependency_injection', 'Depends', 'Constructs a FastAPI dependency marker.', e + 27))
    v(kind, entity_name, rationale, line))""",
)
def pattern_rows(spark: SparkSession, folder: str) -> DataFrame:
    return facts.patterns(code_index(spark, folder).facts).select(
        "repository_id", "file_path", "kind", "entity_name", "rationale",
        F.col("line").cast("bigint").alias("line"),
    )


@query(
    "pattern_counts",
    CODE
    + """
SELECT repo AS repository_id, kind, sum(n)::BIGINT AS patterns FROM good,
  (VALUES ('inheritance', 1), ('decorator', 2), ('async_io', 1), ('dependency_injection', 1)) v(kind, n)
GROUP BY ALL""",
)
def pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = facts.patterns(code_index(spark, folder).facts)
    return found.groupBy("repository_id", "kind").agg(F.count(F.lit(1)).alias("patterns"))


@query(
    "compare_pairs",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path,
  'Both entities are methods.' AS similarities,
  'Their parameter lists differ. Their implementations construct or call different collaborators: C'
    || id || '.run uniquely uses Base.run, cached, os.path.join, self.step, str, while C' || id
    || '.step uniquely uses KeyError, fetch, helper_' || id || '.' AS differences,
  'Compared C' || id || '.run with C' || id || '.step; found 1 similarity and 2 differences.' AS summary
FROM good""",
)
def compare_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The two methods of every class compared."""
    analysed = code_index(spark, folder).analyses
    key = F.struct(*[F.col(c) for c in facts.DEFINITION])
    pairs = (
        analysed.filter(F.col("kind") == "method")
        .groupBy("repository_id", "revision", "file_path")
        .agg(
            F.max(F.when(F.col("name") == "run", key)).alias("left"),
            F.max(F.when(F.col("name") == "step", key)).alias("right"),
        )
        .select(F.concat_ws(" ", "repository_id", "file_path").alias("pair_id"), "left", "right")
    )
    return facts.compare(analysed, pairs).select(
        F.substring_index("pair_id", " ", 1).alias("repository_id"),
        F.substring_index("pair_id", " ", -1).alias("file_path"),
        F.array_join("similarities", " ").alias("similarities"),
        F.array_join("differences", " ").alias("differences"),
        "summary",
    )


_SUMMARY = (
    "size_{size} is a synchronous callable with 1 parameters and 1 distinct calls. Signature: "
    "`def size_{size}(y)`. Key calls: C{id}. Return paths: C{id}(y). Purpose: Not unique: one per file "
    "of this length. Source: {path}:{e+33}-{e+38}."
)


@query(
    "entity_summary",
    CODE + f"SELECT repo AS repository_id, path AS file_path, {_expr(_SUMMARY)} AS summary FROM good",
)
def entity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summary text of the last function of every file."""
    analysed = code_index(spark, folder).analyses
    return analysed.filter(F.startswith("name", F.lit("size_"))).select(
        "repository_id", "file_path", responses.entity_summary().alias("summary")
    )


PATTERN_SECTION = """('Detected 2 decorators.' || chr(10) || '- decorator: C' || id
  || ' — Uses decorator register. (line ' || (e + 6) || ')' || chr(10)
  || '- decorator: run — Uses decorator cached(limit). (line ' || (e + 11) || ')')"""


@query(
    "pattern_text",
    CODE + f"SELECT repo AS repository_id, path AS file_path, {PATTERN_SECTION} AS section FROM good",
)
def pattern_text(spark: SparkSession, folder: str) -> DataFrame:
    found = facts.patterns(code_index(spark, folder).facts)
    return responses.pattern_text(found, ["repository_id", "file_path"], decorators_only=True)


DESIGN_SECTION = f"""({_expr(
    "Source-grounded core pattern observations:"
)} || chr(10) || chr(10) || {_expr(
    "1. **Inheritance-based framework extension:** C{id} Inherits from Base, sibling.Mixin. This lets "
    "FastAPI reuse Starlette's ASGI foundation while layering API-specific behavior on top. "
    "[{path}:{e+7}]"
)} || chr(10) || chr(10) || {_expr(
    "2. **Decorator-based API evolution:** C{id} Uses decorator register. Decorators attach lifecycle or "
    "compatibility policy without changing the wrapped callable's core role. [{path}:{e+6}]"
)} || chr(10) || chr(10) || {_expr(
    "3. **Asynchronous orchestration (execution model):** Async entry points include step "
    "[{path}:{e+20}]. This supports non-blocking ASGI request handling; it is an execution style "
    "rather than a Gang-of-Four design pattern."
)} || chr(10) || chr(10) || {_expr(
    "This is a conservative AST-based view of the selected core module, not an exhaustive claim about "
    "every architectural pattern in the repository."
)})"""


@query(
    "design_pattern_text",
    CODE
    + f"""SELECT repo AS repository_id, path AS file_path, length(section) AS characters, section
FROM (SELECT *, {DESIGN_SECTION} AS section FROM good)""",
)
def design_pattern_text(spark: SparkSession, folder: str) -> DataFrame:
    found = facts.patterns(code_index(spark, folder).facts)
    return responses.design_pattern_text(found, ["repository_id", "file_path"]).withColumn(
        "characters", F.length("section").cast("bigint")
    )


# Definitions of a file: kind, name, first and last line counted from the module docstring's end.
_DEFINITIONS = [
    ("class", "C{id}", 7, 25), ("method", "C{id}.run", 12, 18), ("method", "C{id}.step", 20, 25),
    ("function", "helper_{id}", 27, 31), ("function", "size_{size}", 33, 38),
]


def _body(kind: str, name: str, first: int, last: int) -> str:
    lines = "\n".join(CODE_TEMPLATE.split("\n")[first : last + 1])
    return (
        f"SELECT repo, path, '{kind}' AS kind, {_expr('{module}.' + name)} AS qualified_name, "
        f"{_expr(kind + ' {module}.' + name + chr(10) + 'File: {path}' + chr(10) + lines)} AS body FROM good"
    )


BODIES = " UNION ALL ".join(_body(*row) for row in _DEFINITIONS)


@query(
    "chunk_text",
    CODE
    + f"""
SELECT repo AS repository_id, path AS file_path, kind, qualified_name, length(body) AS characters,
       sha256(body) AS text_hash FROM ({BODIES})""",
)
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding text of every definition of each file."""
    index = code_index(spark, folder)
    return vectors.chunk_texts(index.entities_of(*vectors.SEARCHABLE_KINDS), index.files).select(
        "repository_id", "file_path", "kind", "qualified_name",
        F.length("text").cast("bigint").alias("characters"),
        F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "file_results",
    CODE
    + """
SELECT repo AS repository_id, path AS file_path, CASE WHEN broken THEN 0 ELSE 28 END::BIGINT AS entity_count,
  CASE WHEN broken THEN 0 ELSE 39 END::BIGINT AS relationship_count,
  CASE WHEN broken THEN 1 ELSE 0 END::BIGINT AS issue_count,
  CASE WHEN broken THEN 0 ELSE 5 END::BIGINT AS chunk_count FROM code""",
)
def file_results(spark: SparkSession, folder: str) -> DataFrame:
    index = code_index(spark, folder)
    return extract.file_results(
        index.files, index.entities, index.references, extract.parse_issues(index.facts), index.chunks
    ).drop("revision", "content_hash")


@query(
    "embed_chunks",
    CODE
    + f""", chunk AS ({BODIES}),
slot AS (SELECT repo, path, kind, qualified_name, ('0x' || substr(md5(token), 1, 4))::INTEGER % 64 AS slot, count(*) AS c
  FROM (SELECT *, unnest(regexp_extract_all(lower(body), '[a-z_][a-z0-9_]*|[0-9]+')) AS token FROM chunk) GROUP BY ALL)
SELECT repo AS repository_id, path AS file_path, kind, qualified_name, 64 AS dimension,
  string_agg(slot || ':' || CAST(round(100 * c / length) AS INTEGER), ',' ORDER BY slot) AS vector
FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY repo, path, kind, qualified_name)) AS length FROM slot) GROUP BY ALL""",
)
def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk vectors of the whole corpus: every slot in use with its value in hundredths."""
    slots = F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    shown = F.transform(
        F.filter(slots, lambda s: s["x"] > 0),
        lambda s: F.concat_ws(":", s["i"].cast("string"), F.round(s["x"] * 100).cast("int").cast("string")),
    )
    return code_index(spark, folder).chunks.select(
        "repository_id", "file_path", "kind", "qualified_name", F.size("embedding").alias("dimension"),
        F.array_join(shown, ",").alias("vector"),
    )
