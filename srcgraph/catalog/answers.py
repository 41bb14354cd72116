"""Whole questions answered from the code index, and scans of stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.catalog.code import CODE, DESIGN_SECTION, PATTERN_SECTION, RESOLUTION, _expr
from srcgraph.catalog.incremental import manifest
from srcgraph.catalog.retrieval import _chunks
from srcgraph.catalog.shared import code_index
from srcgraph.operators import vectors
from srcgraph.plans import answer as answering
from srcgraph.session import cut_lineage
from srcgraph.sources import corpus
from srcgraph.sources.adapters import table

_ANSWER = (
    "C{id} is a class with 2 directly declared methods and 2 base classes. Signature: "
    "`class C{id}(Base, sibling.Mixin)`. Bases: Base, sibling.Mixin. Key methods: run, step. Key calls: "
    "Base.run, KeyError, cached, compute, fetch, helper_{id}, os.path.join, self.step, str. Awaited "
    "operations: fetch(a). Control flow: line {e+14}: if a > {size}; line {e+16}: for item in args; line "
    "{e+21}: try/except handles ValueError. Return paths: Base.run(self, a); helper_{id}(a); "
    "self.step(a). Explicit raises: KeyError(a). Purpose: Class {id}. Source: {path}:{e+7}-{e+25}."
)
_FOUND = _expr("Resolved: {module}.C{id} (class) at {path}:{e+7}-{e+25}.")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every file, by name, asked of the file's repository."""
    name = F.concat(F.lit("C"), F.regexp_extract("file_path", "m(\\d+)\\.py$", 1))
    return code_index(spark, folder).files.select(
        F.concat_ws("/", "repository_id", "file_path").alias("query_id"),
        F.concat(F.lit("Show the implementation of `"), name, F.lit("`")).alias("query"),
        "repository_id",
        "revision",
    )


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answered once per session, like the other tables of the index."""
    index = code_index(spark, folder)
    if "answers" not in vars(index):
        index.answers = cut_lineage(answering.answer(_asked(spark, folder), index))
    return index.answers


@query(
    "answers",
    CODE
    + f"""
SELECT repo || '/' || path AS query_id, 'implementation' AS intent, broken AS partial,
  CASE WHEN broken THEN 'No matching graph entity was found.'
    ELSE {_FOUND} || chr(10) || chr(10) || {_expr(_ANSWER)} END AS answer,
  CASE WHEN broken THEN 'graph' ELSE 'graph,repository,code_analyst' END AS agents_used,
  CASE WHEN broken THEN 'repository: A prior graph entity result is required for source verification'
    ELSE '' END AS warnings FROM code""",
)
def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One question per file through every stage: lookup, verification, analysis, assembly."""
    return _answers(spark, folder).select(
        "query_id", "intent", "partial", "answer", F.array_join("agents_used", ",").alias("agents_used"),
        F.array_join("warnings", ",").alias("warnings"),
    )


# Question forms: everything of a file is asked by name; the parent is the class it inherits from.
_FORMS = {
    "index": ("Please reindex C", "id", ""),
    "lookup": ("Where is `C", "id", "`"),
    "outgoing": ("What calls does `helper_", "id", "` make"),
    "incoming": ("What depends on `C", "id", "`"),
    "design": ("Which design pattern does `C", "id", "` use"),
    "decorators": ("Which decorator does `C", "id", "` use"),
    "resolved": ("Tell me about `C", "id", "`"),
    "comparison": ("Compare `C", "id", "` versus `C", "parent", "`"),
}
_NONE = "'No matching graph entity was found.'"
_UNSEEN = "'repository: A prior graph entity result is required for source verification'"
_GAP = " || chr(10) || chr(10) || "
_PARENT_FOUND = _expr("pkg.m{parent}.C{parent} (class) at pkg/m{parent}.py:{pe+7}-{pe+25}")
_OWN_FOUND = _expr("{module}.C{id} (class) at {path}:{e+7}-{e+25}")
_PARENT_ANSWER = _expr(
    _ANSWER.replace("{size}", "{psize}").replace("{path}", "pkg/m{parent}.py").replace("{id}", "{parent}").replace("{e+", "{pe+")
)
_COMPARED = _expr(
    "Compared C{id} with C{parent}; found 3 similarities and 2 differences.\n"
    "Similarities: Both entities are classs. Shared decorators: register. "
    "They expose the same named parameter interface.\n"
    "Differences: Their implementations construct or call different collaborators: C{id} uniquely uses helper_{id}, "
    "while C{parent} uniquely uses helper_{parent}. Their documented roles differ: C{id} — Class {id}; C{parent} — "
    "Class {parent}."
)
_WALKS = f"""
, edge AS (SELECT DISTINCT repo, kind, source, target FROM (
    SELECT repository_id AS repo, kind, source_name AS source, target_qualified_name AS target FROM ({RESOLUTION}) WHERE resolved
    UNION ALL SELECT repo, 'IMPORTS', module, module || '.__import__.' || (e + k) || '.0' FROM good, range(1, 5) AS r(k)
    UNION ALL SELECT repo, 'IMPORTS', module || '.helper_' || id, module || '.helper_' || id || '.__import__.' || (e + 28) || '.0' FROM good
    UNION ALL SELECT repo, 'DEPENDS_ON', module, 'pkg.m' || parent || suffix FROM file, LATERAL (VALUES (''), ('.C' || parent)) v(suffix)
    WHERE parent_ok)),
step AS (SELECT 'outgoing' AS form, source AS near, target AS far, * FROM edge
  UNION ALL SELECT 'incoming', target, source, * FROM edge),
n0 AS (SELECT repo, id, 'outgoing' AS form, module || '.helper_' || id AS node, 1 AS depth FROM good
  UNION ALL SELECT repo, id, 'incoming', module || '.C' || id, 1 FROM good),
n1 AS (SELECT DISTINCT repo, id, form, far AS node, 2 AS depth FROM n0 JOIN step USING (repo, form) WHERE near = node),
n2 AS (SELECT DISTINCT repo, id, form, far AS node, 3 AS depth FROM n1 JOIN step USING (repo, form) WHERE near = node),
near_node AS (SELECT repo, id, form, node, min(depth) AS depth
  FROM (FROM n0 UNION ALL FROM n1 UNION ALL FROM n2) GROUP BY ALL),
walked AS (SELECT repo, id, form, string_agg('- ' || source || ' ' || kind || ' ' || target, chr(10) ORDER BY place) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, id, form ORDER BY depth, source, kind, target) AS place
    FROM near_node JOIN step USING (repo, form) WHERE near = node) WHERE place <= 10 GROUP BY ALL)
"""


def _form_sql(form: str, answer: str, agents: str, partial: str = "broken", warnings: str = f"CASE WHEN broken THEN {_UNSEEN} ELSE '' END") -> str:
    return (
        f"SELECT repo, path, '{form}' AS form, {answer} AS answer, {agents} AS agents_used, {partial} AS partial, "
        f"{warnings} AS warnings FROM asked"
    )


def _plans_sql() -> str:
    """What each question form must be answered with, from the documents alone."""

    def seen(section: str) -> str:
        return f"CASE WHEN broken THEN {_NONE} ELSE {_FOUND}{_GAP}{section} END"

    source = "CASE WHEN broken THEN 'graph' ELSE 'graph,repository,code_analyst' END"
    walk = "CASE WHEN broken THEN 'graph: A prior graph entity result is required' ELSE '' END"
    at = {"incoming": _FOUND, "outgoing": _expr("Resolved: {module}.helper_{id} (function) at {path}:{e+27}-{e+31}.")}

    def walked(form: str) -> str:
        section = f"coalesce('Graph relationships:' || chr(10) || {form}_lines, 'No matching graph relationships were found.')"
        return f"CASE WHEN broken THEN {_NONE} ELSE {at[form]}{_GAP}{section} END"

    both, one = "NOT broken AND other_ok", "NOT broken OR parent_good"
    shown = f"CASE WHEN NOT broken AND (other_ok OR NOT parent_good OR parent = id) THEN {_OWN_FOUND} || CASE WHEN other_ok THEN '; ' ELSE '' END ELSE '' END"
    named = f"'Resolved: ' || {shown} || CASE WHEN parent_good AND parent <> id THEN {_PARENT_FOUND} ELSE '' END || '.'"
    compared = f"{named} || CASE WHEN {both} THEN {_GAP[4:]}{_COMPARED} || chr(10) || {_expr(_ANSWER)} || chr(10) || {_PARENT_ANSWER} ELSE '' END"
    selects = [
        _form_sql(
            "index", "'I could not gather repository evidence for: Please reindex C' || id", "''", "true",
            "'indexer: Indexer routing requires an explicit repository path from the gateway'",
        ),
        _form_sql("lookup", f"CASE WHEN broken THEN {_NONE} ELSE {_FOUND} END", "'graph'", "false", "''"),
        _form_sql("outgoing", walked("outgoing"), "'graph'", warnings=walk),
        _form_sql("incoming", walked("incoming"), "'graph'", warnings=walk),
        _form_sql("design", seen(DESIGN_SECTION), source),
        _form_sql("decorators", seen(PATTERN_SECTION), source),
        _form_sql("resolved", seen(_expr(_ANSWER)), source),
        _form_sql(
            "comparison", f"CASE WHEN {one} THEN {compared} ELSE {_NONE} END",
            f"CASE WHEN {both} THEN 'graph,repository,code_analyst' WHEN {one} THEN 'graph,repository' ELSE 'graph' END",
            f"NOT ({both})",
            f"CASE WHEN {both} THEN '' WHEN {one} THEN 'code_analyst: Two resolved graph entities are required for comparison' "
            f"ELSE {_UNSEEN} END",
        ),
    ]
    asked = """, asked AS (SELECT c.*, p.e AS pe, p.size AS psize, p.id IS NOT NULL AS parent_good,
    NOT c.broken AND p.id IS NOT NULL AND p.id <> c.id AS other_ok, o.lines AS outgoing_lines, i.lines AS incoming_lines
  FROM code c LEFT JOIN good p ON p.repo = c.repo AND p.id = c.parent
  LEFT JOIN walked o ON o.repo = c.repo AND o.id = c.id AND o.form = 'outgoing'
  LEFT JOIN walked i ON i.repo = c.repo AND i.id = c.id AND i.form = 'incoming')
"""
    return CODE + _WALKS + asked + " UNION ALL ".join(selects)


@query("answer_plans", _plans_sql())
def answer_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Eight questions per file, one for each plan that names what it asks for, dependencies both ways."""
    number = F.regexp_extract("file_path", "m(\\d+)\\.py$", 1)
    values = {"id": number, "parent": F.expr("cast(regexp_extract(file_path, 'm([0-9]+)[.]py$', 1) AS bigint) div 2").cast("string")}

    def spoken(form: tuple) -> Column:
        return F.concat(*[values[part] if part in values else F.lit(part) for part in form])

    forms = F.array(*[F.struct(F.lit(name).alias("form"), spoken(parts).alias("query")) for name, parts in _FORMS.items()])
    asked = code_index(spark, folder).files.select(
        "repository_id", "revision", "file_path", F.explode(forms).alias("asked")
    ).select(
        F.concat_ws("/", "repository_id", "file_path", "asked.form").alias("query_id"), "asked.query", "repository_id", "revision"
    )
    made = answering.answer(asked, code_index(spark, folder))
    return made.select(
        F.col("repository_id").alias("repo"), F.regexp_extract("query_id", "/(.+)/", 1).alias("path"),
        F.substring_index("query_id", "/", -1).alias("form"), "answer",
        F.array_join("agents_used", ",").alias("agents_used"), "partial", F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "turn_log",
    CODE
    + f""", said AS (SELECT repo, id, broken, 'Show the implementation of `C' || id || '`' AS query,
    CASE WHEN broken THEN 'No matching graph entity was found.'
      ELSE {_FOUND} || chr(10) || chr(10) || {_expr(_ANSWER)} END AS answer FROM code)
SELECT 'user turn' AS log, repo AS session_id, sha256(query) AS query_hash, 'C' || id AS names, false AS partial FROM said
UNION ALL SELECT 'assistant turn', repo, sha256(answer), 'C' || id, false FROM said
UNION ALL SELECT 'audit', repo, sha256(query), 'graph,repository,code_analyst', broken FROM said
UNION ALL SELECT 'episode', repo, sha256(query), 'C' || id, broken FROM said
UNION ALL SELECT 'episode answer', repo, sha256(answer), 'C' || id, broken FROM said""",
)
def turn_log(spark: SparkSession, folder: str) -> DataFrame:
    """State rows that the answered questions leave: turns of both roles, audits, episodes."""
    asked = _asked(spark, folder).withColumns(
        {
            "session_id": F.col("repository_id"),
            "user_id": F.col("repository_id"),
            "turn": F.lit(1),
            "asked_at": F.lit(datetime(2024, 1, 1)),
            "response_detail": F.lit("balanced"),
            "code_examples": F.lit("never"),
        }
    )
    log = answering.turn_log(asked, _answers(spark, folder))

    def rows(name, frame: DataFrame, session, digest, names, partial) -> DataFrame:
        return frame.select(
            name.alias("log"), session.alias("session_id"), digest.alias("query_hash"),
            names.alias("names"), partial.alias("partial"),
        )

    names = F.array_join("entities", ",")
    session = F.col("session_id")
    parts = [
        rows(F.concat("role", F.lit(" turn")), log["turns"], session, F.sha2("content", 256), names, F.lit(False)),
        rows(F.lit("audit"), log["audits"], session, F.col("query_hash"), F.array_join("planned_agents", ","), F.col("partial")),
        rows(F.lit("episode"), log["episodes"], F.col("user_id"), F.sha2("query", 256), names, F.col("partial")),
        rows(F.lit("episode answer"), log["episodes"], F.col("user_id"), F.sha2("answer", 256), names, F.col("partial")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "vector_scroll",
    """SELECT label::VARCHAR AS repository_id, printf('v%08d', vec_id) AS entity_id, len(embedding) AS dimension
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def vector_scroll(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of the files whose label is not toxic."""
    chunks = _chunks(spark, folder).withColumn("file_path", F.col("vec_id").cast("string"))
    wanted = table(spark, folder, "labels").filter("toxic = 0").select("doc_id")
    files = chunks.join(wanted, chunks["vec_id"] == wanted["doc_id"], "left_semi")
    return vectors.file_vectors(chunks, files).select(
        "repository_id", "entity_id", F.size("embedding").cast("bigint").alias("dimension")
    )


@query(
    "manifest_scan",
    """SELECT source AS repository_id, lang || '/' || doc_id || '.txt' AS file_path, sha256(text) AS content_hash
  FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries of every repository that holds a toxic file."""
    toxic = table(spark, folder, "labels").filter("toxic = 1")
    wanted = table(spark, folder, "documents").join(toxic, "doc_id", "left_semi").select(
        F.col("source").alias("repository_id")
    )
    return corpus.manifest_entries(manifest(spark, folder), wanted).select(
        "repository_id", "file_path", "content_hash"
    )
