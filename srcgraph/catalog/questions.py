"""Question analysis and answer assembly over order-made questions and whole conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.catalog.code import CODE
from srcgraph.catalog.shared import code_index
from srcgraph.operators import facts, questions, responses, textops
from srcgraph.session import dealt
from srcgraph.sources.adapters import _fill, table, text_files

_LIFE = (
    "FastAPI.__call__:concept_map APIRoute.get_route_handler:concept_map get_request_handler:concept_map "
    "solve_dependencies:concept_map run_endpoint_function:concept_map serialize_response:concept_map"
)
_VALID = (
    "get_request_handler:concept_map solve_dependencies:concept_map request_body_to_args:concept_map "
    "_validate_value_with_model_field:concept_map"
)
# Order priority and status -> question; then its intent, its mentions and its plan.
# {k} is the order key; CARRIED stands for what the session context supplies.
TEMPLATES = [
    ("1", "O", "Please re-index the tree for k{k}", "indexing", "Please:identifier", "index"),
    ("1", "F", "Compare `Part{k}` versus Supplier", "comparison", "Part{k}:backtick Supplier:identifier", "comparison"),
    ("1", "P", "Which design pattern does the Routing core use", "pattern_analysis", "APIRouter:concept_map", "patterns"),
    ("2", "O", "Explain the request lifecycle of a call", "architecture", _LIFE, "resolved"),
    ("2", "F", "Show the implementation of Widget{k}", "implementation", "Widget{k}:identifier", "implementation"),
    ("2", "P", "Where is Gadget_{k} and what is HTTP", "entity_lookup", "Gadget_{k}:identifier", "lookup"),
    ("3", "O", "what inherits from `Base.x{k}` and FASTAPI", "dependency_traversal",
     "Base.x{k}:backtick Base:identifier FastAPI:identifier", "traverse"),
    ("3", "F", "where is it defined", "entity_lookup", "CARRIED", "lookup|search"),
    ("3", "P", "How does dependency injection work with `Dep{k}`", "general", "Dep{k}:backtick", "resolved"),
    ("4", "O", "Tell how Alpha and Beta{k} meet Alpha", "general", "Tell:identifier Alpha:identifier Beta{k}:identifier", "discovery"),
    ("4", "F", "the end-to-end request path", "architecture", _LIFE, "resolved"),
    ("4", "P", "how does validate request work for k{k}", "general", _VALID, "resolved"),
    ("5", "O", "  do they matter ", "general", "CARRIED", "resolved|discovery"),
    ("5", "F", "plain words k{k}", "general", "", "discovery"),
    ("5", "P", "Python decorator in codebase", "pattern_analysis", "FastAPI:concept_map", "patterns"),
]


def _case(column: int) -> str:
    def value(text: str) -> str:
        quoted = "'" + text.replace("'", "''").replace("{k}", "' || o_orderkey || '") + "'"
        if text == "CARRIED":
            return "carried"
        if "|" in text and column == 5:
            yes, no = text.split("|")
            return f"CASE WHEN carried <> '' THEN '{yes}' ELSE '{no}' END"
        return quoted

    arms = " ".join(
        f"WHEN left(o_orderpriority, 1) = '{row[0]}' AND o_orderstatus = '{row[1]}' THEN {value(row[column])}"
        for row in TEMPLATES
    )
    return f"CASE {arms} END"


ASKED = f"""
WITH base AS (SELECT *, CASE
    WHEN o_totalprice > 200000 THEN 'C:conversation D:conversation R' || o_custkey || ':conversation'
    WHEN o_totalprice > 100000 THEN 'R' || o_custkey || ':conversation' ELSE '' END AS carried FROM orders),
asked AS (SELECT o_orderkey, {_case(2)} AS query, {_case(3)} AS intent, {_case(4)} AS mentions,
  {_case(5)} AS plan FROM base)
"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """One question per order with a session context that depends on its price."""
    priority = F.substring("o_orderpriority", 1, 1)
    text = None
    for digit, status, template, *_ in TEMPLATES:
        met = (priority == digit) & (F.col("o_orderstatus") == status)
        value = _fill(template, {"k": F.col("o_orderkey")})
        text = F.when(met, value) if text is None else text.when(met, value)
    nothing = F.array().cast("array<string>")
    price = F.col("o_totalprice")
    active = F.array(F.lit("A"), F.concat(F.lit("B"), "o_orderkey"), F.lit("C"), F.lit("D"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        text.alias("query"),
        F.when(price > 200_000, active).otherwise(nothing).alias("active_entities"),
        F.when(price > 100_000, F.array(F.concat(F.lit("R"), "o_custkey")))
        .otherwise(nothing)
        .alias("recalled_entities"),
    )


@query(
    "question_analysis",
    ASKED
    + """SELECT o_orderkey AS query_id, trim(query) AS query, intent, mentions, intent = 'indexing' AS needs_index,
  intent NOT IN ('indexing', 'pattern_analysis') AS needs_graph,
  intent NOT IN ('indexing', 'entity_lookup', 'dependency_traversal') AS needs_source,
  CASE WHEN mentions <> '' OR intent = 'indexing' THEN 0.0 ELSE 0.6 END::DOUBLE AS ambiguity FROM asked""",
)
def question_analysis(spark: SparkSession, folder: str) -> DataFrame:
    analysed = questions.analyse(asked(spark, folder))
    mentions = F.transform("entities", lambda e: F.concat_ws(":", e["name"], e["source"]))
    return analysed.select(
        "query_id", "query", "intent", F.array_join(mentions, " ").alias("mentions"), "needs_index",
        "needs_graph", "needs_source", "ambiguity",
    )


@query(
    "stages",
    ASKED
    + """, stage(plan, agent, operation, sequence) AS (VALUES
  ('index', 'indexer', 'index_repository', 0), ('lookup', 'graph', 'find_entity', 0),
  ('traverse', 'graph', 'find_entity', 0), ('traverse', 'graph', 'get_dependencies', 1),
  ('patterns', 'graph', 'find_entity', 0), ('patterns', 'repository', 'verify_source', 1),
  ('patterns', 'code_analyst', 'find_patterns', 2),
  ('implementation', 'graph', 'find_entity', 0), ('implementation', 'repository', 'verify_source', 1),
  ('implementation', 'code_analyst', 'explain_implementation', 2),
  ('comparison', 'graph', 'find_entity', 0), ('comparison', 'repository', 'verify_source', 1),
  ('comparison', 'code_analyst', 'compare_implementations', 2),
  ('discovery', 'graph', 'hybrid_search', 0), ('discovery', 'repository', 'verify_source', 1),
  ('discovery', 'code_analyst', 'explain_implementation', 2),
  ('resolved', 'graph', 'find_entity', 0), ('resolved', 'repository', 'verify_source', 1),
  ('resolved', 'code_analyst', 'explain_implementation', 2),
  ('search', 'graph', 'hybrid_search', 0), ('search', 'repository', 'verify_source', 1),
  ('search', 'code_analyst', 'explain_implementation', 2))
SELECT o_orderkey AS query_id, intent, agent, operation, sequence FROM asked JOIN stage USING (plan)""",
)
def stages(spark: SparkSession, folder: str) -> DataFrame:
    return questions.stages(questions.analyse(asked(spark, folder))).select(
        "query_id", "intent", "agent", "operation", "sequence"
    )


@query(
    "intents",
    """SELECT conv_id, turn, CASE
  WHEN regexp_matches(t, 'index repository|re-index|reindex|update index') THEN 'indexing'
  WHEN regexp_matches(t, 'compare|difference between|versus| vs ') THEN 'comparison'
  WHEN regexp_matches(t, 'design pattern|patterns|anti-pattern|decorator') THEN 'pattern_analysis'
  WHEN regexp_matches(t, 'lifecycle|architecture|end-to-end') THEN 'architecture'
  WHEN regexp_matches(t, 'implementation|source code|docstring|show code|explain code') THEN 'implementation'
  WHEN regexp_matches(t, 'inherit|depends|dependents|imports|calls|related') THEN 'dependency_traversal'
  WHEN regexp_matches(t, 'what is|find|where is|locate') THEN 'entity_lookup' ELSE 'general' END AS intent
  FROM (SELECT *, lower(text) AS t FROM conversations)""",
)
def intents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", questions.intent(F.col("text")).alias("intent")
    )


@query(
    "symbols",
    r"""WITH token AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS i
  FROM (SELECT conv_id, turn, string_split_regex(text, '[^\p{L}\p{N}_]+') AS w FROM conversations)),
found AS (SELECT conv_id, turn, word, min(i) AS i FROM token
  WHERE regexp_full_match(word, '[A-Z][A-Za-z0-9_]*')
    AND word NOT IN ('What', 'Where', 'How', 'Show', 'Find', 'Explain', 'Compare', 'Python', 'HTTP') GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(string_agg(word, ' ' ORDER BY i), '') AS symbols
FROM conversations c LEFT JOIN found f ON f.conv_id = c.conv_id AND f.turn = c.turn GROUP BY c.conv_id, c.turn""",
)
def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(questions.symbol_names(F.col("text")), " ").alias("symbols")
    )


@query(
    "followups",
    r"""SELECT conv_id, turn, len(list_intersect(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'),
    ['it', 'this', 'that', 'they', 'them'])) > 0 OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the (class|function)($|[^\p{L}\p{N}_])')
  AS refers_back FROM conversations""",
)
def followups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", questions.has_reference(F.col("text")).alias("refers_back")
    )


@query(
    "concepts",
    ASKED
    + """SELECT o_orderkey AS query_id,
  CASE WHEN contains(mentions, 'concept_map') THEN replace(mentions, ':concept_map', '')
       WHEN contains(query, 'dependency injection') THEN 'Depends get_dependant get_parameterless_sub_dependant solve_dependencies'
       ELSE '' END AS concepts FROM asked""",
)
def concepts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("query")
    return asked(spark, folder).select(
        "query_id",
        F.array_join(questions.concept_names(text, questions.intent(text)), " ").alias("concepts"),
    )


@query(
    "evidence_dedup",
    """SELECT user_id AS response_id, min(event_id) AS position, event_type AS kind, props AS excerpt
  FROM events GROUP BY user_id, event_type, props""",
)
def evidence_dedup(spark: SparkSession, folder: str) -> DataFrame:
    evidence = table(spark, folder, "events").select(
        F.col("user_id").alias("response_id"), F.col("event_id").alias("position"),
        F.col("event_type").alias("kind"), F.col("props").alias("excerpt"),
    )
    return responses.deduplicate_evidence(evidence)


@query(
    "excerpt_trim",
    r"""SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text
  ELSE regexp_replace(substr(text, 1, 3998), '\s+$', '') || ' …' END AS excerpt FROM documents""",
)
def excerpt_trim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", responses.trimmed_excerpt(F.col("text")).alias("excerpt")
    )


@query(
    "response_assembly",
    """WITH o AS (SELECT conv_id, turn, role, text, role <> 'system' AS success FROM conversations)
SELECT conv_id AS query_id,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (success AND text <> ''),
           'I could not gather repository evidence for: q' || conv_id) AS answer,
  (SELECT coalesce(string_agg(role, ',' ORDER BY t), '') FROM
     (SELECT role, min(turn) AS t FROM o i WHERE i.conv_id = o.conv_id AND success GROUP BY role)) AS agents_used,
  (SELECT string_agg(w, ',' ORDER BY t) FROM (SELECT w, min(t) AS t FROM (
     SELECT 'from ' || role AS w, turn * 2 AS t FROM o i WHERE i.conv_id = o.conv_id
     UNION ALL SELECT role || ': lost', turn * 2 + 1 FROM o i WHERE i.conv_id = o.conv_id AND NOT success) GROUP BY w)) AS warnings,
  bool_or(NOT success) OR NOT bool_or(success) AS partial
FROM o GROUP BY conv_id""",
)
def response_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as stage outputs of a conversation; system turns failed."""
    good = F.col("role") != "system"
    outputs = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit("q"), "conv_id").alias("query"),
        F.col("turn").alias("position"),
        F.col("role").alias("agent"),
        good.alias("success"),
        F.col("text").alias("section"),
        F.array(F.concat(F.lit("from "), "role")).alias("warnings"),
        F.when(~good, "lost").alias("error"),
    )
    return responses.assemble(outputs).withColumns(
        {name: F.array_join(name, ",") for name in ("agents_used", "warnings")}
    )


@query(
    "citations",
    """WITH a AS (SELECT doc_id, lang, replace(replace(text, '[', '('), ']', ')') AS body FROM documents)
SELECT doc_id AS response_id,
  CASE lang WHEN 'fr' THEN 'invalid' WHEN 'es' THEN 'malformed' ELSE 'ok' END AS status,
  CASE lang WHEN 'en' THEN body || ' [a.py:1-2] [graph: x -> y] [a.py:1-2].'
    WHEN 'de' THEN regexp_replace(body, '\\s+$', '') || chr(10) || chr(10)
      || 'Sources: [a.py:1-2] [graph entity: unknown]' END AS resolved_answer
FROM a""".replace("\\\\", "\\"),
)
def citations(spark: SparkSession, folder: str) -> DataFrame:
    """English answers cite well, German ones declare without marking, the others are wrong."""
    language = F.col("lang")
    body = F.replace(F.replace(F.col("text"), F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    tail = (
        F.when(language == "en", " [E1] [2] [1].")
        .when(language == "fr", " [E4]")
        .when(language == "es", " [Ex]")
        .otherwise("")
    )
    used = F.when(language == "de", F.array(F.lit(3), F.lit(1))).otherwise(
        F.array(F.lit(1), F.lit(2))
    )

    def evidence(path, graph, entity):
        return responses.citation_label(
            F.struct(
                F.lit(path).cast("string").alias("file_path"), F.lit(1).alias("start_line"),
                F.lit(2).alias("end_line"), graph.cast("array<string>").alias("graph_path"),
                F.lit(entity).cast("string").alias("entity_id"),
            )
        )

    labels = F.array(
        evidence("a.py", F.array(), None),
        evidence(None, F.array(F.lit("x"), F.lit("y")), "e"),
        evidence(None, F.array(), None),
    )
    answers = table(spark, folder, "documents").select(
        F.col("doc_id").alias("response_id"), F.concat(body, tail).alias("answer"), used.alias("used"),
        labels.alias("labels"),
    )
    return responses.resolve_citations(answers).select("response_id", "status", "resolved_answer")


@query(
    "relation_text",
    """SELECT o_custkey AS query_id, 'Graph relationships:' || chr(10)
    || string_agg('- Order' || o_orderkey || ' DEPENDS_ON Customer' || o_custkey, chr(10) ORDER BY o_orderkey) AS section
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
  WHERE rank <= 10 GROUP BY o_custkey""",
)
def relation_text(spark: SparkSession, folder: str) -> DataFrame:
    relations = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"),
        F.concat(F.lit("Order"), "o_orderkey").alias("source_name"),
        F.lit("DEPENDS_ON").alias("kind"),
        F.concat(F.lit("Customer"), "o_custkey").alias("target_name"),
    )
    return responses.relation_text(relations)


@query(
    "location_text",
    """SELECT l_orderkey AS query_id, 'Resolved: ' || string_agg('part.' || l_partkey || ' (class) at s' || l_suppkey
    || '.py:' || l_linenumber || '-' || (l_linenumber + 5), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) || '.' AS section
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
  WHERE rank <= 3 GROUP BY l_orderkey""",
)
def location_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    hits = (
        dealt(lines, ["l_orderkey"], lines.count())
        .distinct()
        .select(
            F.col("l_orderkey").alias("query_id"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"),
            F.concat(F.lit("part."), "l_partkey").alias("qualified_name"),
            F.lit("class").alias("kind"),
            F.concat(F.lit("s"), "l_suppkey", F.lit(".py")).alias("file_path"),
            F.col("l_linenumber").alias("start_line"),
            (F.col("l_linenumber") + 5).alias("end_line"),
        )
    )
    return responses.location_text(hits)


@query(
    "evidence_prompt",
    """SELECT conv_id AS response_id, string_agg('E' || n || chr(10) || 'kind: ' || role || chr(10) || 'location: '
    || CASE WHEN role = 'user' THEN '[c' || conv_id || '.py:' || turn || '-' || (turn + 1) || ']' ELSE '[graph: p0 -> p1 -> p2 -> p3 -> p4 -> p5 -> p6 -> p7 -> p8 -> p9 -> p10 -> p11 -> p12]' END
    || chr(10) || 'entity_id: ' || CASE WHEN role = 'user' THEN '' ELSE 'e' || turn END || chr(10)
    || 'graph_path: ' || CASE WHEN role = 'user' THEN '' ELSE 'p0 -> p1 -> p2 -> p3 -> p4 -> p5 -> p6 -> p7 -> p8 -> p9 -> p10 -> p11' END
    || chr(10) || 'excerpt:' || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY turn) AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""",
)
def evidence_prompt(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("role") == "user"
    path = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.concat(F.lit("p"), i))
    evidence = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("response_id"),
        F.col("turn").alias("position"),
        F.col("role").alias("kind"),
        F.when(user, F.concat(F.lit("c"), "conv_id", F.lit(".py"))).alias("file_path"),
        F.col("turn").alias("start_line"),
        (F.col("turn") + 1).alias("end_line"),
        F.when(~user, F.concat(F.lit("e"), "turn")).alias("entity_id"),
        F.when(user, F.array().cast("array<string>")).otherwise(path).alias("graph_path"),
        F.col("text").alias("excerpt"),
    )
    return responses.evidence_prompt(evidence)


_STAGE_NAMES = [
    "FastAPI.__call__", "APIRoute.get_route_handler", "get_request_handler", "solve_dependencies",
    "run_endpoint_function",
]


@query(
    "stage_trace",
    """WITH last AS (SELECT o_custkey, left(o_orderpriority, 1)::INTEGER AS stage, max(o_orderkey) AS k FROM orders GROUP BY ALL),
titled AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY stage) AS n,
  ['ASGI entry', 'Matched route handler', 'Request handling', 'Dependency resolution', 'Endpoint invocation'][stage] AS title FROM last)
SELECT o_custkey AS query_id, string_agg(n || '. ' || title || ' f' || k || '.py:' || k || '-' || (k + 1), ' | ' ORDER BY n) AS trace
FROM titled GROUP BY o_custkey""",
)
def stage_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Priority n names the n-th stage; numbers, titles and sources of each customer's trace."""
    stage = F.substring("o_orderpriority", 1, 1).cast("int")
    names = F.array(*[F.lit(name) for name in _STAGE_NAMES])
    analyses = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderkey").alias("position"),
        F.element_at(names, stage).alias("name"),
        F.concat(F.lit("x."), F.element_at(names, stage)).alias("qualified_name"),
        F.concat(F.lit("f"), "o_orderkey", F.lit(".py")).alias("file_path"),
        F.col("o_orderkey").alias("start_line"),
        (F.col("o_orderkey") + 1).alias("end_line"),
    )
    entry = r"(\d+\. \*\*[^:*]+:\*\* [^\n]*\[[^\]\n]+\])"
    found = F.regexp_extract_all("answer", F.lit(entry), F.lit(1))
    short = F.transform(
        found, lambda e: F.regexp_replace(e, r"^(\d+\.) \*\*([^:*]+):\*\* .*\[([^\]]+)\]$", "$1 $2 $3")
    )
    return responses.stage_trace(analyses).select("query_id", F.array_join(short, " | ").alias("trace"))


@query(
    "provenance_enrich",
    """WITH known AS (SELECT o_custkey, o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS p FROM orders
    WHERE left(o_orderpriority, 1) <> '5' GROUP BY ALL)
SELECT o_orderkey, coalesce(CASE WHEN left(o_orderpriority, 1) = '1' THEN 'own' END, p) AS snapshot
FROM orders LEFT JOIN known USING (o_custkey, o_orderstatus)""",
)
def provenance_enrich(spark: SparkSession, folder: str) -> DataFrame:
    scoped = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("repository_id"),
        F.col("o_orderstatus").alias("revision"),
        "o_orderkey",
        "o_orderpriority",
    )
    first = F.substring("o_orderpriority", 1, 1)
    evidence = scoped.withColumn("snapshot", F.when(first == "1", "own"))
    hits = scoped.withColumn("snapshot", F.when(first != "5", F.col("o_orderpriority"))).withColumn(
        "position", F.col("o_orderkey")
    )
    return responses.enrich_provenance(evidence, hits).select("o_orderkey", "snapshot")


@query(
    "verified_hits",
    """SELECT query_id, file_path, CASE WHEN there THEN sha256(text) END AS verified_hash,
  CASE WHEN there THEN 1 + length(text) - length(replace(text, chr(10), '')) - (right(text, 1) = chr(10))::INT END AS last_line
FROM (SELECT *, lang || '/' || source AS query_id, lang || '/' || doc_id || CASE WHEN coalesce(toxic, 0) = 0 THEN '.txt' ELSE '.gone' END AS file_path,
    coalesce(toxic, 0) = 0 AS there, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k
  FROM documents LEFT JOIN labels USING (doc_id)) WHERE k <= 6""",
)
def verified_hits(spark: SparkSession, folder: str) -> DataFrame:
    """First six documents per language and source looked up; toxic ones under a lost path."""
    documents = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    suffix = F.when(F.col("toxic") == 1, ".gone").otherwise(".txt")
    hits = documents.select(
        F.concat_ws("/", "lang", "source").alias("query_id"),
        F.col("doc_id").alias("position"),
        F.col("source").alias("repository_id"),
        F.lit("r1").alias("revision"),
        F.concat("lang", F.lit("/"), "doc_id", suffix).alias("file_path"),
    )
    return responses.verified_hits(hits, textops.file_extents(text_files(spark, folder))).select(
        "query_id", "file_path", "verified_hash", F.col("last_line").cast("bigint").alias("last_line")
    )


@query(
    "analysed_hits",
    CODE
    + """
SELECT repo || '/' || path AS query_id, CASE WHEN broken THEN '' ELSE 'C' || id
    || ' is a class with 2 directly declared methods and 2 base classes.|C' || id
    || '.run is a synchronous callable with 5 parameters and 5 distinct calls.' END AS analyses,
  CASE WHEN broken THEN 'Source entity was not found|Source entity was not found|' ELSE '' END
    || 'Source entity was not found' AS warnings, broken AS failed FROM code""",
)
def analysed_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Class, method and an unknown name asked of every file."""
    index = code_index(spark, folder)
    own = F.concat(F.lit("C"), F.regexp_extract("file_path", "m(\\d+)\\.py$", 1))
    names = F.array(own, F.lit("run"), F.lit("nowhere"))
    requests = index.files.select(
        F.concat_ws("/", "repository_id", "file_path").alias("query_id"),
        "repository_id", "revision", "file_path", F.posexplode(names).alias("position", "name"),
    ).withColumn("request_id", F.concat_ws("#", "query_id", "position")).withColumn("allowed", F.lit("any"))
    located = facts.locate(facts.definitions(index.facts), requests)
    return responses.analysed_hits(located, index.analyses).select(
        "query_id", F.array_join("analyses", "|").alias("analyses"),
        F.array_join("warnings", "|").alias("warnings"), "failed",
    )
