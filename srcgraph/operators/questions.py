"""Question analysis for a whole table of questions: intent, symbols, concepts, flags, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text

_MENTIONS = "array<struct<name:string,source:string>>"


def intent(question: Column) -> Column:
    """First rule with a phrase in the question; ``question`` may be in any case."""
    lowered = F.lower(question)
    chosen = F.lit(rules.DEFAULT_INTENT)
    for name, phrases in reversed(rules.INTENT_PHRASES):
        chosen = F.when(text.contains_any(lowered, phrases), F.lit(name)).otherwise(chosen)
    return chosen


def has_reference(question: Column) -> Column:
    return F.lower(question).rlike(rules.REFERENCE_WORDS)


def asks_incoming(question: Column) -> Column:
    """Whether a dependency question asks for what depends on the entity, not for what it depends on."""
    return F.lower(question).rlike(rules.INCOMING_WORDS)


def _names(found: Column) -> Column:
    """Drop stop words, normalise the framework's name, keep first occurrences."""
    kept = F.filter(found, lambda name: ~name.isin(*rules.STOP_WORDS))
    framework = F.lit(rules.FRAMEWORK_NAME)
    return F.array_distinct(
        F.transform(
            kept, lambda name: F.when(F.lower(name) == F.lower(framework), framework).otherwise(name)
        )
    )


def quoted_names(question: Column) -> Column:
    return _names(F.regexp_extract_all(question, F.lit("`([^`]+)`"), F.lit(1)))


def symbol_names(question: Column) -> Column:
    """Names in back-ticks, then capitalised identifiers, each once."""
    capitalised = _names(
        F.regexp_extract_all(question, F.lit("(?U)\\b([A-Z][A-Za-z0-9_]*)\\b"), F.lit(1))
    )
    return F.array_union(quoted_names(question), capitalised)


def concept_names(question: Column, intent_name: Column) -> Column:
    """Symbols of the first concept the question names; empty without one."""
    lowered = F.lower(question)
    chosen = F.array().cast("array<string>")
    for needed, phrases, names in reversed(rules.CONCEPTS):
        met = text.contains_any(lowered, phrases)
        if needed is not None:
            met = met & (intent_name == needed)
        chosen = F.when(met, F.array(*[F.lit(n) for n in names])).otherwise(chosen)
    return chosen


def _mentions(names: Column, source: Column | str) -> Column:
    label = F.lit(source) if isinstance(source, str) else source
    return F.transform(names, lambda name: F.struct(name.alias("name"), label.alias("source")))


def analyse(questions: DataFrame) -> DataFrame:
    """Add intent, entities, flags and ambiguity to questions (query_id, query, ...).

    Optional array columns active_entities and recalled_entities hold the session context: a
    question that names nothing but refers back takes the last three of them.
    """
    for column in ("active_entities", "recalled_entities"):
        if column not in questions.columns:
            questions = questions.withColumn(column, F.array().cast("array<string>"))
    query = F.col("query")
    quoted = F.size("quoted") > 0
    own = F.concat(
        _mentions(F.col("quoted"), "backtick"),
        _mentions(F.array_except("symbols", "quoted"), "identifier"),
    )
    remembered = F.concat("active_entities", "recalled_entities")
    last = F.slice(remembered, F.greatest(F.size(remembered) - 2, F.lit(1)), F.lit(3))
    carried = _mentions(last, "conversation")
    entities = (
        F.when((F.size("concepts") > 0) & ~quoted, _mentions(F.col("concepts"), "concept_map"))
        .when(F.size("symbols") > 0, own)
        .when(has_reference(query), carried)
        .otherwise(F.array().cast(_MENTIONS))
    )
    name = F.col("intent")
    return (
        questions.withColumn("query", text.strip(query))
        .withColumn("intent", intent(query))
        .withColumn("quoted", quoted_names(query))
        .withColumn("symbols", symbol_names(query))
        .withColumn("concepts", concept_names(query, name))
        .withColumn("entities", entities)
        .withColumn("needs_index", name == "indexing")
        .withColumn("needs_graph", ~name.isin("indexing", "pattern_analysis"))
        .withColumn(
            "needs_source", ~name.isin("indexing", "entity_lookup", "dependency_traversal")
        )
        .withColumn(
            "ambiguity",
            F.when((F.size("entities") > 0) | F.col("needs_index"), F.lit(0.0)).otherwise(0.6),
        )
        .drop("quoted", "symbols", "concepts")
    )


def plan_name(intent_name: Column, entities: Column) -> Column:
    """Which stage list answers a question."""
    named = F.size(entities) > 0
    discovered = F.forall(entities, lambda entity: entity["source"] == "identifier")
    broad = intent_name.isin("general", "architecture")
    return (
        F.when(intent_name == "indexing", F.lit("index"))
        .when((intent_name == "entity_lookup") & named, F.lit("lookup"))
        .when((intent_name == "dependency_traversal") & named, F.lit("traverse"))
        .when(intent_name == "pattern_analysis", F.lit("patterns"))
        .when(intent_name == "implementation", F.lit("implementation"))
        .when(intent_name == "comparison", F.lit("comparison"))
        .when(broad & discovered, F.lit("discovery"))
        .when(named, F.lit("resolved"))
        .otherwise(F.lit("search"))
    )


def planned_agents(plan: Column) -> Column:
    """Agents of a plan's stages in order, each once."""
    chosen = None
    for name, rows in rules.STAGES.items():
        value = F.array(*[F.lit(agent) for agent in dict.fromkeys(row[0] for row in rows)])
        chosen = F.when(plan == name, value) if chosen is None else chosen.when(plan == name, value)
    return F.coalesce(chosen, F.array().cast("array<string>"))


def stages(analysed: DataFrame) -> DataFrame:
    """One row per (question, stage) from the fixed stage lists."""
    plan = plan_name(F.col("intent"), F.col("entities"))

    def row(stage: tuple) -> Column:
        agent, operation, sequence, reason, depends = stage
        return F.struct(
            F.lit(agent).alias("agent"),
            F.lit(operation).alias("operation"),
            F.lit(sequence).alias("sequence"),
            F.lit(reason).alias("reason"),
            F.lit(depends).alias("depends_on"),
        )

    chosen = None
    for name, rows in rules.STAGES.items():
        value = F.array(*[row(stage) for stage in rows])
        chosen = F.when(plan == name, value) if chosen is None else chosen.when(plan == name, value)
    return analysed.select("query_id", "intent", F.explode(chosen).alias("stage")).select(
        "query_id", "intent", "stage.*"
    )
