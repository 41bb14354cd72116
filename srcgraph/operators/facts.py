"""Structural analysis from syntax facts: entity analyses, location, patterns, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text
from srcgraph.operators.extract import DEFINITION_TAGS
from srcgraph.session import SCOPE, lookup_join, top_per

FILE = [*SCOPE, "file_path"]
DEFINITION = [*FILE, "definition"]
# How much of each fact list an analysis keeps.
EXPRESSIONS, DECISIONS, SNIPPET_LINES = 12, 16, 40


def definitions(facts: DataFrame) -> DataFrame:
    """Classes and functions with their in-file name; ``definition`` numbers them in the file."""
    return facts.filter(F.col("tag").isin(*DEFINITION_TAGS)).select(
        *FILE,
        F.col("ord").alias("definition"),
        F.col("owner"),
        "tag",
        "name",
        F.concat_ws(".", F.array_join("scope", "."), F.when(F.size("scope") > 0, F.col("name")))
        .alias("_nested"),
        F.when(F.size("scope") == 0, F.col("name"))
        .otherwise(F.concat_ws(".", F.array_join("scope", "."), "name"))
        .alias("local_name"),
        F.when(F.col("tag") == "class", "class")
        .when(F.col("scope_kind") == "class", "method")
        .otherwise("function")
        .alias("kind"),
        "line",
        "end_line",
        "direct",
        "chain",
    ).drop("_nested")


def _first_texts(facts: DataFrame, limit: int) -> DataFrame:
    """First distinct texts per (definition, tag) in breadth-first order.

    Distinct texts are found with a combining aggregation, then ranked; only ``limit`` rows per
    list are ever gathered.
    """
    distinct = facts.groupBy(*DEFINITION, "tag", "text").agg(F.min("bfs").alias("at"))
    kept = top_per(distinct, [*DEFINITION, "tag"], [F.col("at")], limit)
    return kept.groupBy(*DEFINITION, "tag").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda row: row["text"]
        ).alias("texts")
    )


def _decisions(facts: DataFrame) -> DataFrame:
    """First ``DECISIONS`` control-flow texts per definition by line, then text."""
    described = facts.filter(F.col("tag") == "flow").withColumn(
        "text", F.concat(F.lit("line "), "line", F.lit(": "), "text")
    )
    kept = top_per(described, DEFINITION, [F.col("line"), F.col("text")], DECISIONS)
    return kept.groupBy(*DEFINITION).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda row: row["text"]
        ).alias("control_flow")
    )


def _own_lists(facts: DataFrame) -> DataFrame:
    """Bases, decorators, parameters and docstring that hang directly on a definition."""
    rendered = (
        F.when((F.col("tag") == "param") & (F.col("text") == "var_positional"), F.concat(F.lit("*"), "name"))
        .when((F.col("tag") == "param") & (F.col("text") == "var_keyword"), F.concat(F.lit("**"), "name"))
        .when(F.col("tag") == "param", F.col("name"))
        .otherwise(F.col("text"))
    )

    def ordered(tag: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("tag") == tag, F.struct("pos", "value"))))
        return F.transform(rows, lambda row: row["value"])

    return (
        facts.filter(F.col("tag").isin("base", "decorator", "param", "doc") & (F.col("ord") > 0))
        .select(*FILE, F.col("ord").alias("definition"), "tag", "pos", rendered.alias("value"))
        .groupBy(*DEFINITION)
        .agg(
            ordered("base").alias("bases"),
            ordered("decorator").alias("decorators"),
            ordered("param").alias("parameters"),
            F.max(F.when(F.col("tag") == "doc", F.col("value"))).alias("docstring"),
        )
    )


def _methods(defined: DataFrame) -> DataFrame:
    """Names of the functions declared directly in each class body, in source order."""
    return (
        defined.filter((F.col("tag") != "class") & F.col("direct") & (F.col("kind") == "method"))
        .groupBy(*FILE, F.col("owner").alias("definition"))
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("definition", "name"))), lambda row: row["name"]
            ).alias("methods")
        )
    )


def analyses(facts: DataFrame) -> DataFrame:
    """One structural analysis per class, function and method of the corpus.

    Behaviour facts count for every definition they lie in, so they are exploded over the
    enclosing definitions (nesting depth, not corpus size) before they are aggregated.
    """
    defined = definitions(facts)
    inside = facts.filter(
        F.col("tag").isin("call", "await", "return", "raise", "flow") & (F.size("within") > 0)
    ).select(*FILE, F.explode("within").alias("definition"), "tag", "text", "line", "bfs")
    bounded = (
        _first_texts(inside.filter(F.col("tag").isin("await", "return", "raise")), EXPRESSIONS)
        .groupBy(*DEFINITION)
        .agg(
            *[
                F.max(F.when(F.col("tag") == tag, F.col("texts"))).alias(f"{tag}s")
                for tag in ("await", "return", "raise")
            ]
        )
    )
    calls = (
        inside.filter(F.col("tag") == "call")
        .groupBy(*DEFINITION)
        .agg(F.sort_array(F.collect_set("text")).alias("calls"))
    )
    empty = F.array().cast("array<string>")
    lists = ["bases", "decorators", "parameters", "methods", "calls", "awaits", "returns", "raises",
             "control_flow"]
    joined = defined
    for part in (_own_lists(facts), _methods(defined), calls, bounded, _decisions(inside)):
        joined = joined.join(part, DEFINITION, "left")
    joined = joined.withColumns({name: F.coalesce(name, empty) for name in lists})
    is_class = F.col("tag") == "class"
    keyword = F.when(F.col("tag") == "async_def", "async def").otherwise("def")
    class_head = F.concat(
        F.lit("class "),
        "name",
        F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")")))
        .otherwise(F.lit("")),
    )
    function_head = F.concat(
        keyword, F.lit(" "), "name", F.lit("("), F.array_join("parameters", ", "), F.lit(")")
    )
    class_text = F.concat(
        "local_name", F.lit(" is a class with "), F.size("methods"),
        F.lit(" directly declared methods and "), F.size("bases"), F.lit(" "),
        text.plural(F.size("bases"), "base class", "base classes"), F.lit("."),
    )
    function_text = F.concat(
        "local_name", F.lit(" is "),
        F.when(F.col("tag") == "async_def", "an asynchronous").otherwise("a synchronous"),
        F.lit(" callable with "), F.size("parameters"), F.lit(" parameters and "),
        F.size("calls"), F.lit(" distinct calls."),
    )
    return joined.withColumn("signature", F.when(is_class, class_head).otherwise(function_head)).withColumn(
        "explanation", F.when(is_class, class_text).otherwise(function_text)
    ).withColumn(
        "snippet_end", F.least(F.col("end_line"), F.col("line") + F.lit(SNIPPET_LINES - 1))
    )


def locate(defined: DataFrame, requests: DataFrame) -> DataFrame:
    """Find definitions by simple or in-file name: found, missing or ambiguous per request.

    ``defined``: rows of ``definitions`` or of stored ``analyses``. ``requests``: request_id, FILE, name,
    allowed (``class``, ``function`` or ``any``). Only definitions nested directly in one another can be named. Many requests may ask for one name, so
    they are spread by request.
    """
    # A top-level definition has one name, a nested one two.
    named = defined.filter("chain").select(
        *FILE, F.explode(F.array_distinct(F.array("name", "local_name"))).alias("name"),
        "definition", "kind", "local_name", "tag",
    )
    fits = (
        (F.col("allowed") == "any")
        | ((F.col("allowed") == "class") & (F.col("tag") == "class"))
        | ((F.col("allowed") == "function") & (F.col("tag") != "class"))
    )
    hits = (
        lookup_join(requests, named, [*FILE, "name"], ["request_id"])
        .filter(fits)
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.min(F.struct("definition", "local_name", F.col("kind").alias("found_kind"))).alias("hit"),
        )
    )
    matches = F.coalesce("matches", F.lit(0))
    status = (
        F.when(matches == 0, "not_found").when(matches == 1, "found").otherwise("ambiguous")
    )
    return (
        requests.join(hits, "request_id", "left")
        .withColumn("status", status)
        .withColumn("hit", F.when(F.col("status") == "found", F.col("hit")))
        .select(*requests.columns, "status", "hit.*")
    )


def patterns(facts: DataFrame) -> DataFrame:
    """Observed patterns per file: inheritance, decorators, async functions, injected dependencies.

    ``position`` (breadth-first place, then part) is the order within a file.
    """
    tag = F.col("tag")
    base_lists = (
        facts.filter(tag == "base")
        .groupBy(*FILE, "ord")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda row: row["text"]
            ).alias("bases")
        )
    )
    inherits = (
        facts.filter(tag == "class")
        .join(base_lists, [*FILE, "ord"])
        .select(
            *FILE, F.lit("inheritance").alias("kind"), F.col("name").alias("entity_name"),
            F.concat(F.lit("Inherits from "), F.array_join("bases", ", "), F.lit(".")).alias("rationale"),
            "line", "bfs", F.lit(0).alias("part"), F.lit(0).alias("pos"),
        )
    )
    injected = (tag == "call") & F.endswith("text", F.lit("Depends"))
    kind = (
        F.when(tag == "decorator", "decorator")
        .when(tag == "async_def", "async_io")
        .otherwise("dependency_injection")
    )
    entity = F.when(tag == "decorator", F.get("scope", F.size("scope") - 1)).when(
        tag == "async_def", F.col("name")
    ).otherwise(F.col("text"))
    rationale = (
        F.when(tag == "decorator", F.concat(F.lit("Uses decorator "), "text", F.lit(".")))
        .when(tag == "async_def", F.lit("Declared with async def."))
        .otherwise(F.lit(rules.DEPENDENCY_RATIONALE))
    )
    part = F.when(tag == "decorator", 1).when(tag == "async_def", 2).otherwise(3)
    others = facts.filter(tag.isin("decorator", "async_def") | injected).select(
        *FILE, kind.alias("kind"), entity.alias("entity_name"), rationale.alias("rationale"),
        "line", "bfs", part.alias("part"), F.coalesce("pos", F.lit(0)).alias("pos"),
    )
    found = inherits.unionByName(others)
    return found.withColumn("position", F.struct("bfs", "part", "pos")).drop("bfs", "part", "pos")


def first_paragraph(docstring: Column) -> Column:
    """First paragraph of a docstring on one line; empty without one."""
    body = text.strip(F.coalesce(docstring, F.lit("")))
    return text.collapse_space(F.get(F.split(body, "\n\n", 2), F.lit(0)))


def compare(analysed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarities, differences and a summary for each pair of definitions.

    ``pairs``: pair_id and the keys of both sides as structs ``left`` and ``right`` (DEFINITION
    columns). Each side joins on its key, so a pair costs two lookups.
    """
    row = F.struct(*[c for c in analysed.columns if c not in SCOPE])

    def side(name: str) -> DataFrame:
        keys = [F.col(k).alias(f"{name}_{k}") for k in DEFINITION]
        return analysed.select(*keys, row.alias(f"{name}_entity"))

    joined = pairs
    for name in ("left", "right"):
        joined = joined.withColumns({f"{name}_{k}": F.col(f"{name}.{k}") for k in DEFINITION}).join(
            side(name), [f"{name}_{k}" for k in DEFINITION]
        )
    left, right = F.col("left_entity"), F.col("right_entity")
    shared = F.array_sort(F.array_intersect(left["decorators"], right["decorators"]))
    only_left = F.array_sort(F.array_except(left["calls"], right["calls"]))
    only_right = F.array_sort(F.array_except(right["calls"], left["calls"]))
    purposes = [first_paragraph(e["docstring"]) for e in (left, right)]

    def listed(values: Column) -> Column:
        return F.when(F.size(values) == 0, F.lit("none")).otherwise(F.array_join(values, ", "))

    def role(entity: Column, purpose: Column) -> Column:
        return F.concat(entity["local_name"], F.lit(" — "), F.regexp_replace(purpose, "\\.+$", ""))

    same_kind = left["kind"] == right["kind"]
    same_parameters = left["parameters"] == right["parameters"]
    similarities = [
        F.when(same_kind, F.concat(F.lit("Both entities are "), left["kind"], F.lit("s."))),
        F.when(F.size(shared) > 0, F.concat(F.lit("Shared decorators: "), F.array_join(shared, ", "), F.lit("."))),
        F.when(same_parameters, F.lit("They expose the same named parameter interface.")),
    ]
    differences = [
        F.when(
            ~same_kind,
            F.concat(F.lit("Kinds differ: "), left["kind"], F.lit(" versus "), right["kind"], F.lit(".")),
        ),
        F.when(~same_parameters, F.lit("Their parameter lists differ.")),
        F.when(left["bases"] != right["bases"], F.lit("Their base classes differ.")),
        F.when(left["methods"] != right["methods"], F.lit("Their declared method sets differ.")),
        F.when(
            (F.size(only_left) > 0) | (F.size(only_right) > 0),
            F.concat(
                F.lit("Their implementations construct or call different collaborators: "),
                left["local_name"], F.lit(" uniquely uses "), listed(only_left), F.lit(", while "),
                right["local_name"], F.lit(" uniquely uses "), listed(only_right), F.lit("."),
            ),
        ),
        F.when(
            (purposes[0] != "") & (purposes[1] != "") & (purposes[0] != purposes[1]),
            F.concat(
                F.lit("Their documented roles differ: "), role(left, purposes[0]), F.lit("; "),
                role(right, purposes[1]), F.lit("."),
            ),
        ),
    ]
    same, other = F.size("similarities"), F.size("differences")
    summary = F.concat(
        F.lit("Compared "), left["local_name"], F.lit(" with "), right["local_name"],
        F.lit("; found "), same, F.lit(" "), text.plural(same, "similarity", "similarities"),
        F.lit(" and "), other, F.lit(" "), text.plural(other, "difference", "differences"),
        F.lit("."),
    )
    return (
        joined.withColumn("similarities", F.array_compact(F.array(*similarities)))
        .withColumn("differences", F.array_compact(F.array(*differences)))
        .withColumn("summary", summary)
        .select("pair_id", "left_entity", "right_entity", "similarities", "differences", "summary")
    )
