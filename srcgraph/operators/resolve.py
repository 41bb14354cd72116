"""Symbol resolution: join unresolved references to the definitions they name.

What a file says about its own names is settled when it is parsed. The rest takes one N:1 join against an
index that keeps one row per name, so a name used or defined a million times never multiplies rows; it
spreads its hot names (``lookup_join``). Edges that are resolved already are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import ids
from srcgraph.session import SCOPE, lookup_join, staged

FILE = [*SCOPE, "file_path"]
REFERENCE = [*FILE, "kind", "ord", "pos"]
CALLABLE = ["function", "method"]

# Fixed values: (priority, strategy, confidence) of each way to resolve a reference corpus-wide.
STRATEGIES = [
    (0, "instance_method", 0.95),
    (1, "import_alias", 1.0),
    (2, "qualified_name", 0.95),
    (3, "module_scope", 0.9),
    (4, "unique_repository_symbol", 0.75),
]


def distinct_entities(entities: DataFrame) -> DataFrame:
    """One row per (repository, revision, id); a redefinition later in the file wins."""
    columns = [c for c in entities.columns if c not in ("ord", *SCOPE, "id")]
    return (
        entities.groupBy(*SCOPE, "id")
        .agg(F.max_by(F.struct(*columns), F.col("ord")).alias("kept"))
        .select(*SCOPE, "id", "kept.*")
    )


def is_unresolved_reference() -> Column:
    return ~F.col("resolved") & F.col("kind").isin("CALLS", "INHERITS_FROM")


def local_resolution(edges: DataFrame) -> DataFrame:
    """Resolve calls and bases that name exactly one definition of their own file.

    The extraction pass has found the definition (see ``extract.settle``), so nothing is joined.
    """
    hit = is_unresolved_reference() & F.col("local_name").isNotNull()
    own = ids.entity_id(F.col("repository_id"), F.col("file_path"), F.col("local_kind"), F.col("local_name"))
    return edges.withColumns(
        {
            "target_id": F.when(hit, own).otherwise(F.col("target_id")),
            "target_qualified_name": F.when(hit, F.col("local_name")).otherwise(F.col("target_qualified_name")),
            "resolved": F.col("resolved") | hit,
        }
    ).drop("local_kind", "local_name")


def alias_map(edges: DataFrame) -> DataFrame:
    """Name bound by each import of a file -> what it stands for; the last import of a name wins."""
    imported, alias = F.col("imported"), F.col("alias")
    package = ids.package_of(F.col("module"), F.col("file_path"))
    head = F.substring_index(imported, ".", 1)
    binds_head = (F.col("level") == 0) & F.contains(imported, F.lit(".")) & alias.isNull()
    own = ids.last_name(F.regexp_replace(imported, "^\\.+", ""))
    named = F.when(alias != "", alias).otherwise(own)
    return (
        edges.filter(F.col("kind") == "IMPORTS")
        .select(
            *FILE,
            F.when(binds_head, head).otherwise(named).alias("binding"),
            F.when(binds_head, head)
            .otherwise(ids.absolute_import(imported, package))
            .alias("absolute"),
            "ord",
            "pos",
        )
        .groupBy(*FILE, "binding")
        .agg(F.max_by("absolute", F.struct("ord", "pos")).alias("absolute"))
    )


def name_index(entities: DataFrame) -> DataFrame:
    """One row per (repository, revision, space, name): how many definitions, and one of each sort.

    Space ``q`` is qualified names of all entities, space ``s`` simple names of classes, functions
    and methods. Names without any unique reading are left out; nothing can resolve to them.
    """
    kind = F.col("kind")
    definition = kind.isin("class", *CALLABLE)
    keys = F.array(F.struct(F.lit("q").alias("space"), F.col("qualified_name").alias("name_key")))
    with_simple = F.concat(
        keys, F.array(F.struct(F.lit("s").alias("space"), F.col("name").alias("name_key")))
    )
    # Ids are made again from these where a reference resolves: they are most of a row and hardly compress.
    target = F.struct(F.col("file_path"), F.col("kind"), F.col("qualified_name"))
    is_class = F.col("kind") == "class"
    return (
        entities.select(
            *SCOPE, "file_path", "kind", "qualified_name",
            F.explode(F.when(definition, with_simple).otherwise(keys)).alias("key"),
        )
        .select("*", "key.*")
        .groupBy(*SCOPE, "space", "name_key")
        .agg(
            F.count(F.lit(1)).alias("any_n"),
            F.min(target).alias("any_target"),
            F.count_if(is_class).alias("class_n"),
            F.min(F.when(is_class, target)).alias("class_target"),
            F.count_if(definition).alias("definition_n"),
            F.min(F.when(definition, target)).alias("definition_target"),
        )
        .filter((F.col("any_n") == 1) | (F.col("class_n") == 1) | (F.col("definition_n") == 1))
    )


def _id_of(target: str) -> Column:
    return ids.entity_id(F.col("repository_id"), F.col(f"{target}.file_path"), F.col(f"{target}.kind"), F.col(f"{target}.qualified_name"))


def _source_id() -> Column:
    """The scope that calls, inherits or imports."""
    return ids.entity_id(F.col("repository_id"), F.col("file_path"), F.col("source_kind"), F.col("source_name"))


def _corpus_candidates(unresolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every (priority, space, name) a reference may resolve through, one row each."""
    reference = F.col("target_qualified_name")
    first = F.substring_index(reference, ".", 1)
    dotted = F.contains(reference, F.lit("."))
    rest = F.regexp_replace(reference, "(?s)^[^.]*\\.", "")
    on_self = first.isin("self", "cls") & dotted & (F.col("source_kind") == "method")
    options = [
        ("q", F.when(on_self, F.concat_ws(".", ids.parent_name(F.col("source_name")), rest))),
        (
            "q",
            F.when(dotted, F.concat_ws(".", "absolute", rest)).otherwise(F.col("absolute")),
        ),
        ("q", reference),
        ("q", F.concat(F.col("module"), F.lit("."), reference)),
        ("s", F.when(~dotted, reference)),
    ]
    structs = [
        F.when(
            name.isNotNull() if priority != 1 else F.col("absolute").isNotNull(),
            F.struct(
                F.lit(priority).alias("priority"),
                F.lit(space).alias("space"),
                name.alias("name_key"),
            ),
        )
        for priority, (space, name) in enumerate(options)
    ]
    bound = unresolved.withColumn("binding", first).join(aliases, [*FILE, "binding"], "left")
    return bound.select(
        *REFERENCE, F.explode(F.array_compact(F.array(*structs))).alias("option")
    ).select(*REFERENCE, "option.*")


def corpus_resolution(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Resolve what is left across files; the first candidate with exactly one match wins.

    ``index`` is the ``name_index`` of the entities.
    """
    unresolved = edges.filter(is_unresolved_reference())
    is_base = F.col("kind") == "INHERITS_FROM"
    strategy = F.lit(None).cast("string")
    confidence = F.lit(None).cast("string")
    for priority, label, value in STRATEGIES:
        strategy = F.when(F.col("found.priority") == priority, F.lit(label)).otherwise(strategy)
        confidence = F.when(F.col("found.priority") == priority, F.lit(str(value))).otherwise(
            confidence
        )
    found = (
        lookup_join(
            staged(_corpus_candidates(unresolved, alias_map(edges))), index,
            [*SCOPE, "space", "name_key"], ["file_path", "ord", "pos"],
        )
        .withColumn(
            "target",
            F.when(is_base & (F.col("class_n") == 1), F.col("class_target")).when(
                ~is_base & (F.col("definition_n") == 1), F.col("definition_target")
            ),
        )
        .filter(F.col("target").isNotNull())
        .groupBy(*REFERENCE)
        .agg(F.min(F.struct("priority", "target")).alias("found"))
    )
    hit = F.col("found").isNotNull()
    extra = F.map_from_arrays(
        F.array(*[F.lit(f"resolution_{part}") for part in ("scope", "strategy", "confidence")]),
        F.array(F.lit("repository"), strategy, confidence),
    )
    symbol = ids.symbol_id(
        F.col("repository_id"), F.when(is_base, "class").otherwise("function"), F.col("target_qualified_name")
    )
    corpus_wide = (
        unresolved.drop("source_id", "target_id")
        .join(found, REFERENCE, "left")
        .withColumn("source_id", _source_id())
        .withColumn("target_id", F.when(hit, _id_of("found.target")).otherwise(symbol))
        .withColumn(
            "target_qualified_name",
            F.when(hit, F.col("found.target.qualified_name")).otherwise(
                F.col("target_qualified_name")
            ),
        )
        .withColumn("resolved", F.col("resolved") | hit)
        .withColumn("metadata", F.when(hit, F.map_concat("metadata", extra)).otherwise(F.col("metadata")))
        .drop("found")
    )
    return edges.filter(~is_unresolved_reference()).unionByName(corpus_wide)


def import_dependencies(edges: DataFrame, index: DataFrame) -> DataFrame:
    """DEPENDS_ON rows for imports whose absolute name belongs to exactly one entity.

    The package is taken from the importing scope, so a relative import inside a function or class
    counts one level deeper than at module level.
    """
    package = ids.package_of(F.col("source_name"), F.col("file_path"))
    wanted = (
        edges.filter(F.col("kind") == "IMPORTS")
        .drop("source_id", "target_id")
        .withColumn("space", F.lit("q"))
        .withColumn("name_key", ids.absolute_import(F.col("imported"), package))
    )
    imported = ids.entity_id(F.col("repository_id"), F.col("file_path"), F.lit("import"), F.col("target_qualified_name"))
    unique = (
        index.filter((F.col("space") == "q") & (F.col("any_n") == 1))
        .select(*SCOPE, "space", "name_key", "any_target")
    )
    metadata = F.map_from_arrays(
        F.array(
            *[F.lit(f"resolution_{part}") for part in ("scope", "strategy", "confidence")],
            F.lit("import_entity_id"),
        ),
        F.array(F.lit("repository"), F.lit("cross_file_import"), F.lit("1.0"), imported),
    )
    return (
        lookup_join(wanted, unique, [*SCOPE, "space", "name_key"], ["file_path", "ord", "pos"])
        .withColumn("metadata", F.map_concat("metadata", metadata))
        .withColumn("kind", F.lit("DEPENDS_ON"))
        .withColumn("source_id", _source_id())
        .withColumn("target_id", _id_of("any_target"))
        .withColumn("target_qualified_name", F.col("any_target.qualified_name"))
        .select(*edges.columns)
    )


def resolve(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Local pass, corpus pass, import dependencies; ``entities`` has one row per id.

    ``edges`` are read several times and should be stored; the index and the candidates of the corpus pass
    are staged here.
    """
    local = local_resolution(edges)
    index = staged(name_index(entities))
    return corpus_resolution(local, index).unionByName(import_dependencies(local, index))


def unresolved_symbols(edges: DataFrame) -> DataFrame:
    """External symbols: the distinct targets no definition was found for."""
    return (
        edges.filter(~F.col("resolved"))
        .select("repository_id", F.col("target_id").alias("id"), F.col("target_qualified_name").alias("qualified_name"))
        .distinct()
    )

