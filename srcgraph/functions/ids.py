"""Identity rules: hashes, entity ids, module names and import targets as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL name space of RFC 4122, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def entity_id(repository: Column, path: Column, kind: Column, qualified_name: Column) -> Column:
    """Stable across revisions and line moves: only repository, path, kind and name count."""
    return F.concat(
        kind, F.lit(":"), F.sha2(F.concat_ws("|", repository, path, kind, qualified_name), 256)
    )


def symbol_id(repository: Column, kind: Column, name: Column) -> Column:
    """Id of a name that has no definition in the corpus."""
    return F.concat(
        F.lit("symbol:"), kind, F.lit(":"), F.sha2(F.concat_ws("|", repository, kind, name), 256)
    )


def revision_id(repository: Column, revision: Column) -> Column:
    return F.concat_ws(":", repository, revision)


def vector_id(repository: Column, revision: Column, entity: Column) -> Column:
    """Name-based UUID (version 5) of ``repository:revision:entity``."""
    name = F.concat_ws(":", repository, revision, entity)
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def module_name(path: Column) -> Column:
    """Dotted import name of a file; a package's ``__init__`` stands for the package."""
    without_suffix = F.regexp_replace(path, "(?<=[^/])\\.[^./]+$", "")
    parts = F.filter(F.split(without_suffix, "/"), lambda part: ~part.isin("", "."))
    kept = F.when(
        F.try_element_at(parts, F.lit(-1)) == "__init__", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)
    return F.array_join(kept, ".")


def parent_name(dotted: Column) -> Column:
    """Everything before the last dot, empty without one."""
    return F.regexp_extract(dotted, "^(.*)\\.[^.]*$", 1)


def last_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def joined(prefix: Column, name: Column) -> Column:
    """Dotted concatenation that leaves out an empty prefix."""
    return F.when(prefix == "", name).otherwise(F.concat_ws(".", prefix, name))


def package_of(module: Column, path: Column) -> Column:
    """Package against which relative imports count: the module itself for ``__init__.py``."""
    return F.when(path.rlike("(^|/)__init__\\.py$"), module).otherwise(parent_name(module))


def absolute_import(imported: Column, package: Column) -> Column:
    """Resolve leading dots: n dots drop n - 1 trailing parts of the package."""
    level = F.length(F.regexp_extract(imported, "^(\\.*)", 1))
    remainder = F.regexp_replace(imported, "^\\.+", "")
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(
        F.split(package, "\\.")
    )
    keep = F.greatest(F.lit(0), F.size(parts) - level + 1)
    retained = F.slice(parts, F.lit(1), F.least(keep, F.size(parts)))
    tail = F.when(remainder == "", F.array().cast("array<string>")).otherwise(F.array(remainder))
    return F.when(level == 0, imported).otherwise(F.array_join(F.concat(retained, tail), "."))


def safe_relative(path: Column) -> Column:
    """True unless the path is absolute or climbs with ``..``."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
