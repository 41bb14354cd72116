"""License scans: sparse TF-IDF cosine to templates, then the nearest licensed ancestor directory.

Passages are the lines of a file and its whole text. A passage is a sparse vector over its terms; a
term's weight is its count times log((1 + lines) / (1 + lines with the term)) + 1, counted over all
lines of all files. Terms of no template weigh like a term never seen. A file's own license is the
template most like one of its passages, at ``THRESHOLD`` or more. A file without one takes that of the
nearest directory above it whose license file has one.

Version numbers carry no weight but decide what a passage can be: one that names license versions is
not like a template of another version, however alike the words.

Passages that cannot reach the threshold, by a bound that needs no weights, are dropped where they are
read; template weights, whose number is fixed here, are broadcast. Directories, not files, are joined to their ancestors.

Defined results: null and empty texts have no license of their own but inherit; a null path is in no
directory; equal likeness goes to the license that sorts first, and equal license files to the path
that sorts first; repeated rows are answered each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm.common import let, table, whole
from srcgraph.session import cut_lineage

THRESHOLD = 0.6
LICENSE_NAMES = r"(?i)^(un)?licen[cs]e(\.\w+)?$|^copying(\.\w+)?$|^notice(\.\w+)?$"

#: License notices in their usual wording.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright, CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words too common to tell a license.
COMMON = (
    "a all an and are as at be by can for found from has have in into is it its of on or that the this to under use was with v "
    "0 1 2 3 4 5 10"
).split()
_NOT_TERM = "[^a-z0-9]+"
#: What marks a version named by a passage among its terms; no term starts so.
_VERSION = "="


def _terms(text):
    return F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != "")


def _template_terms() -> list[str]:
    found = {t for _, text in TEMPLATES for t in re.split(_NOT_TERM, text.lower()) if t}
    return sorted(found - set(COMMON))


def _version_pattern() -> str:
    """A version number beside a template term on its line, as in "version 2", "GPL-2.0", "GPLv2" or "License, v. 2.0"."""
    before = "|".join(sorted(_template_terms() + ["by", "v"], key=lambda t: (-len(t), t)))
    return rf"(?<![a-z0-9])(?:{before})(?:[ \t,:(/_.-]+|(?=v))(?:v\.?[ \t]*|version[ \t]*)?([0-9]{{1,2}}(?:\.[0-9]+)*)(?![a-z0-9])"


_TRAILING = r"(\.0)+$"


def _template_version(notice: str) -> str | None:
    found = re.search(_version_pattern(), notice.lower())
    return found and _VERSION + re.sub(_TRAILING, "", found[1])


def _versions(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(_version_pattern()), F.lit(1))
    return F.transform(found, lambda v: F.concat(F.lit(_VERSION), F.regexp_replace(v, _TRAILING, "")))


def _idf(lines: int, df: int) -> float:
    return math.log((1 + lines) / (1 + df)) + 1


def _can_reach(line: Column, known: list[str]) -> Column:
    """False where a passage cannot reach the threshold whatever the weights are.

    No term weighs more than one of no template. So the part of the squared length that lies in
    template terms is at most V / (V + others), with V the sum of their squared counts; the likeness
    is at most its root.
    """
    def part(terms: Column) -> Column:
        mine = F.filter(terms, lambda t: t.isin(known))
        squares = F.aggregate(
            F.array_distinct(mine), F.lit(0), lambda sum_, t: sum_ + F.power(F.size(F.filter(mine, lambda u: u == t)), 2).cast("int")
        )
        return squares * (1 - THRESHOLD**2) >= (F.size(terms) - F.size(mine)) * THRESHOLD**2 - 1e-9

    telling = F.exists(_terms(line), lambda t: t.isin(known))
    return telling & let(F.filter(_terms(line), lambda t: ~t.isin(COMMON)), part)


def own_licenses(files: DataFrame) -> DataFrame:
    """(file, license, score): the best template of each file that reaches the threshold; ``files`` has file and text."""
    spark = files.sparkSession
    known = _template_terms()
    text = whole("text")
    each = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    lines = files.select("file", F.inline(each)).filter(F.trim("line") != "")
    # Every line counts once under the empty term: that is their number.
    told = F.array_append(F.array_distinct(F.filter(_terms(F.col("line")), lambda t: t.isin(known))), F.lit(""))
    counts = {r["term"]: r["count"] for r in lines.select(F.explode(told).alias("term")).groupBy("term").count().collect()}  # a row per template term
    total = counts.get("", 0)
    weights = spark.createDataFrame([(t, _idf(total, counts.get(t, 0))) for t in known], "term string, idf double")
    notices = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, notice string")
    counted = notices.select("template", "license", F.explode(_terms(F.col("notice"))).alias("term")).filter(~F.col("term").isin(COMMON))
    vectors = counted.groupBy("template", "license", "term").agg(F.count("*").alias("tf")).join(F.broadcast(weights), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    versions = spark.createDataFrame([(k, _template_version(text)) for k, (_, text) in enumerate(TEMPLATES)], "template int, version string")
    vectors = (
        vectors.join(norms, "template").join(versions, "template")
        .select("template", "license", "version", "term", (F.col("w") / F.col("norm")).alias("w"))
    )

    passages = lines.union(files.select("file", F.lit(-1).alias("at"), text.alias("line"))).filter(_can_reach(F.col("line"), known))
    terms = (
        passages.select("file", "at", F.explode(F.concat(_terms(F.col("line")), _versions(F.col("line")))).alias("term"))
        .filter(~F.col("term").isin(COMMON))
        .groupBy("file", "at", "term")
        .agg(F.count("*").alias("tf"))
    )
    is_version = F.startswith("term", F.lit(_VERSION))
    weight = F.when(is_version, 0.0).otherwise(F.col("tf") * F.coalesce(F.col("idf"), F.lit(_idf(total, 0))))
    weighted = cut_lineage(terms.join(F.broadcast(weights), "term", "left").select("file", "at", "term", weight.alias("w")))
    lengths = weighted.groupBy("file", "at").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.collect_set(F.when(is_version, F.col("term"))).alias("named")
    )
    products = (
        weighted.withColumnRenamed("w", "mine")
        .join(F.broadcast(vectors), "term")
        .groupBy("file", "at", "template", "license", "version")
        .agg(F.sum(F.col("mine") * F.col("w")).alias("product"))
    )
    fits = F.col("version").isNull() | (F.size("named") == 0) | F.array_contains("named", F.col("version"))
    scored = products.join(lengths, ["file", "at"]).filter(fits).select("file", "license", F.round(F.col("product") / F.col("length"), 6).alias("score"))
    best = scored.filter(F.col("score") >= THRESHOLD).groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select("file", "best.license", (-F.col("best.minus")).alias("score"))


def _directory(path):
    """The path without its last part; null for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame) -> DataFrame:
    """(file, path, license, score, origin): origin is the path of the license file, the file's own path, or null."""
    own = own_licenses(files).withColumnsRenamed({"file": "_file"})
    marked = files.select("file", "path").join(own, F.col("file") == F.col("_file"), "left").drop("_file")
    directory = _directory(F.col("path"))
    rooted = marked.withColumn("directory", F.coalesce(directory, F.lit("")))
    holders = (
        rooted.filter(F.col("license").isNotNull() & F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_NAMES))
        .groupBy("directory")
        .agg(F.min(F.struct("path", "license", "score")).alias("holder"))
        .withColumnRenamed("directory", "above")
    )
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    nearest = (
        rooted.filter("path IS NOT NULL").select("directory").distinct()
        .select("directory", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))), ancestors)))
        .join(holders, "above")
        .groupBy("directory")
        .agg(F.max_by("holder", "depth").alias("holder"))
        .withColumnRenamed("directory", "_directory")
    )
    inherits = F.col("license").isNull() & F.col("path").isNotNull()
    return rooted.join(nearest, inherits & (F.col("directory") == F.col("_directory")), "left").select(
        "file", "path", F.coalesce("license", "holder.license").alias("license"),
        F.coalesce("score", "holder.score").alias("score"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("holder.path")).alias("origin"),
    )


#: The corpus as a tree of files: every eighth document is the license file of its directory of eight,
#: every 64th that of the directory of 64 above it.
_PATH = (
    "coalesce(source, 'none') || '/' || floor(doc_id / 64) || CASE WHEN doc_id % 64 = 0 THEN '/LICENSE' WHEN doc_id % 8 = 0 THEN '/' || floor(doc_id / 8) || '/LICENSE' "
    "ELSE '/' || floor(doc_id / 8) || '/' || doc_id || '.txt' END"
)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.expr(_PATH).alias("path"), "text")
    return scan(files).withColumnRenamed("file", "doc_id")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


OP7_SQL = rf"""
WITH notices(template, license, notice) AS (VALUES {", ".join(f"({k}, {_quoted([a, b])})" for k, (a, b) in enumerate(TEMPLATES))}),
common(term) AS (SELECT unnest([{_quoted(COMMON)}])),
notice_terms AS (
  SELECT template, license, term, count(*) AS tf
  FROM (SELECT template, license, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS term FROM notices)
  WHERE term <> '' AND term NOT IN (SELECT term FROM common) GROUP BY ALL),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || CAST(floor(doc_id / 64) AS BIGINT) ||
    CASE WHEN doc_id % 64 = 0 THEN '/LICENSE' WHEN doc_id % 8 = 0 THEN '/' || CAST(floor(doc_id / 8) AS BIGINT) || '/LICENSE'
    ELSE '/' || CAST(floor(doc_id / 8) AS BIGINT) || '/' || doc_id || '.txt' END AS path FROM documents),
lines AS (SELECT doc_id, pos, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files) WHERE trim(line) <> ''),
line_terms AS (SELECT doc_id, pos, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM lines),
telling AS (SELECT DISTINCT doc_id, pos, term FROM line_terms WHERE term IN (SELECT term FROM notice_terms)),
total AS (SELECT count(*) AS lines FROM lines),
weights AS (
  SELECT t.term, ln((1 + lines) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM notice_terms) t CROSS JOIN total LEFT JOIN (SELECT term, count(*) AS df FROM telling GROUP BY term) d ON d.term = t.term),
vectors AS (
  SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM notice_terms JOIN weights USING (term)),
passages AS (
  SELECT doc_id, pos, line FROM lines SEMI JOIN telling USING (doc_id, pos)
  UNION ALL SELECT doc_id, -1, text FROM files SEMI JOIN telling USING (doc_id)),
terms AS (
  SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM passages)
  WHERE term <> '' AND term NOT IN (SELECT term FROM common) GROUP BY ALL),
weighted AS (SELECT doc_id, pos, t.term, tf * coalesce(idf, ln(1 + lines) + 1) AS w FROM terms t CROSS JOIN total LEFT JOIN weights k ON k.term = t.term),
scored AS (
  SELECT p.doc_id, license, round(product / length, 6) AS score
  FROM (SELECT doc_id, pos, template, license, sum(a.w * b.w) AS product FROM weighted a JOIN vectors b USING (term) GROUP BY ALL) p
  JOIN (SELECT doc_id, pos, sqrt(sum(w * w)) AS length FROM weighted GROUP BY ALL) l ON p.doc_id = l.doc_id AND p.pos = l.pos),
own AS (
  SELECT doc_id, license, score FROM scored WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
marked AS (SELECT f.doc_id, f.path, o.license, o.score, regexp_replace(f.path, '/[^/]*$', '') AS directory FROM files f LEFT JOIN own o USING (doc_id)),
holders AS (
  SELECT directory AS above, path, license, score FROM marked
  WHERE license IS NOT NULL AND regexp_extract(path, '[^/]*$') = 'LICENSE'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY path, license, score) = 1),
nearest AS (
  SELECT d.directory, h.path, h.license, h.score FROM (SELECT DISTINCT directory FROM marked) d
  JOIN holders h ON d.directory = h.above OR starts_with(d.directory, h.above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(h.above) DESC) = 1)
SELECT m.doc_id, m.path, coalesce(m.license, n.license) AS license, coalesce(m.score, n.score) AS score,
  CASE WHEN m.license IS NOT NULL THEN m.path ELSE n.path END AS origin
FROM marked m LEFT JOIN nearest n ON m.license IS NULL AND m.directory = n.directory
"""
