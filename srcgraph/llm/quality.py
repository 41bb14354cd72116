"""Quality rules as a short-circuit cascade.

A rule is a named column expression that is true for a text to reject. Each rule's cost and share of
rejections are measured on a bounded sample; rules run in the order of rejections per second, each only
on texts that none before it rejected (the branches of one CASE expression). The verdict does not
depend on the order.

Only column expressions are used. Repeated windows are found inside each row: hashes of all windows of
eight words, and only where two of them are equal their sorted positions.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged
each; an empty table gives no rows and leaves the rules in their given order; columns that the caller
has are kept by ``judge`` (its own are prefixed).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import WHITE, let, table, whole

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 512
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.translate(text, WHITE, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(tokens: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more."""
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = lambda j, x: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(p, lambda x, j: same(j - 1, x) | same(j + 1, x))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda i, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - i, F.lit(size))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(placed, positions), union)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
        return F.when(F.size(w) > size, let(hashes, some)).otherwise(F.lit(0))

    return let(tokens, count).cast("long")


def stuttered(tokens: Column) -> Column:
    """Words equal to the word before them."""
    def count(w: Column) -> Column:
        return F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))

    return let(tokens, count).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("_n_words") < MIN_WORDS),
        Rule("repeated_words", F.col("_n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEAT_PERCENT),
    ]


def rules() -> list[Rule]:
    """The further rules of the query, on the measures of ``measured``."""
    n = F.greatest(F.col("_n_words"), F.lit(1))
    return [
        Rule("many_symbols", F.col("_n_symbols") * 10 > n),
        Rule("duplicate_lines", F.col("_n_dup_lines") * 10 > F.size(filled_lines(whole("text"))) * 3),
        Rule("word_length", (F.col("_word_chars") < n * 2) | (F.col("_word_chars") > n * 15)),
        Rule("stutter", stuttered(F.col("_words")) * 5 > n),
        Rule("no_letters", ~whole("text").rlike(r"\p{L}")),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """The rows with the base measures; ``_words`` is the list of words."""
    text = whole("text")
    return docs.withColumn("_words", words(text)).withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": word_chars(text),
            "_n_symbols": symbols(text),
            "_n_dup_lines": let(filled_lines(text), duplicate_lines),
            "_n_repeat_words": repeated_words(F.col("_words")),
        }
    )


def ordered(docs: DataFrame, listed: list[Rule], sample: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``sample`` rows, the best first.

    A hash of the text lets about twice the sample through, wherever it lies; each rule is timed over
    the sample alone.
    """
    share = min(1.0, 2 * sample / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("text"), F.lit(2**40))
    chosen = measured(docs.select("text").filter(draw < int(share * 2**40)).limit(sample)).cache()
    try:
        total = chosen.count()
        gains = {}
        for rule in listed:
            began = time.perf_counter()
            rejected = chosen.agg(F.count_if(rule.rejects)).first()[0]
            gains[rule.name] = rejected / max(1, total) / max(1e-3, time.perf_counter() - began)
    finally:
        chosen.unpersist()
    return sorted(listed, key=lambda r: -gains[r.name])  # a stable sort: ties keep the given order


def cascade(listed: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(listed):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, further: list[Rule] | None = None) -> DataFrame:
    """The rows with the measures (prefixed by _), ``_base_failed`` and ``_kept``."""
    listed = ordered(docs, base_rules() + (rules() if further is None else further))
    failed = F.lit(False)
    for rule in base_rules():
        failed = failed | rule.rejects
    return (
        measured(docs)
        .withColumn("_base_failed", failed)
        .withColumn("_kept", ~F.col("_base_failed") & cascade(listed).isNull())
        .drop("_words")
    )


def op1(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i:i+7] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
stutter AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT doc_id, words, unnest(range(2, len(words) + 1)) AS i FROM w) WHERE words[i] = words[i-1] GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(stutter.n, 0) AS n_stutter,
    regexp_matches(text, '\p{L}') AS letters
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN stutter USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_symbols * 10 <= n AND n_dup_lines * 10 <= n_lines * 3
    AND word_chars BETWEEN n * 2 AND n * 15 AND n_stutter * 5 <= n AND letters AS kept
FROM b
"""
