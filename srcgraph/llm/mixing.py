"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies c = target / source size. Its whole
part is taken outright; the fractional part is a copy probability. Two documents of a source trade
mass at random, keeping the words of the pair and the expectation of either, until one probability is
0 or 1. Blocks of documents of similar size do so first; what stays fractional in each block meets
again in the next level of a reduction tree. At the root, at most ``BLOCK`` residuals of a source and about
``HELD`` documents kept back are rounded from the largest down, each passing its rounding error on to the next.

Defined results: null text has size 0, is taken 0 times and changes nothing; a null source is a source
of its own; rows equal in doc_id, source and size share one decision; an empty table gives no rows;
reruns agree because every draw is a hash of the documents that meet. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import fresh, table, word_count
from srcgraph.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 128
HELD = 64
SEED = 20

_ITEM = "struct<doc_id:bigint,size:bigint,n:bigint,p:double>"
#: One pivotal step: the open document meets the next one of its block.
_PIVOT = """
aggregate(items,
  named_struct('done', cast(array() as array<{item}>), 'open', cast(null as {item})),
  (s, x) -> CASE WHEN s.open IS NULL THEN named_struct('done', s.done, 'open', x) ELSE
    element_at(transform(array(named_struct(
        'a', cast(s.open.size * s.open.n as double), 'b', cast(x.size * x.n as double),
        'u', {draw})), v ->
      element_at(transform(array(named_struct(
          'more', least(v.a * (1 - s.open.p), v.b * x.p), 'less', least(v.a * s.open.p, v.b * (1 - x.p)))), w ->
        element_at(transform(array(CASE WHEN v.u * (w.more + w.less) < w.less THEN w.more ELSE -w.less END), t ->
          element_at(transform(array(array(
              named_struct('doc_id', s.open.doc_id, 'size', s.open.size, 'n', s.open.n, 'p', s.open.p + t / v.a),
              named_struct('doc_id', x.doc_id, 'size', x.size, 'n', x.n, 'p', x.p - t / v.b))), pair ->
            named_struct(
              'done', concat(s.done, filter(pair, y -> y.p < 1e-9 OR y.p > 1 - 1e-9)),
              'open', get(filter(pair, y -> y.p >= 1e-9 AND y.p <= 1 - 1e-9), 0))
          ), 1)), 1)), 1)), 1) END)
"""
#: The root: largest first, the rounding error of each is handed to the next.
#: A side is open only while the words still to come can make up for it.
_ROOT = """
aggregate(items,
  named_struct('done', cast(array() as array<{item}>), 'carry', cast(0 as double), 'mass', mass, 'room', room),
  (s, x) -> element_at(transform(array(named_struct('a', cast(x.size * x.n as double),
      'q', least(1, greatest(0, x.p + s.carry / (x.size * x.n))),
      'mass', s.mass - x.size * x.n * x.p, 'room', s.room - x.size * x.n * (1 - x.p))), v ->
    element_at(transform(array(CASE
        WHEN v.a * (1 - v.q) > v.mass AND v.a * v.q > v.room THEN IF(v.q >= 0.5, 1D, 0D)
        WHEN v.a * (1 - v.q) > v.mass THEN 0D
        WHEN v.a * v.q > v.room THEN 1D
        WHEN {draw} < v.q THEN 1D ELSE 0D END), up ->
      named_struct(
        'done', concat(s.done, array(named_struct('doc_id', x.doc_id, 'size', x.size, 'n', x.n, 'p', up))),
        'carry', s.carry + v.a * (x.p - up), 'mass', v.mass, 'room', v.room)), 1)), 1)).done
"""


def _draw(*parts: str) -> str:
    return f"(pmod(xxhash64({SEED}, {', '.join(parts)}), 1048573) + 0.5D) / 1048573"


def source_targets(units: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Size, weight and target of each source: shares by weight, filled up to ``cap`` times the size.

    Sources are sorted by the level at which they reach their cap; running sums give the level that
    spends everything. One row per source passes through the two unpartitioned windows.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    weighted = sizes.withColumn(
        "weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("limit", (F.lit(cap) * F.col("source_size")).cast("double"))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        weighted.withColumn("level", left / weight_left)
        .withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(every))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): how often each of ``n`` equal rows is taken."""
    units = cut_lineage(
        docs.select("doc_id", "source", word_count("text").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    )
    targets = source_targets(units, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (
        units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("rate", F.least(rate, F.lit(float(cap))))
        .withColumn("base", F.floor(F.col("rate") + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    )
    whole_part = (F.col("p") < 1e-9) | (F.col("size") == 0)
    group = ["source", "source_size", "target", "base"]
    finished = [rated.filter(whole_part).withColumn("p", F.lit(0.0))]
    opened = rated.filter(~whole_part).withColumn(
        "class", F.floor(F.log2(F.col("size") * F.col("n")) * 2).cast("int")
    )
    # About ``HELD`` documents of each source wait for the root, where they take up what large ones leave.
    totals = opened.groupBy("source").count().select(F.col("source").alias("_source"), F.col("count").alias("_total"))
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.lit("held"), "doc_id", "size"), F.lit(1048573)) / 1048573
    opened = cut_lineage(
        opened.join(totals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("held", chance < F.lit(float(HELD)) / F.col("_total"))
        .drop("_source", "_total")
    )
    held = opened.filter("held").select(*group, "doc_id", "size", "n", "p", F.lit(0).alias("class"))
    opened = opened.filter("NOT held").select(*group, "doc_id", "size", "n", "p", "class")
    level = 0
    while True:
        # Blocks of about ``block`` documents, even ones: a hash deals out each class of a source.
        counts = opened.groupBy("source", "class").agg(F.ceil(F.count("*") / block).alias("blocks"))
        most = counts.groupBy("source").agg(F.sum("blocks").alias("blocks")).agg(F.max("blocks")).first()[0]
        root = most is None or most == 1
        if root:
            opened = opened.withColumn("class", F.lit(0)).unionByName(held)
            counts = opened.select("source", "class").distinct().withColumn("blocks", F.lit(1))
        dealt = (
            opened.join(
                counts.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "blocks"),
                F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")),
            )
            .drop("_source", "_class")
            .withColumn("part", F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.col("blocks")))
        )
        items = dealt.groupBy(*group, "class", "part").agg(
            F.reverse(F.array_sort(F.collect_list(F.struct("size", "doc_id", "n", "p")))).alias("items"),
            F.sum(F.col("size") * F.col("n") * F.col("p")).alias("mass"),
            F.sum(F.col("size") * F.col("n") * (1 - F.col("p"))).alias("room"),
        ).withColumn("items", F.expr(f"transform(items, x -> cast(named_struct('doc_id', x.doc_id, 'size', x.size, 'n', x.n, 'p', x.p) as {_ITEM}))"))
        if root:
            rounded = items.withColumn("done", F.expr(_ROOT.format(item=_ITEM, draw=_draw("x.doc_id", "x.size"))))
            finished.append(rounded.select(*group, F.inline("done")))
            break
        folded = cut_lineage(
            items.withColumn("s", F.expr(_PIVOT.format(item=_ITEM, draw=_draw("s.open.doc_id", "x.doc_id", "x.size")))).select(
                *group, "s.done", "s.open"
            )
        )
        finished.append(folded.select(*group, F.inline("done")))
        level += 1
        # From the second level on a source has one class, so that its residuals meet.
        opened = folded.filter("open IS NOT NULL").select(*group, "open.*", F.lit(0).alias("class"))
    columns = ["doc_id", "source", "size", "n", "source_size", "target"]
    copies = (F.col("base") + F.round("p")).cast("long").alias("copies")
    out = None
    for part in finished:
        part = part.select(*columns, copies)
        out = part if out is None else out.unionByName(part)
    return out


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents as often as the mix takes them, with their columns."""
    id_, source, size, copies, words, copy = (fresh(docs, f"mix_{c}") for c in ("id", "source", "size", "copies", "words", "copy"))
    taken = mix(docs, weights, cap).filter("copies > 0").select(
        F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)
    )
    return (
        docs.withColumn(words, word_count("text"))
        .join(
            taken,
            F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)),
        )
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
        .select(*docs.columns)
    )


def op10(spark, folder: str) -> DataFrame:
    return (
        mix(table(spark, folder, "documents"))
        .withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    )
