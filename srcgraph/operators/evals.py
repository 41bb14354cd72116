"""Evaluation and load reports over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.session import cut_lineage

CHECKS = [
    "http_200", "partial_as_expected", "agents", "source_any", "source_all", "answer_terms", "trace",
]


def _list(values: Column) -> Column:
    """List of names the way the report prints it."""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def golden_checks(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Seven checks, failure labels and the verdict per case.

    ``cases``: id and expectations; ``responses``: id, response_status, answer, agents_used,
    source_paths (ARRAY<STRING>), partial, trace_id. A case without response fails.
    """
    answered = cases.join(responses, "id", "left")
    agents = F.coalesce("agents_used", F.array().cast("array<string>"))
    paths = F.array_sort(F.array_distinct(F.coalesce("source_paths", F.array().cast("array<string>"))))
    answer = F.lower(F.coalesce("answer", F.lit("")))
    status = F.coalesce("response_status", F.lit(0))
    missing_agents = F.array_sort(F.array_except("expected_agents", agents))
    missing_sources = F.array_sort(F.array_except("expected_source_paths_all", paths))
    conditions = {
        "http_200": status == 200,
        "partial_as_expected": F.coalesce("partial", F.lit(True)) == F.col("expect_partial"),
        "agents": F.size(missing_agents) == 0,
        "source_any": (F.size("expected_source_paths_any") == 0)
        | F.arrays_overlap("expected_source_paths_any", paths),
        "source_all": F.size(missing_sources) == 0,
        "answer_terms": F.forall(
            "answer_term_groups",
            lambda group: F.exists(group, lambda term: F.contains(answer, F.lower(term))),
        ),
        "trace": F.coalesce("trace_id", F.lit("")) != "",
    }
    groups = F.transform("answer_term_groups", lambda group: _list(group))
    labels = {
        "http_200": F.concat(F.lit("expected HTTP 200, received "), status),
        "partial_as_expected": F.concat(
            F.lit("expected partial="), F.initcap(F.col("expect_partial").cast("string"))
        ),
        "agents": F.concat(F.lit("missing agents: "), _list(missing_agents)),
        "source_any": F.concat(
            F.lit("expected any source: "), _list(F.col("expected_source_paths_any"))
        ),
        "source_all": F.concat(F.lit("missing sources: "), _list(missing_sources)),
        "answer_terms": F.concat(
            F.lit("missing answer term groups: ["), F.array_join(groups, ", "), F.lit("]")
        ),
        "trace": F.lit("response did not contain a trace ID"),
    }
    failures = F.array_compact(F.array(*[F.when(~F.col(c), labels[c]) for c in CHECKS]))
    return (
        answered.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()})
        .withColumn("failures", failures)
        .withColumn("passed", F.size("failures") == 0)
        .select("id", *CHECKS, "failures", "passed", *[c for c in ("latency_ms",) if c in answered.columns])
    )


def nearest_ranks(
    rows: DataFrame, keys: list[str], column: str, fractions: dict[str, float]
) -> DataFrame:
    """Per key, for each named fraction the value at index ceil(fraction * n) - 1 of the sorted column.

    Exact, and no task holds a key's values: counts per distinct value are dealt by range of
    (key, value), each range adds up its own, and the sums of a key's earlier ranges are added.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    dealt = cut_lineage(
        counts.repartitionByRange(*keys, column).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        dealt.groupBy(*keys, "_part")
        .agg(F.sum("_n").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_sum").over(Window.partitionBy(*keys)))
        .select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col("_part").alias("_of"), "_before", "_all")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_of")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}_"))
    upto = F.col("_inside") + F.col("_before")
    return (
        dealt.withColumn("_inside", F.sum("_n").over(inside))
        .join(parts, same)
        .groupBy(*keys)
        .agg(
            *[
                F.min(F.when(upto >= F.ceil(F.col("_all") * fraction), F.col(column))).alias(name)
                for name, fraction in fractions.items()
            ]
        )
    )


def _with_ranks(summary: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A summary per key with p50 and p95 of the latencies."""
    names = {f"_{key}_key": key for key in keys}
    ranks = nearest_ranks(rows, keys, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    ranks = ranks.select(*[F.col(key).alias(name) for name, key in names.items()], "p50_ms", "p95_ms")
    same = F.lit(True)
    for name, key in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return summary.join(ranks, same, "left").drop(*names)


def summarise_latencies(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Minimum, p50, p95 and maximum rounded to three places; zeros when there is nothing."""
    rows = results if keys else results.withColumn("_every", F.lit(0))
    by = keys or ["_every"]
    ends = rows.groupBy(*by).agg(F.min("latency_ms").alias("minimum_ms"), F.max("latency_ms").alias("maximum_ms"))
    if not keys:
        ends = results.agg(F.min("latency_ms").alias("minimum_ms"), F.max("latency_ms").alias("maximum_ms")).withColumn("_every", F.lit(0))
    names = ["minimum_ms", "p50_ms", "p95_ms", "maximum_ms"]
    return _with_ranks(ends, rows, by).select(
        *(keys or []), *[F.coalesce(F.round(name, 3), F.lit(0.0)).alias(name) for name in names]
    )


def suite_summary(results: DataFrame, minimum_pass_rate: float = 1.0) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.count_if("passed"), F.count(F.lit(1))), F.lit(0.0))
    return results.agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        rate.alias("pass_rate"),
        F.lit(minimum_pass_rate).alias("minimum_pass_rate"),
        (rate >= minimum_pass_rate).alias("accepted"),
    )


def load_summary(requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcome counts, duration, throughput and latencies of a load run.

    ``requests``: status, latency_ms, started_at. Throughput counts every request.
    """
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    finish = start + F.round(F.col("latency_ms") * 1000).cast("bigint")
    duration = (F.max(finish) - F.min(start)) / 1e6
    total = F.count(F.lit(1))
    rows = requests if keys else requests.withColumn("_every", F.lit(0))
    by = keys or ["_every"]
    summary = rows.groupBy(*by).agg(
        total.alias("requests"),
        F.count_if(F.col("status") == 200).alias("completed"),
        F.count_if(F.col("status") == 429).alias("rejected"),
        F.count_if(~F.col("status").isin(200, 429)).alias("failed"),
        F.round(duration, 3).alias("duration_seconds"),
        F.round(F.try_divide(total, duration), 3).alias("throughput_per_second"),
        F.round(F.max("latency_ms"), 3).alias("maximum_ms"),
    )
    return (
        _with_ranks(summary, rows, by)
        .withColumns({name: F.round(name, 3) for name in ("p50_ms", "p95_ms")})
        .select(*(keys or []), *[c for c in summary.columns if c not in (*by, "maximum_ms")], "p50_ms", "p95_ms", "maximum_ms")
    )


def stream_checks(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Checks of streamed answers.

    ``cases``: id, required_events, minimum_token_events, response_status; ``events``: id,
    position, type, state (state of status events). Event kinds are few, so the sets stay small.
    """
    seen = events.groupBy("id").agg(
        F.collect_set("type").alias("seen"),
        F.min_by("state", F.when(F.col("state").isNotNull(), F.col("position"))).alias("first_state"),
        F.bool_or(F.coalesce(F.col("state") == "completed", F.lit(False))).alias("completed"),
        F.count_if(F.col("type") == "token").alias("tokens"),
    )
    checked = cases.join(seen, "id", "left").select(
        "id",
        (F.col("response_status") == 200).alias("http_200"),
        F.coalesce(F.size(F.array_except("required_events", "seen")) == 0, F.lit(False)).alias(
            "required_events"
        ),
        F.coalesce(
            (F.col("first_state") == "orchestration_started") & F.col("completed"), F.lit(False)
        ).alias("started_before_completed"),
        (F.coalesce("tokens", F.lit(0)) >= F.col("minimum_token_events")).alias("chunked_tokens"),
    )
    names = ["http_200", "required_events", "started_before_completed", "chunked_tokens"]
    failures = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    return checked.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def health(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``healthy`` only if every checked service is."""
    fine = F.bool_and(F.col("status") == "healthy")
    return checks.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("services"),
        F.when(F.coalesce(fine, F.lit(True)), "healthy").otherwise("degraded").alias("status"),
    )
