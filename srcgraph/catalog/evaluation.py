"""Evaluation and load reports over order-made cases and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.operators import evals
from srcgraph.sources.adapters import table

CASES = """
WITH r AS (SELECT o_orderkey AS id, left(o_orderpriority, 1) AS p, o_orderstatus AS s, o_custkey, o_totalprice,
    CASE WHEN o_totalprice > 450000 THEN 500 ELSE 200 END AS http FROM orders),
checked AS (SELECT id, http, http = 200 AS http_200, (p = '1') = (s = 'P') AS partial_as_expected, s <> 'O' AS agents,
    p <> '2' AS source_any, p <> '3' AS source_all, contains(lower('Answer Of ' || o_custkey), '1') AS answer_terms,
    p <> '4' AS trace FROM r)
"""


def _cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    priority, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")

    def words(*names: str):
        return F.array(*[F.lit(name) for name in names]).cast("array<string>")

    cases = orders.select(
        F.col("o_orderkey").alias("id"),
        words("graph", "analyst").alias("expected_agents"),
        words("a.py", "b.py").alias("expected_source_paths_any"),
        words("c.py", "d.py").alias("expected_source_paths_all"),
        F.array(words("OF", "never"), words("1")).alias("answer_term_groups"),
        (status == "P").alias("expect_partial"),
    )
    any_path = F.when(priority == "2", words()).otherwise(words("b.py"))
    all_paths = F.when(priority == "3", words("d.py")).otherwise(words("d.py", "c.py"))
    results = orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 450_000, 500).otherwise(200).alias("response_status"),
        F.concat(F.lit("Answer Of "), "o_custkey").alias("answer"),
        F.when(status == "O", words("graph")).otherwise(words("analyst", "graph")).alias("agents_used"),
        F.concat(any_path, all_paths).alias("source_paths"),
        (priority == "1").alias("partial"),
        F.when(priority != "4", F.lit("t")).alias("trace_id"),
        F.col("o_totalprice").alias("latency_ms"),
    )
    return cases, results


@query(
    "golden_checks",
    CASES
    + """SELECT id, http_200, partial_as_expected, agents, source_any, source_all, answer_terms, trace,
  http_200 AND partial_as_expected AND agents AND source_any AND source_all AND answer_terms AND trace AS passed,
  concat_ws('; ', CASE WHEN NOT http_200 THEN 'expected HTTP 200, received ' || http END,
    CASE WHEN NOT partial_as_expected THEN 'expected partial=' || CASE WHEN s = 'P' THEN 'True' ELSE 'False' END END,
    CASE WHEN NOT agents THEN 'missing agents: [''analyst'']' END,
    CASE WHEN NOT source_any THEN 'expected any source: [''a.py'', ''b.py'']' END,
    CASE WHEN NOT source_all THEN 'missing sources: [''c.py'']' END,
    CASE WHEN NOT answer_terms THEN 'missing answer term groups: [[''OF'', ''never''], [''1'']]' END,
    CASE WHEN NOT trace THEN 'response did not contain a trace ID' END) AS failures
FROM checked JOIN (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders) USING (id)""",
)
def golden_checks(spark: SparkSession, folder: str) -> DataFrame:
    return evals.golden_checks(*_cases(spark, folder)).withColumn(
        "failures", F.array_join("failures", "; ")
    ).drop("latency_ms")


@query(
    "suite_summary",
    CASES
    + """, v AS (SELECT http_200 AND partial_as_expected AND agents AND source_any AND source_all AND answer_terms AND trace AS ok FROM checked)
SELECT count(*) FILTER (ok) AS passed, count(*) AS total, round(count(*) FILTER (ok) / count(*)::DOUBLE, 9) AS pass_rate,
  0.5::DOUBLE AS minimum_pass_rate, count(*) FILTER (ok) / count(*)::DOUBLE >= 0.5 AS accepted FROM v""",
)
def suite_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = evals.suite_summary(evals.golden_checks(*_cases(spark, folder)), 0.5)
    return summary.withColumn("pass_rate", F.round("pass_rate", 9))


@query(
    "latency_percentiles",
    """SELECT event_type, round(min(value), 3) AS minimum_ms, round(quantile_disc(value, 0.5), 3) AS p50_ms,
  round(quantile_disc(value, 0.95), 3) AS p95_ms, round(max(value), 3) AS maximum_ms FROM events GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "events").withColumnRenamed("value", "latency_ms")
    return evals.summarise_latencies(results, ["event_type"])


@query(
    "load_summary",
    """WITH r AS (SELECT user_id, value, epoch_us(ts) AS started,
    CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 ELSE 200 END AS status FROM events),
d AS (SELECT *, (max(started + round(value * 1000)::BIGINT) OVER w - min(started) OVER w) / 1e6 AS duration FROM r WINDOW w AS (PARTITION BY user_id))
SELECT user_id, count(*) AS requests, count(*) FILTER (status = 200) AS completed, count(*) FILTER (status = 429) AS rejected,
  count(*) FILTER (status = 503) AS failed, round(any_value(duration), 3) AS duration_seconds,
  round(count(*) / any_value(duration), 3) AS throughput_per_second, round(quantile_disc(value, 0.5), 3) AS p50_ms,
  round(quantile_disc(value, 0.95), 3) AS p95_ms, round(max(value), 3) AS maximum_ms FROM d GROUP BY user_id""",
)
def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    requests = table(spark, folder, "events").select(
        "user_id",
        F.when(kind == "error", 429).when(kind == "signup", 503).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("started_at"),
    )
    return evals.load_summary(requests, ["user_id"])


@query(
    "stream_checks",
    """WITH ev AS (SELECT user_id, event_id, event_type FROM events),
seen AS (SELECT user_id, count(DISTINCT event_type) = 5 AS every, count(*) FILTER (event_type = 'view') AS tokens,
    arg_min(event_id, event_id) FILTER (event_type IN ('click', 'purchase')) AS first_state,
    bool_or(event_type = 'purchase') AS completed FROM ev GROUP BY user_id),
first AS (SELECT s.*, e.event_type = 'click' AS started FROM seen s LEFT JOIN ev e ON e.event_id = s.first_state),
c AS (SELECT user_id AS id, every AS required_events, coalesce(started AND completed, false) AS started_before_completed,
    tokens >= 15 AS chunked_tokens FROM first)
SELECT id, true AS http_200, required_events, started_before_completed, chunked_tokens,
  required_events AND started_before_completed AND chunked_tokens AS passed FROM c""",
)
def stream_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Users as streamed answers: clicks open, purchases complete, views are pieces of text."""
    kind = F.col("event_type")
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("position"),
        F.when(kind == "view", "token").when(kind.isin("click", "purchase"), "status").otherwise(kind).alias("type"),
        F.when(kind == "click", "orchestration_started").when(kind == "purchase", "completed").alias("state"),
        kind.alias("event_type"),
    )
    cases = events.select("id").distinct().select(
        "id",
        F.array(*[F.lit(t) for t in ("click", "purchase", "signup", "error", "view")]).alias("required_events"),
        F.lit(15).alias("minimum_token_events"),
        F.lit(200).alias("response_status"),
    )
    # Required kinds are checked on the raw kind, states and pieces on the mapped one.
    mapped = events.select("id", "position", "type", "state")
    raw = events.select("id", "position", F.col("event_type").alias("type"), F.lit(None).cast("string").alias("state"))
    return evals.stream_checks(cases, mapped.unionByName(raw)).drop("failures")


@query(
    "health",
    """SELECT s_nationkey, count(*) AS services,
  CASE WHEN bool_and(s_acctbal > 0) THEN 'healthy' ELSE 'degraded' END AS status FROM supplier GROUP BY 1""",
)
def health(spark: SparkSession, folder: str) -> DataFrame:
    checks = table(spark, folder, "supplier").select(
        "s_nationkey", F.when(F.col("s_acctbal") > 0, "healthy").otherwise("unhealthy").alias("status")
    )
    return evals.health(checks, ["s_nationkey"])
