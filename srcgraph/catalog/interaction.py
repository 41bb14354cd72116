"""Conversation, cache, audit and episode state over ``conversations`` and ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.operators import questions, state
from srcgraph.sources.adapters import table

NOW = datetime(2024, 1, 31)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the turns of their user: hundreds per session, so every bound is reached."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("turn"),
        F.col("ts").alias("created_at"),
        F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k")), kind).alias("entities"),
        F.when(kind == "signup", F.concat(F.lit("repo"), "user_id")).alias("repository_id"),
        F.when(kind == "purchase", F.concat(F.lit("rev"), "event_id")).otherwise("").alias("revision"),
        F.col("value"),
        kind.alias("event_type"),
    )


@query(
    "turn_window",
    """SELECT user_id AS session_id, event_id AS turn, value FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10""",
)
def turn_window(spark: SparkSession, folder: str) -> DataFrame:
    return state.turn_window(_turns(spark, folder)).select("session_id", "turn", "value")


@query(
    "conversation_window",
    """SELECT conv_id AS session_id, turn, text FROM (SELECT *, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3""",
)
def conversation_window(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "text"
    )
    return state.turn_window(turns, 3)


@query(
    "active_entities",
    """WITH m AS (SELECT user_id, 'k' || (props::JSON->>'$.k') AS entity, event_id * 2 AS seen_at FROM events
    UNION ALL SELECT user_id, event_type, event_id * 2 + 1 FROM events),
last AS (SELECT user_id, entity, max(seen_at) AS seen_at FROM m GROUP BY ALL)
SELECT user_id AS session_id, entity, recency FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY seen_at DESC) AS recency FROM last) WHERE recency <= 20""",
)
def active_entities(spark: SparkSession, folder: str) -> DataFrame:
    found = state.active_entities(_turns(spark, folder))
    return found.withColumn("recency", F.col("recency").cast("bigint"))


@query(
    "scope_carry",
    """SELECT user_id AS session_id, event_id AS turn,
  last_value(CASE WHEN event_type = 'signup' THEN 'repo' || user_id END IGNORE NULLS) OVER w AS effective_repository_id,
  last_value(CASE WHEN event_type = 'purchase' THEN 'rev' || event_id END IGNORE NULLS) OVER w AS effective_revision
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def scope_carry(spark: SparkSession, folder: str) -> DataFrame:
    return state.scope_carry(_turns(spark, folder)).select(
        "session_id", "turn", "effective_repository_id", "effective_revision"
    )


_VISITS = """
WITH gap AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR AS opens FROM events),
numbered AS (SELECT *, sum(coalesce(opens::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS visit FROM gap)
"""


@query(
    "sessions",
    _VISITS
    + """SELECT user_id, visit, count(*) AS events, min(ts) AS started_at, max(ts) AS last_at
FROM numbered GROUP BY ALL""",
)
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return state.sessions(table(spark, folder, "events"), "user_id", "ts", 43_200)


@query("session_turns", _VISITS + "SELECT user_id, event_id, visit FROM numbered")
def session_turns(spark: SparkSession, folder: str) -> DataFrame:
    numbered = state.with_sessions(table(spark, folder, "events"), "user_id", "ts", 43_200)
    return numbered.select("user_id", "event_id", "visit")


@query(
    "preferences",
    """WITH w AS (SELECT user_id, arg_max(CASE WHEN value > 50 THEN 'detailed' ELSE 'concise' END, ts) AS d,
    arg_max(CASE WHEN value > 20 THEN 'always' ELSE 'never' END, ts) AS e FROM events
  WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-30' AND ts <= TIMESTAMP '2024-01-31' GROUP BY user_id)
SELECT DISTINCT ev.user_id AS session_id, coalesce(d, 'balanced') AS response_detail,
  coalesce(e, 'when_relevant') AS code_examples FROM events ev LEFT JOIN w USING (user_id)""",
)
def preferences(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    writes = turns.filter("event_type = 'click'").select(
        "session_id",
        F.col("created_at").cast("timestamp").alias("written_at"),
        F.col("turn").alias("sequence"),
        F.when(F.col("value") > 50, "detailed").otherwise("concise").alias("response_detail"),
        F.when(F.col("value") > 20, "always").otherwise("never").alias("code_examples"),
    )
    return state.preferences(turns, writes, F.lit(NOW))


@query(
    "query_normalisation",
    r"""SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normalised FROM conversations""",
)
def query_normalisation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", state.normalised_query(F.col("text")).alias("normalised")
    )


@query(
    "cache_hits",
    """WITH r AS (SELECT event_id, ts, event_type, (props::JSON->>'$.k')::INTEGER AS k, event_type NOT IN ('error', 'signup') AS eligible,
    event_type = 'view' AS stored FROM events),
written AS (SELECT r.event_id, max(w.ts) AS last FROM r JOIN r w ON w.k = r.k AND w.eligible AND w.stored
    AND (w.ts < r.ts OR (w.ts = r.ts AND w.event_id < r.event_id)) GROUP BY ALL)
SELECT r.event_id AS request_id, eligible AND coalesce(ts - last < INTERVAL 1 HOUR, false) AS cache_hit
FROM r LEFT JOIN written USING (event_id)""",
)
def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Question k asked by events: views store their answer, errors and signups may not look."""
    kind = F.col("event_type")
    text = F.concat(
        F.when(kind == "error", " What is IT  ").otherwise("  Where  is Thing "),
        F.get_json_object("props", "$.k"),
    )
    repository = F.when(kind != "signup", F.lit("repo"))
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("asked_at"),
        state.cache_key(repository, F.lit("r1"), text, F.lit("balanced"), F.lit("never")).alias("cache_key"),
        state.cacheable(text, repository, F.lit("r1")).alias("eligible"),
        (kind == "view").alias("stored"),
    )
    return state.cache_lookups(requests).select("request_id", "cache_hit")


@query(
    "audit_tail",
    """WITH kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
    max(ts) OVER (PARTITION BY user_id) AS newest FROM events)
SELECT user_id AS session_id, event_id AS audit_id, sha256(event_type || ' ' || props) AS query_hash FROM kept
WHERE k <= 30 AND newest > TIMESTAMP '2024-01-31' - INTERVAL 1 DAY""",
)
def audit_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty newest records of sessions active on the last day; prompts only as digests."""
    asked = table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("audit_id"),
        F.col("ts").alias("created_at"), F.concat_ws(" ", "event_type", "props").alias("query"),
    )
    records = state.audit_records(asked)
    return state.audit_tail(records, F.lit(NOW), 30, 86_400).select(
        "session_id", "audit_id", "query_hash"
    )


# Assistant turns as answers to the user turn before them; languages of users repeat often.
EPISODES = """
WITH turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
answered AS (SELECT conv_id * 100 + turn AS episode_id, 'u' || conv_id AS user_id,
    'repo' AS repository_id, text AS query, reply AS answer, turn FROM turns WHERE role = 'user' AND next_role = 'assistant'),
memory AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC, episode_id DESC) AS k
  FROM answered) WHERE k <= 2)
"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a user turn and the assistant turn after it (turn numbers are consecutive)."""
    conversations = table(spark, folder, "conversations")
    replies = conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return (
        conversations.filter("role = 'user'")
        .join(replies, ["conv_id", "turn"])
        .select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("episode_id"),
            F.concat(F.lit("u"), "conv_id").alias("user_id"),
            F.lit("repo").alias("repository_id"),
            F.lit("r1").alias("revision"),
            F.col("text").alias("query"),
            "answer",
            F.array(F.concat(F.lit("conv_"), "conv_id")).alias("entities"),
            F.lit(False).alias("partial"),
            F.col("turn").alias("created_at"),
        )
    )


@query(
    "episodes",
    EPISODES + "SELECT user_id, episode_id, substr(query, 1, 2000) AS query, substr(answer, 1, 4000) AS answer FROM memory",
)
def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return state.remember(_answers(spark, folder), 2).select("user_id", "episode_id", "query", "answer")


@query(
    "episode_recall",
    EPISODES
    + r""", term AS (SELECT DISTINCT episode_id, t FROM (SELECT episode_id, unnest(string_split_regex(lower(substr(query, 1, 2000)
      || ' conv_' || replace(user_id, 'u', '')), '[^\p{L}\p{N}_]+')) AS t FROM memory) WHERE length(t) > 2),
asked AS (SELECT conv_id, turn, 'u' || conv_id AS user_id, lower(text) AS q FROM conversations WHERE role = 'user'),
own AS (SELECT DISTINCT conv_id, turn, user_id, t FROM (SELECT *, unnest(string_split_regex(q, '[^\p{L}\p{N}_]+')) AS t FROM asked)
  WHERE length(t) > 2),
size_own AS (SELECT conv_id, turn, count(*) AS n FROM own GROUP BY ALL),
size_term AS (SELECT episode_id, count(*) AS n FROM term GROUP BY ALL),
shared AS (SELECT o.conv_id, o.turn, m.episode_id, m.turn AS made, count(*) AS n FROM own o JOIN memory m ON m.user_id = o.user_id
  JOIN term ON term.episode_id = m.episode_id AND term.t = o.t GROUP BY ALL)
SELECT conv_id * 100 + turn AS query_id, episode_id, round(score, 9) AS score, rank FROM (SELECT s.*, s.n / (a.n + b.n - s.n)::DOUBLE AS score,
    row_number() OVER (PARTITION BY s.conv_id, s.turn ORDER BY s.n / (a.n + b.n - s.n)::DOUBLE DESC, made DESC, s.episode_id DESC) AS rank
  FROM shared s JOIN size_own a USING (conv_id, turn) JOIN size_term b USING (episode_id)) WHERE rank <= 3""",
)
def episode_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn recalls the remembered exchanges of its conversation."""
    memory = state.remember(_answers(spark, folder), 2)
    asked = table(spark, folder, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("u"), "conv_id").alias("user_id"),
        F.lit("repo").alias("repository_id"),
        F.col("text").alias("query"),
    )
    return state.recall(memory, asked).select(
        "query_id", "episode_id", F.round("score", 9).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "session_questions",
    r"""WITH token AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS i
  FROM (SELECT conv_id, turn, string_split_regex(text, '[^\p{L}\p{N}_]+') AS w FROM conversations)),
m AS (SELECT conv_id, turn, word, min(i) AS i FROM token WHERE regexp_full_match(word, '[A-Z][A-Za-z0-9_]*')
    AND word NOT IN ('What', 'Where', 'How', 'Show', 'Find', 'Explain', 'Compare', 'Python', 'HTTP') GROUP BY ALL),
last AS (SELECT conv_id, word, max(turn * 100000 + i) AS seen_at FROM m GROUP BY ALL)
SELECT conv_id AS session_id, word AS entity, recency FROM (SELECT *, row_number() OVER
  (PARTITION BY conv_id ORDER BY seen_at DESC) AS recency FROM last) WHERE recency <= 20""",
)
def session_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Active entities of every conversation from the symbols of its turns."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn",
        questions.symbol_names(F.col("text")).alias("entities"),
    )
    found = state.active_entities(turns)
    return found.withColumn("recency", F.col("recency").cast("bigint"))
