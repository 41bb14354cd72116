"""Interaction state as queries over turn and write logs (batch form).

Every bound is per key and enforced by a ranked window, which Spark limits before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph import rules
from srcgraph.functions import text
from srcgraph.operators.questions import has_reference
from srcgraph.session import lookup_join, running_last, top_per

# Bounds and lives (seconds) of each kind of state.
TURNS, ENTITIES = 10, 20
AUDITS, AUDIT_LIFE = 100, 604_800
EPISODES, EPISODE_LIFE, RECALLED = 50, 604_800, 3
SESSION_LIFE, PREFERENCE_LIFE, CACHE_LIFE = 86_400, 86_400, 3_600
QUERY_CHARACTERS, ANSWER_CHARACTERS = 2_000, 4_000


def seconds(column: str) -> Column:
    return F.col(column).cast("timestamp").cast("double")


def turn_window(turns: DataFrame, maximum: int = TURNS) -> DataFrame:
    """Last ``maximum`` turns of each session, oldest first by ``turn``."""
    return top_per(turns, ["session_id"], [F.col("turn").desc()], maximum).drop("rank")


def active_entities(turns: DataFrame, maximum: int = ENTITIES) -> DataFrame:
    """Most recently mentioned distinct entities of each session (session_id, entity, recency).

    Recency 1 is the latest. Within a turn, a later mention is more recent.
    """
    mentioned = (
        turns.select("session_id", "turn", F.posexplode("entities").alias("place", "entity"))
        .groupBy("session_id", "entity")
        .agg(F.max(F.struct("turn", "place")).alias("last"))
    )
    return top_per(mentioned, ["session_id"], [F.col("last").desc()], maximum).select(
        "session_id", "entity", F.col("rank").alias("recency")
    )


def scope_carry(turns: DataFrame, turns_per_bucket: int = 1_000) -> DataFrame:
    """Repository and revision in force at each turn: the last that was given."""
    bucket = F.floor(F.col("turn") / turns_per_bucket)
    for column in ("repository_id", "revision"):
        given = F.when(F.col(column) != "", F.col(column))
        turns = running_last(turns, ["session_id"], ["turn"], bucket, given, f"effective_{column}")
    return turns


def _spans(events: DataFrame, key: str, time: str, idle_seconds: int) -> DataFrame:
    """Events merged into spans of half the idle time, each with the visit it belongs to.

    Two events of one span always belong to one visit, so nothing is lost, and a busy key shuffles
    a few spans instead of its events.
    """
    merged = events.groupBy(key, F.floor(seconds(time) / (idle_seconds / 2)).alias("span")).agg(
        F.count(F.lit(1)).alias("events"), F.min(time).alias("first"), F.max(time).alias("last")
    )
    order = Window.partitionBy(key).orderBy("span")
    pause = seconds("first") - F.lag(seconds("last")).over(order)
    opens = F.coalesce((pause >= idle_seconds).cast("int"), F.lit(0))
    return merged.withColumn("opens", opens).withColumn("visit", F.sum("opens").over(order))


def sessions(events: DataFrame, key: str, time: str, idle_seconds: int = SESSION_LIFE) -> DataFrame:
    """Visits of each key: a pause of at least the idle time starts a new one."""
    return (
        _spans(events, key, time, idle_seconds)
        .groupBy(key, "visit")
        .agg(
            F.sum("events").alias("events"),
            F.min("first").alias("started_at"),
            F.max("last").alias("last_at"),
        )
    )


def with_sessions(
    events: DataFrame, key: str, time: str, idle_seconds: int = SESSION_LIFE
) -> DataFrame:
    """Attach the visit number to every event."""
    spans = _spans(events, key, time, idle_seconds).select(key, "span", "visit")
    return (
        events.withColumn("span", F.floor(seconds(time) / (idle_seconds / 2)))
        .join(spans, [key, "span"])
        .drop("span")
    )


def preferences(
    sessions_wanted: DataFrame, writes: DataFrame, as_of: Column, life: int = PREFERENCE_LIFE
) -> DataFrame:
    """Preferences in force per session at ``as_of``; defaults when none was written in time.

    ``writes``: session_id, written_at, sequence and one column per preference.
    """
    names = list(rules.DEFAULT_PREFERENCES)
    latest = (
        writes.filter((seconds("written_at") > as_of.cast("double") - life) & (F.col("written_at") <= as_of))
        .groupBy("session_id")
        .agg(F.max_by(F.struct(*names), F.struct("written_at", "sequence")).alias("kept"))
    )
    return sessions_wanted.select("session_id").distinct().join(latest, "session_id", "left").select(
        "session_id",
        *[
            F.coalesce(F.col(f"kept.{name}"), F.lit(default)).alias(name)
            for name, default in rules.DEFAULT_PREFERENCES.items()
        ],
    )


def normalised_query(query: Column) -> Column:
    return text.collapse_space(text.fold(query))


def cache_key(
    repository: Column, revision: Column, query: Column, detail: Column, examples: Column
) -> Column:
    """Digest of everything a stored answer depends on."""
    identity = F.to_json(
        F.struct(
            repository.alias("a"),
            revision.alias("b"),
            normalised_query(query).alias("c"),
            examples.alias("d"),
            detail.alias("e"),
            F.lit(rules.CACHE_SCHEMA_VERSION).alias("f"),
        )
    )
    return F.sha2(identity, 256)


def cacheable(query: Column, repository: Column, revision: Column) -> Column:
    """Only scoped questions that do not refer back may use the response cache."""
    return repository.isNotNull() & revision.isNotNull() & ~has_reference(query)


def cache_lookups(
    requests: DataFrame, life: int = CACHE_LIFE, seconds_per_bucket: int = 60
) -> DataFrame:
    """Which requests find a stored answer.

    ``requests``: request_id, asked_at, cache_key, eligible (see ``cacheable``), stored (this
    request wrote its complete answer). A hit needs an answer stored earlier under the same key
    less than ``life`` seconds ago; hits do not prolong it.
    """
    at = seconds("asked_at")
    ordered = requests.withColumn("_at", at)
    # A read at a row sees writes of earlier rows only, so a row's own write counts afterwards.
    log = ordered.select("*", F.lit(0).alias("_step"), F.lit(None).cast("double").alias("_write")).unionByName(
        ordered.filter(F.col("eligible") & F.col("stored")).select(
            "*", F.lit(1).alias("_step"), F.col("_at").alias("_write")
        )
    )
    bucket = F.floor(F.col("_at") / seconds_per_bucket)
    seen = running_last(
        log, ["cache_key"], ["_at", "request_id", "_step"], bucket, F.col("_write"), "_last"
    )
    fresh = F.coalesce(F.col("_at") - F.col("_last") < life, F.lit(False))
    return (
        seen.filter(F.col("_step") == 0)
        .withColumn("cache_hit", F.col("eligible") & fresh)
        .drop("_at", "_step", "_write", "_last")
    )


def audit_records(asked: DataFrame) -> DataFrame:
    """Audit rows with the digest of the prompt instead of its text."""
    return asked.withColumn("query_hash", F.sha2(F.col("query").cast("binary"), 256)).drop("query")


def audit_tail(
    records: DataFrame, as_of: Column, maximum: int = AUDITS, life: int = AUDIT_LIFE
) -> DataFrame:
    """Newest records per session; a session without a record for ``life`` is gone."""
    per_session = Window.partitionBy("session_id")
    alive = F.max(seconds("created_at")).over(per_session) > as_of.cast("double") - life
    order = [F.col("created_at").desc(), F.col("audit_id").desc()]
    newest = top_per(records, ["session_id"], order, maximum)
    return newest.withColumn("alive", alive).filter("alive").drop("alive")


def remember(answers: DataFrame, maximum: int = EPISODES) -> DataFrame:
    """Newest complete, scoped answers per user, shortened to their stored size."""
    kept = answers.filter(
        F.col("user_id").isNotNull()
        & F.col("repository_id").isNotNull()
        & F.col("revision").isNotNull()
        & ~F.col("partial")
    )
    order = [F.col("created_at").desc(), F.col("episode_id").desc()]
    return (
        top_per(kept, ["user_id"], order, maximum)
        .withColumn("query", F.substring("query", 1, QUERY_CHARACTERS))
        .withColumn("answer", F.substring("answer", 1, ANSWER_CHARACTERS))
        .withColumn("entities", F.slice("entities", 1, ENTITIES))
        .drop("rank")
    )


def recall(episodes: DataFrame, questions: DataFrame, limit: int = RECALLED) -> DataFrame:
    """Best earlier episodes of the same user and repository by shared terms.

    Score is shared terms over all terms of both. Each remembered term has one posting row per user and
    repository, and a question meets the rows of its own terms only, so it never sees episodes that
    share nothing with it; frequent terms of a user with many questions are spread.
    """
    scope = ["user_id", "repository_id"]
    remembered = episodes.select(
        *scope, "episode_id", "created_at",
        text.words(F.concat_ws(" ", "query", F.array_join("entities", " "))).alias("terms"),
    )
    # At most as many episodes per row as a user's memory holds.
    postings = (
        remembered.withColumn("theirs", F.size("terms"))
        .withColumn("term", F.explode("terms"))
        .groupBy(*scope, "term")
        .agg(F.collect_list(F.struct("episode_id", "created_at", "theirs")).alias("found"))
    )
    own = text.words(F.col("query"))
    asked = questions.select("query_id", *scope, F.size(own).alias("own"), F.explode(own).alias("term"))
    shared = (
        lookup_join(asked, postings, [*scope, "term"], ["query_id"])
        .select("query_id", *scope, "own", F.inline("found"))
        .groupBy("query_id", *scope, "own", "episode_id", "created_at", "theirs")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    scored = shared.select(
        *scope, "query_id", "episode_id", "created_at", "shared",
        (F.col("shared") / (F.col("own") + F.col("theirs") - F.col("shared"))).alias("score"),
    )
    order = [F.col("score").desc(), F.col("created_at").desc(), F.col("episode_id").desc()]
    return top_per(scored, ["query_id"], order, limit)
