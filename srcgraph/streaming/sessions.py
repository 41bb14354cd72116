"""Conversation state over a stream of turns: bounded window, active entities, scope, expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from srcgraph.operators.state import ENTITIES, SESSION_LIFE, TURNS

CONTEXT_SCHEMA = (
    "session_id string, turns array<long>, active_entities array<string>, repository_id string, "
    "revision string, last_at double, expired boolean"
)
_STATE = "context string"


def _merge_spans(spans: list[list[float]], times: list[float], idle: float) -> list[list[float]]:
    """Activity spans of a session; spans closer than the idle time are one."""
    merged: list[list[float]] = []
    for start, end in sorted(spans + [[at, at] for at in times]):
        if merged and start - merged[-1][1] < idle:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def merge_turns(
    context: dict, rows: pd.DataFrame, turns: int = TURNS, entities: int = ENTITIES, idle: float = SESSION_LIFE
) -> dict:
    """Add turns to a session in any order; what is kept never exceeds the bounds.

    Everything is ordered by turn number and carries its time, so the result does not depend on how
    turns are spread over batches or chunks.
    """
    spans = _merge_spans(context.get("spans", []), rows["at"].tolist(), idle)
    window = dict(context.get("window", []))
    mentions = {name: tuple(place) for name, place in context.get("mentions", [])}
    scope = dict(context.get("scope", {}))
    for row in rows.itertuples(index=False):
        window[int(row.turn)] = row.at
        for place, name in enumerate(row.entities if row.entities is not None else []):
            mentions[name] = max(mentions.get(name, (-1, -1, 0.0)), (int(row.turn), place, row.at))
        for field in ("repository_id", "revision"):
            value = getattr(row, field)
            if value and int(row.turn) >= scope.get(field, [-1])[0]:
                scope[field] = [int(row.turn), value, row.at]
    return {
        "spans": spans,
        "window": sorted(window.items())[-turns:],
        "mentions": sorted(mentions.items(), key=lambda item: item[1])[-entities:],
        "scope": scope,
    }


def current(context: dict) -> dict:
    """What of a context belongs to the running session, the last span of activity."""
    start = context["spans"][-1][0]
    return {
        "spans": context["spans"][-1:],
        "window": [item for item in context["window"] if item[1] >= start],
        "mentions": [item for item in context["mentions"] if item[1][2] >= start],
        "scope": {k: v for k, v in context["scope"].items() if v[2] >= start},
    }


def _row(session: str, context: dict, expired: bool) -> pd.DataFrame:
    scope = {field: value[1] for field, value in context["scope"].items()}
    return pd.DataFrame(
        {
            "session_id": [session],
            "turns": [[turn for turn, _ in context["window"]]],
            "active_entities": [[name for name, _ in context["mentions"]]],
            "repository_id": [scope.get("repository_id")],
            "revision": [scope.get("revision")],
            "last_at": [context["spans"][-1][1]],
            "expired": [expired],
        }
    )


def _update(
    key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, idle: float
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        context = json.loads(state.get[0])
        state.remove()
        yield _row(key[0], context, True)
        return
    context = json.loads(state.get[0]) if state.exists else {}
    for chunk in chunks:
        context = merge_turns(context, chunk, idle=idle)
    context = current(context)
    state.update((json.dumps(context),))
    deadline = int((context["spans"][-1][1] + idle) * 1000)
    state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
    yield _row(key[0], context, False)


def session_contexts(
    turns: DataFrame, lateness: str = "1 hour", idle_seconds: float = SESSION_LIFE
) -> DataFrame:
    """Streaming context of every session, one row per session and batch (update mode).

    ``turns``: session_id STRING, turn, created_at TIMESTAMP, entities ARRAY<STRING>, repository_id,
    revision. A session idle for ``idle_seconds`` of event time is closed with an ``expired`` row.
    """
    stream = turns.withWatermark("created_at", lateness).select(
        "session_id", "turn", "created_at", F.col("created_at").cast("double").alias("at"), "entities",
        "repository_id", "revision",
    )
    return stream.groupBy("session_id").applyInPandasWithState(
        lambda key, chunks, state: _update(key, chunks, state, idle_seconds),
        CONTEXT_SCHEMA,
        _STATE,
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def session_windows(
    events: DataFrame, key: str, time: str, lateness: str = "1 hour", idle_seconds: int = SESSION_LIFE
) -> DataFrame:
    """Streaming visits per key with Spark's session windows (append mode)."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(key, F.session_window(time, f"{idle_seconds} seconds").alias("visit"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
