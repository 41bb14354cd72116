"""Streams run to the end must agree with the batch operators on the same rows."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from srcgraph.operators import incremental, state
from srcgraph.sources import tables
from srcgraph.streaming import jobs, sessions

START = datetime(2024, 1, 1)
SCHEMA = (
    "session_id string, turn long, created_at timestamp, entities array<string>, repository_id string, "
    "revision string"
)


def turns():
    """Three sessions; one pauses for two days, one is busy enough to reach every bound."""
    rows = []
    for turn in range(60):
        rows.append(("busy", turn, START + timedelta(minutes=turn), [f"e{turn % 27}", f"f{turn % 5}"], None, None))
    for turn in range(6):
        pause = timedelta(days=2) if turn >= 4 else timedelta(0)
        rows.append(("pause", turn, START + timedelta(hours=turn) + pause, [f"p{turn}"], "r" if turn < 2 else None, f"v{turn}" if turn == 4 else ""))
    rows.append(("short", 0, START, ["only"], "r", "v"))
    return rows


@pytest.fixture
def stream(spark, tmp_path):
    """Rows as a file stream of several batches in the order given."""

    def build(rows, schema, batches=3):
        folder = str(tmp_path / "in")
        size = -(-len(rows) // batches)
        for n in range(batches):
            part = rows[n * size : (n + 1) * size]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def run(frame, tmp_path, spark, name, mode):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return spark.table(name)


def test_session_contexts_equal_batch(spark, stream, tmp_path):
    out = run(sessions.session_contexts(stream(turns(), SCHEMA)), tmp_path, spark, "contexts", "update")
    live = [r for r in out.collect() if not r.expired]
    got = {}
    for row in sorted(live, key=lambda r: r.last_at):
        got[row.session_id] = row
    batch = spark.createDataFrame(turns(), SCHEMA)
    visits = state.with_sessions(batch, "session_id", "created_at")
    newest = visits.groupBy("session_id").agg(F.max("visit").alias("visit"))
    running = visits.join(newest, ["session_id", "visit"])
    for name in ("busy", "pause", "short"):
        mine = running.filter(F.col("session_id") == name)
        window = [r.turn for r in state.turn_window(mine).orderBy("turn").collect()]
        active = [r.entity for r in state.active_entities(mine).orderBy(F.col("recency").desc()).collect()]
        scope = state.scope_carry(mine).orderBy(F.col("turn").desc()).first()
        row = got[name]
        assert (row.turns, row.active_entities) == (window, active), name
        assert (row.repository_id, row.revision) == (scope.effective_repository_id, scope.effective_revision)


def test_merging_turns_does_not_depend_on_order():
    frame = pd.DataFrame(
        [(t, at.timestamp(), e, r, v) for _, t, at, e, r, v in turns() if _ == "busy"],
        columns=["turn", "at", "entities", "repository_id", "revision"],
    )
    whole = sessions.merge_turns({}, frame)
    parts = {}
    for n in range(5):
        shuffled = frame.iloc[n::5].sample(frac=1, random_state=n)
        parts = json.loads(json.dumps(sessions.merge_turns(parts, shuffled)))
    assert json.loads(json.dumps(whole)) == parts


REQUESTS = (
    "repository_id string, revision string, mode string, repository_path string, job_id int, created_at timestamp"
)


def test_duplicate_requests(spark, stream, tmp_path):
    rows = [("a", "r", "full", "/x", i, START + timedelta(minutes=i)) for i in range(4)]
    rows += [("b", "r", "full", "/x", 9, START + timedelta(minutes=9))]
    out = run(jobs.first_requests(stream(rows, REQUESTS)), tmp_path, spark, "claims", "append")
    streamed = {r.job_id for r in out.collect()}
    batch = incremental.claim_jobs(
        incremental.index_identity(spark.createDataFrame(rows, REQUESTS)).select("identity", "job_id", "created_at")
    )
    assert streamed == {r.claimed_job_id for r in batch.collect()} == {0, 9}


def test_claims_lapse(spark):
    rows = [("x", i, START + timedelta(days=d)) for i, d in enumerate([0, 3, 7, 9, 13.9, 14])]
    frame = spark.createDataFrame(rows, "identity string, job_id int, created_at timestamp")
    got = {r.job_id: r.claimed_job_id for r in incremental.claim_jobs(frame).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}


def test_progress(spark, stream, tmp_path):
    schema = "job_id int, processed_files long, failed_files long, entity_count long, at timestamp"
    rows = [(i % 2, 1, i % 3, i, START + timedelta(minutes=i)) for i in range(20)]
    out = run(jobs.progress(stream(rows, schema)), tmp_path, spark, "progress", "complete")
    batch = incremental.job_progress(spark.createDataFrame(rows, schema))
    assert sorted(out.collect()) == sorted(batch.collect())


def test_maintained_table_equals_batch(spark, stream, tmp_path):
    root = str(tmp_path / "state")
    writer = jobs.maintain(
        stream(turns(), SCHEMA), root, "turns", state.turn_window, str(tmp_path / "check"), ["session_id"], 3
    )
    assert writer.trigger(availableNow=True).start().awaitTermination(120)
    stored = tables.read(spark, root, "turns").select("session_id", "turn")
    batch = state.turn_window(spark.createDataFrame(turns(), SCHEMA)).select("session_id", "turn")
    assert sorted(stored.collect()) == sorted(batch.collect())


def test_session_windows(spark, stream, tmp_path):
    late = ("late", 0, START + timedelta(days=9), [], None, None)
    frame = sessions.session_windows(stream([*turns(), late, late], SCHEMA, 4), "session_id", "created_at")
    out = run(frame, tmp_path, spark, "visits", "append")
    streamed = sorted((r.session_id, r.events) for r in out.collect())
    assert streamed == [("busy", 60), ("pause", 2), ("pause", 4), ("short", 1)]
