"""Indexing job and answering plan end to end."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import extract, facts as structure, questions, resolve, textops, upsert
from srcgraph.operators.vectors import index_chunks
from srcgraph.plans import answer as answering
from srcgraph.plans import index as indexing
from srcgraph.session import cut_lineage
from srcgraph.sources import tables

FIRST = {
    "app/__init__.py": "",
    "app/base.py": 'class Base:\n    """Root of all."""\n\ndef build():\n    return 1\n',
    "app/shop.py": "from .base import Base, build\n\nclass Shop(Base):\n    def open(self):\n        return build()\n",
    "app/old.py": "def gone():\n    pass\n",
    "app/valid.py": "def stays():\n    return 5\n",
}
SECOND = {
    "app/__init__.py": "",
    "app/base.py": FIRST["app/base.py"],
    "app/shop.py": FIRST["app/shop.py"].replace("return build()", "build()\n        return helper()"),
    "app/renamed.py": FIRST["app/valid.py"],
    "app/extra.py": "def helper():\n    pass\n",
}


def request(number: int, mode: str = "incremental") -> indexing.IndexRequest:
    return indexing.IndexRequest(f"job{number}", mode, indexed_at=datetime(2024, 1, number))


def content(rows, columns):
    return sorted(map(str, rows.select(*columns).collect()))


EDGE = ["revision", "source_id", "kind", "target_id", "resolved", "line"]


@pytest.fixture(scope="module")
def indexed(spark, make_files, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    first = indexing.index_revision(spark, root, make_files(FIRST), request(1)).collect()
    second = indexing.index_revision(spark, root, make_files(SECOND, revision="two"), request(2)).collect()
    return root, first, second


def test_counters_of_both_jobs(indexed):
    _, first, second = indexed
    one, two = first[0], second[0]
    assert (one.status, one.discovered_files, one.skipped_files, one.failed_files) == ("completed", 5, 0, 0)
    assert (two.discovered_files, two.skipped_files, two.deleted_file_count, two.renamed_file_count) == (5, 2, 1, 1)


def test_incremental_equals_full(spark, make_files, indexed, tmp_path):
    root = indexed[0]
    indexing.index_revision(spark, str(tmp_path), make_files(SECOND, revision="two"), request(1, "full"))
    for name, columns in {
        "edges": EDGE,
        "entities": ["revision", "id", "qualified_name", "start_line"],
        "chunks": ["revision", "point_id", "entity_id", "text"],
        "manifest": ["file_path", "content_hash", "revision"],
    }.items():
        mine = tables.read(spark, root, name)
        if "chunks" in name or name in ("edges", "entities"):
            mine = mine.filter("revision = 'two'")
        assert content(mine, columns) == content(tables.read(spark, str(tmp_path), name), columns), name


def test_earlier_revision_is_kept(spark, indexed):
    edges = tables.read(spark, indexed[0], "edges")
    assert edges.filter("revision = 'one'").count() > 0
    view = indexing.graph_view(
        tables.read(spark, indexed[0], "entities"), tables.read(spark, indexed[0], "revisions")
    )
    latest = {r.qualified_name: r.latest_revision for r in view.filter("kind = 'function'").collect()}
    assert latest["app.old.gone"] == "one" and latest["app.base.build"] == "two"


def test_same_job_twice_changes_nothing(spark, make_files, tmp_path):
    root = str(tmp_path)
    indexing.index_revision(spark, root, make_files(FIRST), request(1))
    before = content(tables.read(spark, root, "edges"), EDGE)
    again = indexing.index_revision(spark, root, make_files(FIRST), request(1)).first()
    assert again.skipped_files == 5
    assert content(tables.read(spark, root, "edges"), EDGE) == before


def test_failed_job_publishes_only_its_row(spark, make_files, indexed):
    root = indexed[0]
    before = content(tables.read(spark, root, "manifest"), ["file_path", "content_hash", "revision"])
    broken = make_files({**SECOND, "app/bad.py": "def broken(:\n"}, revision="three")
    job = indexing.index_revision(spark, root, broken, request(3)).first()
    assert (job.status, job.failed_files, job.deleted_file_count) == ("failed", 1, 0)
    assert content(tables.read(spark, root, "manifest"), ["file_path", "content_hash", "revision"]) == before
    assert tables.read(spark, root, "edges").filter("revision = 'three'").count() == 0
    assert {r.id: r.status for r in tables.read(spark, root, "jobs").collect()}["job3"] == "failed"


def test_graph_tables_have_unique_keys_and_known_ends(spark, indexed):
    current = indexing.load(spark, indexed[0])
    edges, entities, external = current["graph_edges"], current["graph_entities"], current["external"]
    assert edges.count() > 0 and upsert.duplicate_keys(edges, upsert.EDGE_KEY).isEmpty()
    assert upsert.duplicate_keys(entities, ["id"]).isEmpty()
    ends = entities.select("id").unionByName(external.select("id"))
    assert edges.join(entities, edges["source_id"] == entities["id"], "left_anti").isEmpty()
    assert edges.join(ends, edges["target_id"] == ends["id"], "left_anti").isEmpty()
    latest = {r.qualified_name: r.latest_revision for r in entities.filter("kind = 'function'").collect()}
    assert latest["app.old.gone"] == "one" and latest["app.extra.helper"] == "two"
    assert current["memberships"].filter("revision = 'two'").count() == current["entities"].filter("revision = 'two'").count()


def test_job_writes_only_its_own_partitions(spark, make_files, tmp_path):
    def written(name):
        rows = spark.read.parquet(f"{root}/{name}").select("_part", "_batch", "_metadata.file_path").distinct().collect()
        return {(r._part, r._batch, r.file_path) for r in rows}

    root = str(tmp_path)
    both = make_files(FIRST).unionByName(make_files(FIRST, repository="other"))
    indexing.index_revision(spark, root, both, request(1))
    before = {name: written(name) for name in ("edges", "manifest", "graph_entities", "postings", "jobs")}
    indexing.index_revision(spark, root, make_files(SECOND, revision="two"), request(2))
    for name, files in before.items():
        after = written(name)
        assert len({p for p, _, _ in after - files}) == 1, name
        kept = {p for p, _, _ in files} - {p for p, _, _ in files - after}
        assert len(kept) == (2 if name in ("edges", "postings") else 1), name


def test_revision_that_became_empty_is_replaced(spark, make_files, tmp_path):
    root = str(tmp_path)
    indexing.index_revision(spark, root, make_files({"a.py": "def f():\n    pass\n", "b.py": "x = 1\n"}), request(1))
    assert tables.read(spark, root, "chunks").count() == 1
    indexing.index_revision(spark, root, make_files({"b.py": "x = 1\n"}), request(2))
    assert tables.read(spark, root, "chunks").count() == 0
    assert {r.file_path for r in tables.read(spark, root, "manifest").collect()} == {"b.py"}


QUESTIONS = [
    (0, "Find `Shop`"),
    (1, "Show the implementation of Shop and Base"),
    (2, "Compare `Shop` versus `Base`"),
    (3, "Which design pattern does `Shop` use"),
    (4, "What calls does `open` make"),
    (5, "how are things built"),
    (6, "please reindex all"),
    (7, "Show the implementation of Nothing"),
    (8, "What depends on `Base`"),
    (9, "Who calls `helper`?"),
    (10, "What calls `open`"),
]


def test_answers(spark, indexed):
    """From the published tables alone, with both revisions in them."""
    index = answering.Index.stored(indexing.load(spark, indexed[0]))
    asked = spark.createDataFrame(
        [(i, q, "demo", "two") for i, q in QUESTIONS],
        "query_id int, query string, repository_id string, revision string",
    )
    answers = answering.answer(asked, index)
    got = {r.query_id: r for r in answers.collect()}
    assert got[0].answer == "Resolved: app.shop.Shop (class) at app/shop.py:3-6." and not got[0].partial
    assert got[1].agents_used == ["graph", "repository", "code_analyst"]
    assert "Multi-file source analysis:" in got[1].answer and "Shop is a class with 1" in got[1].answer
    assert "Compared Shop with Base; found" in got[2].answer
    assert "Inheritance-based framework extension" in got[3].answer
    assert "- app.shop.Shop.open CALLS app.base.build" in got[4].answer
    assert "- app.shop.Shop.open CALLS app.extra.helper" in got[4].answer
    # What points at the entity, and nothing that it points at.
    assert "- app.shop.Shop INHERITS_FROM app.base.Base" in got[8].answer and got[8].plan == "traverse"
    assert "CALLS" not in got[8].answer
    assert "- app.shop.Shop.open CALLS app.extra.helper" in got[9].answer and "build" not in got[9].answer
    assert got[10].answer.endswith("No matching graph relationships were found.")
    assert got[5].plan == "discovery" and got[5].answer.startswith("Resolved: ")
    assert got[6].partial and got[6].answer == "I could not gather repository evidence for: please reindex all"
    assert got[7].partial and "repository: A prior graph entity result is required for source verification" in got[7].warnings

    log = answering.turn_log(
        asked.withColumns(
            {
                "session_id": F.lit("s"), "user_id": F.lit("u"), "turn": F.col("query_id"),
                "asked_at": F.lit(datetime(2024, 1, 1)), "response_detail": F.lit("balanced"),
                "code_examples": F.lit("never"),
            }
        ),
        answers,
    )
    assert log["turns"].count() == 22
    assert "query" not in log["audits"].columns
    assert log["episodes"].filter("partial").count() == 2


def test_stored_definitions_equal_those_of_the_source(spark, make_files, indexed):
    """Carried and fresh rows together are what the revision's files say."""
    files = make_files(SECOND, revision="two")
    facts = extract.syntax_facts(files)
    made = {"extents": textops.file_extents(files), "analyses": structure.analyses(facts), "patterns": structure.patterns(facts)}
    current = indexing.load(spark, indexed[0])
    for name, want in made.items():
        columns = sorted(want.columns)
        assert content(current[name].filter("revision = 'two'"), columns) == content(want, columns), name


def test_answering_reads_no_source_text(spark, make_files, monkeypatch):
    """Every plan that is cut or returned, on an index that was made from files."""
    files = make_files(SECOND)
    facts = extract.syntax_facts(files)
    entities = resolve.distinct_entities(extract.entities(facts))
    edges = resolve.resolve(extract.references(facts), entities)
    chunks = index_chunks(entities, files)
    index = answering.Index(
        *map(cut_lineage, (textops.file_extents(files), entities, edges, chunks, structure.analyses(facts), structure.patterns(facts)))
    )
    plans = []

    def spied(frame):
        plans.append(frame._jdf.queryExecution().toString())
        return cut_lineage(frame)

    monkeypatch.setattr(answering, "cut_lineage", spied)
    asked = spark.createDataFrame(
        [(i, q, "demo", "one") for i, q in QUESTIONS], "query_id int, query string, repository_id string, revision string"
    )
    plans.append(answering.answer(asked, index)._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any(re.search(r"\bcontent#", plan) for plan in plans)


@pytest.mark.parametrize(
    ("text", "incoming"),
    [
        ("What depends on Widget?", True), ("which modules import `os`", True), ("Which classes inherit from `Base`?", True),
        ("Who calls run?", True), ("list the callers of `run`", True), ("What calls does `run` make", False),
        ("What does Widget depend on?", False), ("Which imports does `app` have", False), ("show imports of `app`", False),
    ],
)
def test_direction(spark, text, incoming):
    assert spark.range(1).select(questions.asks_incoming(F.lit(text))).first()[0] == incoming


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("What is the Widget class?", "entity_lookup"), ("What depends on Widget?", "dependency_traversal"),
        ("Show the implementation of Widget", "implementation"), ("Compare A and B", "comparison"),
        ("What design patterns are used?", "pattern_analysis"), ("re-index now", "indexing"),
        ("Explain the architecture", "architecture"), ("hello", "general"),
    ],
)
def test_intents(spark, text, intent):
    assert spark.range(1).select(questions.intent(F.lit(text))).first()[0] == intent
