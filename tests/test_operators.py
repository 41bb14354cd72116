"""Operators against brute force and exact expected rows."""

import hashlib
import math
import random
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.functions import ids, text
from srcgraph.functions.vectors import hash_vector
from srcgraph.operators import cells, evals, hybrid, lookup, responses, state, stats, textops, traverse, upsert, vectors
from srcgraph.session import ranked_within, running_last
from srcgraph.sources import corpus, suites


def column(spark, value, *expressions):
    row = spark.createDataFrame([(value,)], "v string").select(*[e(F.col("v")) for e in expressions]).first()
    return row[0] if len(expressions) == 1 else list(row)


@pytest.mark.parametrize(
    "value",
    ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029j", "\n\n", "x\n\r\n", "end\x85"],
)
def test_lines_are_those_of_python(spark, value):
    assert column(spark, value, text.lines) == value.splitlines()


@pytest.mark.parametrize("value", ["  a \t b \n", "\x1fa\u3000", "", " \n", "plain"])
def test_space_rules(spark, value):
    stripped, collapsed, right = column(spark, value, text.strip, text.collapse_space, text.rstrip)
    assert (stripped, collapsed, right) == (value.strip(), " ".join(value.split()), value.rstrip())


def chunk_by_hand(answer, limit=160):
    pieces = []
    while answer:
        cut = min(limit, len(answer))
        if cut < len(answer) and answer.rfind(" ", 0, cut + 1) > limit // 2:
            cut = answer.rfind(" ", 0, cut + 1) + 1
        pieces.append(answer[:cut])
        answer = answer[cut:]
    return pieces or [""]


def test_answer_chunks_by_hand(spark):
    chooser = random.Random(3)
    answers = ["".join(chooser.choice("abc  \né") for _ in range(n)) for n in (0, 1, 79, 160, 161, 162, 500, 1700)]
    answers += ["x" * 400, "a" * 80 + " " + "b" * 300, "a" * 81 + " " + "b" * 300, "w " * 300]
    rows = spark.createDataFrame([(a,) for a in answers], "v string")
    got = {r.v: r.c for r in rows.select("v", text.answer_chunks(F.col("v")).alias("c")).collect()}
    for answer in answers:
        assert got[answer] == [p if len(p) <= 160 else p for p in chunk_by_hand(answer)], answer[:20]


def test_module_names_and_ids(spark):
    for path, module in [
        ("web/routing.py", "web.routing"), ("web/__init__.py", "web"), ("__init__.py", ""),
        ("a/b.c.py", "a.b.c"), ("x", "x"),
    ]:
        assert column(spark, path, ids.module_name) == module
    got = column(spark, "repo", lambda v: ids.vector_id(v, F.lit("rev"), F.lit("class:1")))
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "repo:rev:class:1"))
    entity = column(spark, "r", lambda v: ids.entity_id(v, F.lit("p.py"), F.lit("class"), F.lit("p.A")))
    assert entity == "class:" + hashlib.sha256(b"r|p.py|class|p.A").hexdigest()


@pytest.mark.parametrize(
    ("imported", "package", "absolute"),
    [("a.b", "p.q", "a.b"), (".x", "p.q", "p.q.x"), ("..x", "p.q", "p.x"), ("...x", "p.q", "x"),
     ("....x", "p.q", "x"), (".", "p", "p"), (".x", "", "x")],
)
def test_absolute_imports(spark, imported, package, absolute):
    assert column(spark, imported, lambda v: ids.absolute_import(v, F.lit(package))) == absolute


@pytest.mark.parametrize("block", [1, 1_024])
def test_cosine_equals_brute_force(spark, monkeypatch, block):
    """Both ways (few queries, many queries) give the exact best chunks."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 7)
    chooser = np.random.default_rng(1)
    chunks = [(f"r{i % 3}", "one", f"c{i:03d}", chooser.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    chunks += [("r0", "one", f"same{i}", chunks[0][3]) for i in range(9)]
    asked = [(f"q{i}", f"r{i % 4}", "one", chooser.normal(size=8).astype(np.float32).tolist()) for i in range(5)]
    asked.append(("q9", "r0", "one", chunks[0][3]))
    frame = spark.createDataFrame(chunks, "repository_id string, revision string, entity_id string, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id string, repository_id string, revision string, embedding array<float>")
    got = {}
    for r in vectors.cosine_top_k(frame, queries, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.entity_id
    for query, repository, _, vector in asked:
        def score(other):
            a, b = np.asarray(vector, float), np.asarray(other, float)
            return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)

        best = sorted((-score(c[3]), c[2]) for c in chunks if c[0] == repository)[:6]
        assert [got.get(query, {}).get(i + 1) for i in range(len(best))] == [name for _, name in best]


def hand_rerank(question, hits):
    tokens = {t.lower() for t in __import__("re").findall(r"[A-Za-z_][A-Za-z0-9_]+", question) if len(t) > 3}

    def relevance(hit):
        hay = f"{hit['qualified_name']} {hit['text']}".lower()
        return sum(3 if "_" in t else 1 for t in tokens if t in hay)

    return sorted(hits, key=lambda h: (-relevance(h), -h["score"], h["entity_id"]))


def test_hybrid_equals_brute_force(spark):
    """Whole search on a small corpus: names, vectors, expansion, rerank and fusion by hand."""
    words = ["alpha", "beta", "gamma_ray", "solve_dependencies", "use_cache", "delta"]
    chooser = random.Random(5)
    rows = []
    for i in range(40):
        body = " ".join(chooser.choices(words, k=6))
        rows.append((f"id{i:02d}", "demo", "one", "function", f"{words[i % 6]}{i}", f"pkg.{words[i % 6]}{i}", body))
    entities = spark.createDataFrame(
        rows, "id string, repository_id string, revision string, kind string, name string, qualified_name string, text string"
    )
    chunks = entities.withColumnRenamed("id", "entity_id").withColumn("embedding", vectors.vectors.embed(F.col("text")))
    questions = [("q1", "beta"), ("q2", "nested dependency of gamma_ray"), ("q3", "  ")]
    asked = spark.createDataFrame([(q, "demo", "one", t) for q, t in questions], "query_id string, repository_id string, revision string, query string")
    got = {}
    for r in hybrid.hybrid_search(entities, chunks, asked, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.entity_id, round(r.score, 9)))
    for query, question in questions:
        exact = sorted(
            (0 if r[5] == question else 1 if r[4] == question else 2, r[5], r[0])
            for r in rows if question.lower() in r[4].lower() or question.lower() in r[5].lower()
        )[:10]
        wide = question + "\nRelevant code concepts: solve_dependencies dependency_cache use_cache" if "nested" in question else question
        near = []
        if question.strip():
            vector = hash_vector(wide).astype(np.float32).astype(float)
            for r in rows:
                other = hash_vector(r[6]).astype(np.float32).astype(float)
                score = float(vector @ other / (np.linalg.norm(vector) or 1) / np.linalg.norm(other))
                near.append({"entity_id": r[0], "qualified_name": r[5], "text": r[6], "score": round(score, 9)})
            near = hand_rerank(wide, sorted(near, key=lambda h: (-h["score"], h["entity_id"]))[:50])
        scores = {}
        for rank, item in enumerate(exact, 1):
            scores[item[2]] = scores.get(item[2], 0.0) + 1 / (60 + rank)
        for rank, hit in enumerate(near, 1):
            scores[hit["entity_id"]] = scores.get(hit["entity_id"], 0.0) + 1 / (60 + rank)
        best = sorted(scores, key=scores.__getitem__, reverse=True)[:5]
        assert got.get(query, []) == [(name, round(scores[name], 9)) for name in best], query


def test_symbol_rich_hit_beats_closer_vector(spark):
    rows = [
        ("q", "how does request_body_to_args report errors", "generic", "m.generic", "nothing here", 0.99),
        ("q", "how does request_body_to_args report errors", "rich", "m.request_body_to_args", "errors", 0.70),
    ]
    frame = spark.createDataFrame(rows, "query_id string, query string, entity_id string, qualified_name string, text string, score double")
    assert [r.entity_id for r in hybrid.rerank(frame).orderBy("rank").collect()] == ["rich", "generic"]


def test_find_entity_by_brute_force(spark):
    chooser = random.Random(2)
    names = ["".join(chooser.choices("abAB_", k=chooser.randint(1, 6))) for _ in range(80)]
    entities = [(f"e{i:02d}", "class" if i % 2 else "function", n, f"m{i % 3}.{n}") for i, n in enumerate(names)]
    asked = [(f"q{i}", n, kind) for i, (n, kind) in enumerate([("a", None), ("AB", None), ("bab", "class"), ("m1.", None), ("zzz", None), (names[4], None)])]
    found = lookup.find_entities(
        spark.createDataFrame(entities, "id string, kind string, name string, qualified_name string"),
        spark.createDataFrame(asked, "query_id string, name string, kind string"), 7,
    )
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for query, name, kind in asked:
        want = sorted(
            (0 if q == name else 1 if n == name else 2, q, i)
            for i, k, n, q in entities
            if (kind in (None, k)) and (name.lower() in n.lower() or name.lower() in q.lower())
        )[:7]
        assert got.get(query, []) == [i for _, _, i in want], name


def test_longer_names_read_no_postings(spark):
    """Names of four letters and more are found by their ends: with empty postings, at every length, hot or in one scope."""
    from dataclasses import replace

    from srcgraph.operators import postings

    names = [f"part_{i % 7}_of_{'x' * (i % 40)}{i}" for i in range(300)]
    rows = [(f"e{i:03d}", "class", n, f"pkg.{n}" if i % 2 else None, f"r{i % 2}", "one") for i, n in enumerate(names)]
    columns = "id string, kind string, name string, qualified_name string, repository_id string, revision string"
    entities = spark.createDataFrame(rows, columns).cache()
    asked = ["PART", "part_1", "pkg.", "xxxxx29", "of_" + "x" * 30, names[39], f"pkg.{names[199]}", "x" * 39, "no part_1", names[7][:-1] + "?"]
    queries = spark.createDataFrame([(f"q{i}", n, f"r{i % 2}", "one") for i, n in enumerate(asked)], "query_id string, name string, repository_id string, revision string")
    index = postings.build(entities)
    index = replace(index, postings=index.postings.limit(0))
    for scoped in (False, True):
        got = {(r.q, r.id) for r in lookup.contains_matches(index, queries, scoped).select("query.query_id", "id").toDF("q", "id").collect()}
        want = {
            (f"q{k}", i) for k, n in enumerate(asked) for i, _, name, qualified, repository, _ in rows
            if (n.lower() in name or n.lower() in (qualified or "")) and (not scoped or repository == f"r{k % 2}")
        }
        assert got == want


def test_names_of_any_length_need_no_postings(spark):
    """An index that only numbers its entities finds names of one to three letters by runs, in one scope or all."""
    from srcgraph.operators import postings

    names = [f"C{i}" for i in range(200)]
    rows = [(f"e{i:03d}", "class", n, f"pkg.m{i}.{n}", f"r{i % 2}", "one") for i, n in enumerate(names)]
    columns = "id string, kind string, name string, qualified_name string, repository_id string, revision string"
    asked = ["", "C", "c7", "C19", "m1", ".", "zz", "C190", "pkg.m7."]
    queries = spark.createDataFrame([(f"q{i}", n, f"r{i % 2}", "one") for i, n in enumerate(asked)], "query_id string, name string, repository_id string, revision string")
    index = postings.number(spark.createDataFrame(rows, columns))
    assert index.postings is None
    for queries_, known in ((queries, asked), (queries.filter("name = ''"), [""])):
        for scoped in (False, True):
            got = {(r.q, r.id) for r in lookup.contains_matches(index, queries_, scoped).select("query.query_id", "id").toDF("q", "id").collect()}
            want = {
                (f"q{k}", i) for k, n in enumerate(known) for i, _, name, qualified, repository, _ in rows
                if n and (n.lower() in name.lower() or n.lower() in qualified.lower()) and (not scoped or repository == f"r{k % 2}")
            }
            assert got == want


def test_block_hits_carry_no_ids(spark):
    """What blocks shuffle are numbers: long ids of any type cost nothing there, and ties still go by id."""
    rows = [("r", "one", f"{'long' * 40}{i:03d}", [1.0, float(i % 2)]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "repository_id string, revision string, entity_id string, embedding array<float>")
    asked = chunks.limit(3).select(F.struct("entity_id").alias("query_id"), "repository_id", "revision", "embedding")
    found = vectors.cosine_top_k(chunks, asked, 4)
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in shown.splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "entity_id" not in grouped and "query_id" not in grouped
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id.entity_id, []).append(r.entity_id)
    assert len(got) == 3
    for query, hits in got.items():
        assert hits == [e for _, _, e, _ in rows if int(e[-3:]) % 2 == int(query[-3:]) % 2][:4]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Queries of one vector share its search, in tasks of a few queries; each scope has its own."""
    searched = []
    block_hits = vectors._block_hits

    def counted(chunks, queries, *rest):
        searched.append(queries.count())
        return block_hits(chunks, queries, *rest)

    monkeypatch.setattr(vectors, "_block_hits", counted)
    monkeypatch.setattr(vectors, "QUERIES_TOGETHER", 4)
    chooser = np.random.default_rng(5)
    columns = "repository_id string, revision string, {} string, embedding array<float>"
    rows = [(f"r{i % 2}", "one", f"c{i:02d}", chooser.normal(size=3).tolist()) for i in range(20)]
    points = [[1.0, 0.0, 0.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]]
    asked = [(f"r{i % 2}", "one", f"q{i:02d}", points[i % 7 // 3]) for i in range(40)]
    found = vectors.cosine_top_k(
        spark.createDataFrame(rows, columns.format("entity_id")), spark.createDataFrame(asked, columns.format("query_id")), 3
    )
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.entity_id)
    assert searched == [6]
    unit = lambda v: np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float))
    for repository, _, query, vector in asked:
        near = sorted((-float(unit(vector) @ unit(v)), e) for r, _, e, v in rows if r == repository)[:3]
        assert got[query] == [e for _, e in near]


def test_names_are_looked_up_once(spark, monkeypatch):
    """Questions of one scope that mention the same name share its lookup."""
    from types import SimpleNamespace

    from srcgraph.operators import postings
    from srcgraph.plans import answer

    looked_up = []
    find = lookup.find_entities

    def counted(entities, queries, *rest, **named):
        looked_up.append(queries.count())
        return find(entities, queries, *rest, **named)

    monkeypatch.setattr(answer.lookup, "find_entities", counted)
    rows = [(f"r{i % 2}", "one", f"C{i}", f"e{i}", "class", f"m{i}.C{i}", f"m{i}.py", 1, 2) for i in range(6)]
    entities = spark.createDataFrame(
        rows, "repository_id string, revision string, name string, id string, kind string, qualified_name string, file_path string, start_line int, end_line int"
    )
    asked = [(f"q{i}", f"r{i % 2}", "one", "resolved", [("C0",), (f"C{i % 4}",)]) for i in range(12)]
    analysed = spark.createDataFrame(
        asked, "query_id string, repository_id string, revision string, plan string, entities array<struct<name: string>>"
    )
    index = SimpleNamespace(entities=entities, pieces=postings.number(entities), preferred_prefix="")
    got = {(r.query_id, r.position, r.requested_name, r.id) for r in answer._hits(analysed, index, {"resolved"}).collect()}
    want = {
        (query, place, name, f"e{name[1:]}")
        for query, repository, _, _, names in asked for place, (name,) in enumerate(names)
        if f"r{int(name[1:]) % 2}" == repository
    }
    assert looked_up == [5] and got == want


def test_cells_find_what_exact_search_finds(spark, monkeypatch):
    """Clustered vectors need few cells for the wanted recall, all cells give the exact result, a hot cell is cut to blocks."""
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 40)
    chooser = np.random.default_rng(3)
    centres = chooser.normal(size=(10, 16)) * 4
    kinds = np.where(np.arange(900) % 3 == 0, 0, chooser.integers(0, 10, 900))
    rows = [(f"r{i % 2}", "one", f"c{i:04d}", (centres[k] + chooser.normal(size=16)).tolist()) for i, k in enumerate(kinds)]
    rows += [("r0", "one", "none", None), ("r0", "one", "zero", [0.0] * 16)]
    frame = spark.createDataFrame(rows, "repository_id string, revision string, entity_id string, embedding array<double>")
    queries = frame.filter("embedding IS NOT NULL").select(F.col("entity_id").alias("query_id"), "repository_id", "revision", "embedding").filter("substring(entity_id, 5, 1) = '0'")
    index = cells.fit(frame, 12)
    stored = cells.assign(frame, index).cache()
    pairs = lambda found: {(r.query_id, r.entity_id) for r in found.collect()}
    exact = pairs(vectors.cosine_top_k(frame.filter("embedding IS NOT NULL"), queries, 5))
    assert pairs(vectors.cosine_top_k(stored, queries, 5, index)) == exact
    fewer = cells.measured(index, stored, queries, 5)
    assert fewer.probes < index.probes / 2
    assert len(exact & pairs(vectors.cosine_top_k(stored, queries, 5, fewer))) >= 0.9 * len(exact)
    assert cells.fit(frame.limit(0)) is None
    assert cells.measured(index, stored, queries.limit(0), 5) == index


def test_traversal_in_a_cycle_with_a_hot_node(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "hub")] + [("hub", f"x{i}") for i in range(400)] + [("x1", "y"), ("y", "z"), ("a", "b")]
    edges = spark.createDataFrame([(s, "CALLS", t, t != "z") for s, t in pairs], "source_id string, kind string, target_id string, resolved boolean")
    roots = spark.createDataFrame([("a",), ("c",)], "root string")
    got = {(r.root, r.source_id, r.target_id): r.depth for r in traverse.dependencies(edges, roots, 4).collect()}
    want = {}
    usable = {p for p in pairs if p[1] != "z"}
    for root in ("a", "c"):
        distance, layer = {root: 0}, [root]
        for d in range(1, 5):
            layer = [t for s in layer for f, t in usable if f == s and distance.setdefault(t, d) == d]
        want |= {(root, s, t): distance[s] + 1 for s, t in usable if distance.get(s, 9) < 4}
    assert got == want
    with pytest.raises(ValueError):
        traverse.dependencies(edges, roots, 6)


def test_traversal_with_many_roots_and_a_spread_hub(spark, monkeypatch):
    """Three blocks of roots, a hub that holds a third of the edges on several sub-keys, both directions."""
    monkeypatch.setattr(traverse, "EDGES_TOGETHER", 7)
    chance = random.Random(5)
    pairs = {(f"n{chance.randrange(150)}", f"n{chance.randrange(150)}") for _ in range(400)} | {("hub", f"n{i}") for i in range(150)} | {(f"n{i}", "hub") for i in range(0, 150, 30)}
    edges = spark.createDataFrame([(s, k, t, True) for s, t in pairs for k in ("CALLS", "IMPORTS")], "source_id string, kind string, target_id string, resolved boolean")
    names = [f"n{i}" for i in range(140)] + ["nowhere"]
    roots = spark.createDataFrame([(n,) for n in names + names[:9] + [None]], "root string")
    for incoming in (False, True):
        got = [tuple(r) for r in traverse.traverse(edges, roots, ["CALLS", "IMPORTS"], 3, incoming).select("root", "source_id", "kind", "target_id", "depth").collect()]
        want = set()
        near = [(t, s) if incoming else (s, t) for s, t in pairs]
        for root in names:
            distance, layer = {root: 0}, {root}
            for d in (1, 2):
                layer = {t for s, t in near if s in layer and t not in distance}
                distance |= dict.fromkeys(layer, d)
            for (s, t), (source, target) in zip(near, pairs):
                want |= {(root, source, k, target, distance[s] + 1) for k in ("CALLS", "IMPORTS") if s in distance}
        assert len(got) == len(want) and set(got) == want


def test_bounded_query_flags_truncation(spark):
    frame = spark.range(3).orderBy("id")
    assert [(r.id, r.truncated) for r in stats.bounded_query(frame, 2).collect()] == [(0, True), (1, True)]
    assert [r.truncated for r in stats.bounded_query(frame, 3).collect()] == [False] * 3


def test_ranks_and_carries_over_many_partitions(spark):
    rows = [("hot", i, f"v{i}" if i % 50 == 7 else None) for i in range(500)] + [("cold", 3, None)]
    frame = spark.createDataFrame(rows, "k string, n int, v string")
    ranked = ranked_within(frame.repartition(5), ["k"], ["n"]).collect()
    assert sorted((r.k, r.n, r["rank"]) for r in ranked) == sorted([("hot", i, i + 1) for i in range(500)] + [("cold", 3, 1)])
    carried = running_last(frame, ["k"], ["n"], F.floor(F.col("n") / 20), F.col("v"), "last").collect()
    for r in carried:
        seen = [i for i in range(r.n + 1) if r.k == "hot" and i % 50 == 7]
        assert r["last"] == (f"v{seen[-1]}" if seen else None)


def test_cache_scope_and_life(spark):
    start = datetime(2024, 1, 1)

    def key(query, revision="r1", detail="balanced"):
        return state.cache_key(F.lit("repo"), F.lit(revision), F.lit(query), F.lit(detail), F.lit("never"))

    keys = spark.range(1).select(key("What  IS x "), key("what is x"), key("what is x", "r2"), key("what is x", detail="concise")).first()
    assert keys[0] == keys[1] and len(set(keys)) == 3
    rows = [(1, 0, True, True), (2, 59, True, False), (3, 60, True, False), (4, 61, False, False), (5, 3601, True, False)]
    frame = spark.createDataFrame(
        [(i, start + timedelta(minutes=m), "k", e, s) for i, m, e, s in rows],
        "request_id int, asked_at timestamp, cache_key string, eligible boolean, stored boolean",
    )
    got = {r.request_id: r.cache_hit for r in state.cache_lookups(frame).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_sessions_split_at_the_idle_time(spark):
    start = datetime(2024, 1, 1)
    rows = [("u", start + timedelta(hours=h)) for h in (0, 23.9, 47.8, 71.8, 72, 96)]
    frame = spark.createDataFrame(rows, "u string, t timestamp")
    assert sorted(r.events for r in state.sessions(frame, "u", "t").collect()) == [1, 2, 3]


def test_recall_scope_and_episode_rules(spark):
    schema = "episode_id int, user_id string, repository_id string, revision string, query string, answer string, entities array<string>, partial boolean, created_at int"
    rows = [
        (1, "u", "r", "v", "routing of requests", "a", ["Router"], False, 1),
        (2, "u", "r", "v", "routing of requests", "a" * 5000, [], False, 2),
        (3, "u", "r", "v", "partial routing", "a", [], True, 3),
        (4, "u", "other", "v", "routing", "a", [], False, 4),
    ]
    memory = state.remember(spark.createDataFrame(rows, schema))
    assert {r.episode_id: len(r.answer) for r in memory.collect()} == {1: 1, 2: 4000, 4: 1}
    asked = spark.createDataFrame([("q", "u", "r", "what does the Router do in routing")], "query_id string, user_id string, repository_id string, query string")
    assert [r.episode_id for r in state.recall(memory, asked).orderBy("rank").collect()] == [1, 2]


def test_recall_of_a_user_with_most_rows_is_the_best_of_all_pairs(spark):
    vocabulary = [f"term{k}" for k in range(12)]
    pick = lambda seed, n: {vocabulary[(seed * 7 + k * k) % 12] for k in range(n)}
    memory = [(f"e{k}", "hot" if k % 3 else f"u{k % 5}", "r", " ".join(sorted(pick(k, 1 + k % 5))), ["x"], k) for k in range(60)]
    asked = [(f"q{k}", "hot" if k % 2 else f"u{k % 5}", "r", " ".join(sorted(pick(k + 3, k % 6)))) for k in range(80)]
    asked += [("none", None, "r", "term1"), ("null", "hot", "r", None)]
    expected = set()
    for query, user, _, words in asked:
        own, scores = set((words or "").split()), []
        for episode, theirs, _, remembered, _, made in memory:
            shared = own & set(remembered.split())
            if user == theirs and shared:
                scores.append((len(shared) / len(own | set(remembered.split())), made, episode))
        expected |= {(query, e, rank, round(score, 9)) for rank, (score, _, e) in enumerate(sorted(scores, reverse=True)[:3], 1)}
    episodes = spark.createDataFrame(memory, "episode_id string, user_id string, repository_id string, query string, entities array<string>, created_at int")
    questions = spark.createDataFrame(asked, "query_id string, user_id string, repository_id string, query string")
    got = {(r.query_id, r.episode_id, r["rank"], round(r.score, 9)) for r in state.recall(episodes, questions).collect()}
    assert got == expected and len(got) > 100


def test_a_model_sees_each_text_once_and_is_loaded_once_a_worker(spark, tmp_path):
    seen = str(tmp_path)

    def load():
        import os
        import uuid

        import numpy as np

        def model(texts):
            with open(f"{seen}/{os.getpid()}-{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        open(f"{seen}/loaded-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return model

    functions = vectors.vectors
    functions.EMBEDDERS["counting"] = functions.model_embedder("counting", load, rows=3)
    try:
        rows = [(k, "a" * (k % 7) if k % 3 else "common a") for k in range(90)] + [(90, None), (91, "")]
        made = functions.with_embedding(spark.createDataFrame(rows, "id int, text string"), "text", "counting")
        for _ in range(2):
            got = {r.id: r.embedding for r in made.collect()}
        assert got == {k: t if t is None else [len(t), t.count("a")] for k, t in rows}
        assert made.columns == ["id", "text", "embedding"]
    finally:
        del functions.EMBEDDERS["counting"]
    calls = [p for p in tmp_path.iterdir() if not p.name.startswith("loaded-")]
    texts = [t for p in calls for t in p.read_text().split("\n")]
    assert sorted(texts) == sorted({t for _, t in rows if t is not None})
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir() if p.name.startswith("loaded-")]
    assert len(loads) == len(set(loads))


@pytest.mark.parametrize(
    ("answer", "used", "status", "resolved"),
    [
        ("See [E1] and [2].", [1, 2], "ok", "See [a.py:1-2] and [graph: x -> y]."),
        ("Plain. ", [2], "ok", "Plain.\n\nSources: [graph: x -> y]"),
        ("See [E2].", [1], "invalid", None), ("See [E1].", [9], "invalid", None), ("No.", [], "invalid", None),
        ("See [E1] [E1, E2].", [1], "malformed", None),
    ],
)
def test_citations(spark, answer, used, status, resolved):
    frame = spark.createDataFrame([(1, answer, used, ["[a.py:1-2]", "[graph: x -> y]"])], "response_id int, answer string, used array<int>, labels array<string>")
    row = responses.resolve_citations(frame).first()
    assert (row.status, row.resolved_answer) == (status, resolved)


def test_percentiles_nearest_rank(spark):
    frame = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 100)], "latency_ms double")
    assert tuple(evals.summarise_latencies(frame).first()) == (10.0, 30.0, 100.0, 100.0)
    assert tuple(evals.summarise_latencies(frame.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
    values = [random.Random(1).random() for _ in range(37)]
    got = evals.summarise_latencies(spark.createDataFrame([(v,) for v in values], "latency_ms double")).first()
    assert got.p95_ms == round(sorted(values)[math.ceil(0.95 * 37) - 1], 3)


SUITE = """{"version": 1, "minimum_pass_rate": 1.0,
 "stream_cases": [{"id": "s", "query": "q", "required_events": ["token"], "minimum_token_events": 2}],
 "cases": [{"id": "a", "query": "What is Widget?", "expected_agents": ["graph"], "answer_term_groups": [["WIDGET", "x"]]},
           {"id": "b", "query": "q", "expected_source_paths_any": ["m.py"]}]}"""


def test_suite_scan_and_checks(spark, tmp_path):
    path = tmp_path / "suite.json"
    path.write_text(SUITE)
    suite = suites.read_suite(spark, str(path))
    wanted = spark.createDataFrame([("a",), ("s",), ("zz",)], "id string")
    assert [r.id for r in suites.unknown_ids(suite, wanted).collect()] == ["zz"]
    assert [r.id for r in suites.cases(suite, ["b"]).collect()] == ["b"]
    answers = spark.createDataFrame(
        [("a", 200, "a widget", ["graph"], [], False, "t", 5.0)],
        "id string, response_status int, answer string, agents_used array<string>, source_paths array<string>, partial boolean, trace_id string, latency_ms double",
    )
    got = {r.id: r for r in evals.golden_checks(suites.cases(suite), answers).collect()}
    assert got["a"].passed and got["a"].failures == []
    assert got["b"].failures == [
        "expected HTTP 200, received 0", "expected partial=False", "expected any source: ['m.py']",
        "response did not contain a trace ID",
    ]
    summary = evals.suite_summary(evals.golden_checks(suites.cases(suite), answers)).first()
    assert (summary.passed, summary.total, summary.accepted) == (1, 2, False)


def test_folder_scan_keeps_package_markers(spark, tmp_path):
    for name, body in {
        "demo/pkg/__init__.py": b"", "demo/pkg/a.py": b"x\n", "demo/.git/b.py": b"", "demo/venv/c.py": b"",
        "demo/revisions/one/pkg/a.py": b"y\n", "demo/revisions/one/_d/e.py": b"z", "demo/notes.txt": b"",
        "demo/pkg/bad.py": b"\xff\xfe",
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    files = corpus.source_files(corpus.scan_folder(spark, str(tmp_path)))
    got = sorted((r.origin, r.file_path, r.length) for r in files.collect())
    assert got == [
        ("checkout", "pkg/__init__.py", 0), ("checkout", "pkg/a.py", 2), ("checkout", "pkg/bad.py", 2),
        ("snapshot", "_d/e.py", 1), ("snapshot", "pkg/a.py", 2),
    ]
    wanted = spark.createDataFrame([("demo", "one")], "repository_id string, revision string")
    snapshots, checkouts = files.filter("origin = 'snapshot'"), files.filter("origin = 'checkout'")
    per_file = corpus.prefer_snapshot(snapshots, checkouts, wanted)
    assert {r.file_path: bytes(r.content) for r in per_file.collect()} == {
        "_d/e.py": b"z", "pkg/a.py": b"y\n", "pkg/__init__.py": b"", "pkg/bad.py": b"\xff\xfe",
    }
    assert corpus.prefer_snapshot(snapshots, checkouts, wanted, per_file=False).count() == 2
    assert [r.message for r in textops.unreadable(files).collect()] == ["Source file is not valid UTF-8"]


def test_folder_listing_prunes_and_takes_bytes_into_account(spark, tmp_path):
    rows = [
        ("a", None, "x/.git/c.py", "1"), ("a", None, "x/__pycache__/d.py", "2"), ("a", None, "x/y/z/e.py", "33"),
        ("a", None, "_f.py", ""), ("a", ".r", "g.py", "444"), (".b", None, "h.py", "5"), ("a", "r", "x/venv/i.py", "6"),
    ]
    files = spark.createDataFrame(rows, "repository_id string, revision string, file_path string, content string")
    corpus.write_folder(files, f"file:{tmp_path}")
    (tmp_path / "a" / "revisions" / "loose.py").write_text("no revision")
    (tmp_path / "a" / "x" / "loop").symlink_to(tmp_path / "a")
    got = corpus.list_folder(spark, str(tmp_path))
    assert sorted((r.repository_id, r.revision or "", r.file_path, r.length) for r in got.collect()) == [
        (".b", "", "h.py", 1), ("a", "", "_f.py", 0), ("a", "", "x/y/z/e.py", 2), ("a", ".r", "g.py", 3),
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        read = corpus.scan_folder(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() >= 6 and read.count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert corpus.list_folder(spark, str(tmp_path), ".none").count() == 0


def test_line_search_limit_and_flag(spark, make_files):
    files = make_files({"b.py": "One\n two ONE \n", "a.py": "none\nx\none"})
    rows = textops.line_search(files, "ONE", 3).collect()
    assert [(r.file_path, r.line, r.excerpt, r.truncated) for r in rows] == [
        ("a.py", 1, "none", True), ("a.py", 3, "one", True), ("b.py", 1, "One", True),
    ]
    assert {r.truncated for r in textops.line_search(files, "ONE", 5).collect()} == {False}
    with pytest.raises(ValueError):
        textops.line_search(files, "  ")


def test_snippets_clamp_and_reject(spark, make_files):
    files = make_files({"a.py": "1\n2\n3\n4\n5\n"})
    asked = [("a.py", 2, 3, 1), ("a.py", 4, 9, 50), ("a.py", 6, 6, 0), ("a.py", 3, 2, 0), ("a.py", 1, 1, 51), ("../a.py", 1, 1, 0)]
    requests = spark.createDataFrame([("demo", "one", *a) for a in asked], "repository_id string, revision string, file_path string, start_line int, end_line int, context_lines int")
    got = sorted((r.start_line, r.end_line, r.code) for r in textops.snippets(files, requests).collect())
    assert got == [(1, 4, "1\n2\n3\n4"), (1, 5, "1\n2\n3\n4\n5")]


def test_upserts_are_idempotent(spark):
    schema = "id string, value string, ord long"
    old = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], schema)
    new = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("c", "new", 1)], schema)
    once = upsert.merge_by_key(old, new, ["id"], "ord")
    twice = upsert.merge_by_key(once, new, ["id"], "ord")
    want = [("a", "last", 2), ("b", "old", 0), ("c", "new", 1)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    assert upsert.duplicate_keys(new, ["id"]).first().copies == 2


def test_location_text_deals_more_tasks_to_more_rows_in_one_shuffle(spark, monkeypatch):
    from srcgraph import catalog, session

    catalog.load()
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    found = catalog.QUERIES["location_text"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert found.rdd.getNumPartitions() == -(-rows // 100)


def test_idempotency_claims_by_bytes_of_the_digest(spark, monkeypatch):
    from srcgraph import catalog
    from srcgraph.operators import incremental

    catalog.load()
    claim_jobs, kinds = incremental.claim_jobs, []
    monkeypatch.setattr(incremental, "claim_jobs", lambda df: kinds.append(dict(df.dtypes)) or claim_jobs(df))
    found = catalog.QUERIES["idempotency"](spark, "/root/testdata/sf0.001")
    assert kinds[0]["identity"] == "binary"
    assert found.filter(F.length("identity") != 64).isEmpty() and dict(found.dtypes)["identity"] == "string"
