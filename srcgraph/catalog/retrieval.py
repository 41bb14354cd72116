"""Name lookup, vector search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.catalog import query
from srcgraph.catalog.code import BODIES, ENTITY_CTE
from srcgraph.functions import ids
from srcgraph.operators import cells, hybrid, lookup, vectors
from srcgraph.session import cut_lineage
from srcgraph.sources.adapters import table

# Parts as entities: a third of the names share a word, so pieces of names are hot.
PARTS = """
WITH entity AS (SELECT 'part:' || p_partkey AS id, lower(p_type) AS kind, p_name AS name,
    p_brand || '.' || p_name || '.' || p_partkey AS qualified_name, p_brand || '/' || p_size AS file_path
  FROM part),
asked AS (SELECT DISTINCT name, kind FROM (
  SELECT p_name AS name, NULL AS kind FROM part
  UNION ALL SELECT upper(string_split(p_name, ' ')[1]), NULL FROM part
  UNION ALL SELECT p_brand, lower(p_type) FROM part
  UNION ALL SELECT right(p_name, 2), NULL FROM part
  UNION ALL SELECT p_brand || '.' || p_name || '.' || p_partkey, NULL FROM part
  UNION ALL SELECT 'no ' || p_name, NULL FROM part)),
hit AS (SELECT asked.name AS query, coalesce(asked.kind, '') AS asked_kind, entity.*, row_number() OVER (
    PARTITION BY asked.name, asked.kind ORDER BY
      CASE WHEN qualified_name = asked.name THEN 0 WHEN entity.name = asked.name THEN 1 ELSE 2 END,
      qualified_name, id) AS rank
  FROM asked JOIN entity ON (asked.kind IS NULL OR asked.kind = entity.kind)
    AND (contains(lower(entity.name), lower(asked.name))
         OR contains(lower(qualified_name), lower(asked.name))))
"""


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part")
    qualified = F.concat_ws(".", "p_brand", "p_name", "p_partkey")
    entities = part.select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"),
        F.lower("p_type").alias("kind"),
        F.col("p_name").alias("name"),
        qualified.alias("qualified_name"),
        F.concat_ws("/", "p_brand", "p_size").alias("file_path"),
    )
    no_kind = F.lit(None).cast("string")
    forms = [
        (F.col("p_name"), no_kind),
        (F.upper(F.substring_index("p_name", " ", 1)), no_kind),
        (F.col("p_brand"), F.lower("p_type")),
        (F.right(F.col("p_name"), F.lit(2)), no_kind),
        (qualified, no_kind),
        (F.concat(F.lit("no "), "p_name"), no_kind),
    ]
    asked = F.array(*[F.struct(name.alias("name"), kind.alias("kind")) for name, kind in forms])
    queries = (
        part.select(F.explode(asked).alias("asked"))
        .select("asked.*")
        .distinct()
        .withColumn("query_id", F.concat_ws("|", "name", "kind"))
    )
    return entities, queries


@query("find_entity", PARTS + "SELECT query, asked_kind, rank, id, name, qualified_name FROM hit WHERE rank <= 20")
def find_entity(spark: SparkSession, folder: str) -> DataFrame:
    """Names, upper-case words, brands with a kind, two-letter ends, full names, misses."""
    entities, queries = _parts(spark, folder)
    found = lookup.find_entities(entities, queries, 20)
    return found.select(
        F.col("query.name").alias("query"),
        F.coalesce(F.col("query.kind"), F.lit("")).alias("asked_kind"),
        F.col("rank").cast("bigint").alias("rank"), "id", F.col("entity_name").alias("name"),
        "qualified_name",
    )


@query(
    "select_entity",
    PARTS
    + """SELECT query, asked_kind, id FROM (SELECT *, row_number() OVER (PARTITION BY query, asked_kind
    ORDER BY name = query DESC, kind IN ('class', 'function', 'method', 'module') DESC,
      (qualified_name = query OR ends_with(qualified_name, '.' || query)) DESC,
      starts_with(file_path, 'Brand#1/') DESC, rank) AS best
  FROM hit WHERE rank <= 20 AND (lower(name) = lower(query) OR lower(qualified_name) = lower(query)
    OR ends_with(lower(qualified_name), '.' || lower(query)))) WHERE best = 1""",
)
def select_entity(spark: SparkSession, folder: str) -> DataFrame:
    entities, queries = _parts(spark, folder)
    chosen = lookup.select_entities(lookup.find_entities(entities, queries, 20), "Brand#1/")
    return chosen.select(
        F.col("query.name").alias("query"),
        F.coalesce(F.col("query.kind"), F.lit("")).alias("asked_kind"), "id",
    )


# Vectors: the label is the repository; each label asks with its mean vector.
CENTROIDS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
centroid AS (SELECT label, list(m ORDER BY i) AS q FROM (
    SELECT label, i, round(avg(x), 6) AS m FROM (
      SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v) GROUP BY label, i) GROUP BY label),
near AS (SELECT label, vec_id, printf('v%08d', vec_id) AS entity_id, score, row_number() OVER (PARTITION BY label
    ORDER BY score DESC, printf('v%08d', vec_id)) AS rank
  FROM (SELECT v.label, vec_id, round(list_cosine_similarity(e, q), 9) AS score
        FROM v JOIN centroid USING (label)))
"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("repository_id"),
        F.lit("r1").alias("revision"),
        F.format_string("v%08d", "vec_id").alias("entity_id"),
        "vec_id",
        "label",
        "embedding",
    )


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector per label, summed per dimension so that no vectors are gathered."""
    means = (
        _chunks(spark, folder)
        .select("repository_id", "revision", F.posexplode("embedding").alias("i", "x"))
        .groupBy("repository_id", "revision", "i")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    )
    return means.groupBy("repository_id", "revision").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("embedding")
    ).withColumn("query_id", F.col("repository_id"))


@query(
    "cosine_topk",
    CENTROIDS + "SELECT label::VARCHAR AS query_id, entity_id, round(score, 6) AS score, rank FROM near WHERE rank <= 10",
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = vectors.cosine_top_k(_chunks(spark, folder), _centroids(spark, folder), 10)
    return hits.select(
        "query_id", "entity_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "vector_cells",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS rank
  FROM v AS q JOIN v ON q.vec_id % 50 = 0)
SELECT query_id, min(vec_id) FILTER (rank = 1) AS nearest, count(*) FILTER (rank <= 10) AS found, true AS recalled
FROM s GROUP BY query_id""",
)
def vector_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector asked of all vectors by their cells; recalled says that the hits hold 0.9 of the exact ones."""
    chunks = _chunks(spark, folder).withColumn("repository_id", F.lit("all"))
    index = cells.fit(chunks)
    stored = cut_lineage(cells.assign(chunks, index))
    asked = chunks.filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), "repository_id", "revision", "embedding"
    )
    index = cells.measured(index, stored, asked, 10)
    found = cut_lineage(vectors.cosine_top_k(stored, asked, 10, index).select("query_id", "entity_id", "rank"))
    exact = vectors.cosine_top_k(chunks, asked, 10).select("query_id", "entity_id")
    kept = exact.join(found, ["query_id", "entity_id"], "left").agg(F.count("rank") / F.count("*")).first()[0]
    numbered = found.withColumn("vec_id", F.substring("entity_id", 2, 20).cast("bigint"))
    return numbered.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("nearest"), F.count("*").alias("found")
    ).withColumn("recalled", F.lit(kept >= 0.9))


@query(
    "vector_carry",
    """SELECT label::VARCHAR AS repository_id, 'r2' AS revision, printf('v%08d', vec_id) AS entity_id,
  sha256(label || ':r2:' || printf('v%08d', vec_id)) AS name_hash, len(embedding) AS dimension
  FROM embeddings JOIN labels ON vec_id = doc_id WHERE quality = 1""",
)
def vector_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of files whose label is good move to revision r2."""
    chunks = _chunks(spark, folder).withColumn("file_path", F.col("vec_id").cast("string")).withColumn(
        "point_id", F.lit("")
    )
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    carried = chunks.join(good, chunks["vec_id"] == good["doc_id"], "left_semi").select(
        "repository_id", "revision", "file_path", F.lit("r2").alias("target_revision")
    )
    return vectors.carry_vectors(chunks, carried).select(
        "repository_id", "revision", "entity_id",
        F.sha2(F.concat_ws(":", "repository_id", "revision", "entity_id"), 256).alias("name_hash"),
        F.size("embedding").cast("bigint").alias("dimension"),
    )


@query(
    "vector_ids",
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3)
    || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
    || encode(source || ':r1:' || lang || '/' || doc_id)) AS h FROM documents)""",
)
def vector_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        ids.vector_id(
            F.col("source"), F.lit("r1"), F.concat_ws("/", "lang", "doc_id")
        ).alias("point_id"),
    )


# Questions that meet none, one or several expansion rules, by order priority and status.
_QUESTION = """CASE left(o_orderpriority, 1)
    WHEN '1' THEN 'Which validation error names PARAMETER k' || o_orderkey
    WHEN '2' THEN 'Does an async endpoint use a thread and what response is returned'
    WHEN '3' THEN 'Is a nested dependency solved for endpoint parameter k' || o_orderkey
    WHEN '4' THEN 'Where does validation happen'
    ELSE 'Recursive depends and await in a thread' END"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(priority == "1", F.concat(F.lit("Which validation error names PARAMETER k"), "o_orderkey"))
        .when(priority == "2", F.lit("Does an async endpoint use a thread and what response is returned"))
        .when(
            priority == "3",
            F.concat(F.lit("Is a nested dependency solved for endpoint parameter k"), "o_orderkey"),
        )
        .when(priority == "4", F.lit("Where does validation happen"))
        .otherwise(F.lit("Recursive depends and await in a thread"))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("query"))


_V = "request_body_to_args request_params_to_args _validate_value_with_model_field solve_dependencies field errors parameter processing"
_T = "run_endpoint_function is_coroutine run_in_threadpool"
_R = "serialize_response response_content Response"
_D = "solve_dependencies dependency_cache use_cache"
_P = "get_dependant analyze_param ModelField Dependant"


@query(
    "query_expand",
    f"""SELECT o_orderkey, query || CASE p WHEN '4' THEN '' ELSE chr(10) || 'Relevant code concepts: '
    || CASE p WHEN '1' THEN '{_V}' WHEN '2' THEN '{_T} {_R}' WHEN '3' THEN '{_D} {_P}'
       ELSE '{_T} {_D}' END END AS expanded
  FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS p, {_QUESTION} AS query FROM orders)""",
)
def query_expand(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("o_orderkey", hybrid.expand_query(F.col("query")).alias("expanded"))


def _described(spark: SparkSession, folder: str) -> DataFrame:
    """Vector rows with the text of the document of the same number."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return _chunks(spark, folder).join(documents, "vec_id").select(
        "repository_id", "revision", "entity_id", "embedding", "text", "lang",
        F.concat(F.lit("space.label_"), "label", F.lit("."), "entity_id").alias("qualified_name"),
        F.concat(F.lit("label_"), "label").alias("name"),
    )


_RERANK = (
    CENTROIDS.replace(
        "FROM (SELECT v.label, vec_id, round(list_cosine_similarity(e, q), 9) AS score\n        FROM v JOIN centroid USING (label))",
        "FROM (SELECT v.label, vec_id, round(list_cosine_similarity(e, q), 9) AS score\n"
        "        FROM v JOIN centroid USING (label) WHERE vec_id IN (SELECT doc_id FROM documents))",
    )
    + """, token AS (SELECT label, unnest(['label_' || label, 'with', 'that', 'sich', 'avec', 'from']) AS t FROM centroid),
kept AS (SELECT * FROM near WHERE rank <= 80),
scored AS (SELECT kept.*, (SELECT sum(CASE WHEN contains(lower('space.label_' || kept.label || '.' || entity_id
      || ' ' || d.text), t) THEN CASE WHEN contains(t, '_') THEN 3 ELSE 1 END ELSE 0 END)
    FROM token WHERE token.label = kept.label)::INTEGER AS relevance
  FROM kept JOIN documents d ON d.doc_id = kept.vec_id),
reranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY relevance DESC, score DESC, entity_id) AS place
  FROM scored)
"""
)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return _centroids(spark, folder).withColumn(
        "query", F.concat(F.lit("label_"), "query_id", F.lit(" with THAT and sich avec from it"))
    )


def _near(spark: SparkSession, folder: str) -> DataFrame:
    described = _described(spark, folder)
    asked = _asked(spark, folder)
    hits = vectors.cosine_top_k(described, asked, 80).drop("rank")
    return hits.join(asked.select("query_id", "query"), "query_id").join(
        described.select("entity_id", "qualified_name", "text"), "entity_id"
    )


@query(
    "rerank",
    _RERANK + "SELECT label::VARCHAR AS query_id, entity_id, relevance, place AS rank FROM reranked",
)
def rerank(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid.rerank(_near(spark, folder)).select(
        "query_id", "entity_id", "relevance", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "hybrid_rrf",
    _RERANK
    + """, exact AS (SELECT label, printf('v%08d', vec_id) AS entity_id, row_number() OVER (PARTITION BY label
      ORDER BY 'space.label_' || label || '.' || printf('v%08d', vec_id)) AS rank
    FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
part AS (SELECT label, entity_id, 0 AS pos, rank FROM exact WHERE rank <= 20
  UNION ALL SELECT label, entity_id, 1, place FROM reranked),
fused AS (SELECT label, entity_id,
    coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (pos = 0), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (pos = 1), 0) AS score,
    string_agg(CASE pos WHEN 0 THEN 'exact' ELSE 'semantic' END, '+' ORDER BY pos) AS sources,
    min(pos * 1000 + rank) AS seen FROM part GROUP BY ALL)
SELECT query_id, entity_id, score, sources, rank FROM (
  SELECT label::VARCHAR AS query_id, entity_id, round(score, 9) AS score, sources,
    row_number() OVER (PARTITION BY label ORDER BY score DESC, seen, entity_id) AS rank FROM fused)
WHERE rank <= 10""",
)
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Name matches of ``label_n`` fused with the reranked vector matches of the label's mean."""
    described = _described(spark, folder)
    entities = described.select(
        F.col("entity_id").alias("id"), "name", "qualified_name", "repository_id", "revision",
        F.lit("function").alias("kind"),
    )
    names = _asked(spark, folder).select(
        "query_id", "repository_id", "revision", F.concat(F.lit("label_"), "query_id").alias("name")
    )
    exact = lookup.find_entities(entities, names, 20, scoped=True).withColumnRenamed("id", "entity_id")
    fused = hybrid.fuse(exact, hybrid.rerank(_near(spark, folder)), 10)
    return fused.select(
        "query_id", "entity_id", F.round("score", 9).alias("score"),
        F.array_join("sources", "+").alias("sources"), F.col("rank").cast("bigint").alias("rank"),
    )


# Vectors are stored as 32-bit floats, so SQL rounds them likewise; scores tie at nine places.
_HYBRID = (
    ENTITY_CTE
    + f""", asked AS (SELECT eid AS query_id, repo, qualified_name AS query FROM entity WHERE kind = 'class'),
chunk AS (SELECT eid, repo, qualified_name, body FROM ({BODIES}) JOIN entity USING (repo, path, kind, qualified_name)),
token AS (SELECT 'c' AS side, eid AS k, repo, unnest(regexp_extract_all(lower(body), '[a-z_][a-z0-9_]*|[0-9]+')) AS t FROM chunk
  UNION ALL SELECT 'q', query_id, repo, unnest(regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*|[0-9]+')) FROM asked),
counted AS (SELECT side, k, repo, ('0x' || substr(md5(t), 1, 4))::INTEGER % 64 AS slot, count(*) AS c FROM token GROUP BY ALL),
scaled AS (SELECT side, k, repo, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY side, k)))::FLOAT::DOUBLE AS x FROM counted),
vector AS (SELECT side, k, repo, list_transform(range(64), lambda i: coalesce(map_from_entries(list((slot, x)))[i::INTEGER], 0.0::DOUBLE)) AS v
  FROM scaled GROUP BY side, k, repo),
near AS (SELECT * FROM (SELECT q.k AS query_id, c.k AS entity_id, round(list_cosine_similarity(q.v, c.v), 9) AS score,
    row_number() OVER (PARTITION BY q.k ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.k) AS place
  FROM vector q JOIN vector c USING (repo) WHERE q.side = 'q' AND c.side = 'c') WHERE place <= 50),
name AS (SELECT DISTINCT query_id, lower(w) AS w FROM (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]+')) AS w FROM asked)
  WHERE length(w) > 3),
relevant AS (SELECT near.query_id, entity_id, score, count(w) FILTER (contains(lower(qualified_name || ' ' || body), w)) AS relevance
  FROM near JOIN chunk ON chunk.eid = entity_id LEFT JOIN name USING (query_id) GROUP BY ALL),
part AS (
  SELECT query_id, entity_id, 1 AS position, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, entity_id) AS rank FROM relevant
  UNION ALL FROM (SELECT query_id, eid AS entity_id, 0 AS position, row_number() OVER (PARTITION BY query_id ORDER BY
      CASE WHEN qualified_name = query THEN 0 WHEN name = query THEN 1 ELSE 2 END, qualified_name, eid) AS rank
    FROM asked JOIN entity USING (repo) WHERE contains(lower(qualified_name), lower(query)) OR contains(lower(name), lower(query))) WHERE rank <= 10),
fused AS (SELECT query_id, entity_id, min(position * 1000 + rank) AS seen,
    string_agg(CASE position WHEN 0 THEN 'exact' ELSE 'semantic' END, '+' ORDER BY position) AS sources,
    coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (position = 0), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (position = 1), 0) AS total
  FROM part GROUP BY ALL)
SELECT query_id, entity_id, round(total, 6) AS score, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY total DESC, seen, entity_id) AS rank FROM fused) WHERE rank <= 5"""
)


@query("hybrid_search", _HYBRID)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """End to end over the code corpus: every class name asked of its own repository."""
    from srcgraph.catalog.shared import code_index

    index = code_index(spark, folder)
    questions = index.entities_of("class").select(
        F.col("id").alias("query_id"), "repository_id", "revision", F.col("qualified_name").alias("query")
    )
    found = hybrid.hybrid_search(index.entities, index.chunks, questions, 5, pieces=index.pieces)
    return found.select(
        "query_id", "entity_id", F.round("score", 6).alias("score"),
        F.array_join("sources", "+").alias("sources"), F.col("rank").cast("bigint").alias("rank"),
    )
