"""Vector search and clustering on the driver tables."""

from pyspark.sql import functions as F

from plenum.functions.vector import cosine_distance, distance_to
from plenum.operators import aggregates, quality, similarity
from plenum.operators.windows import top_per_key
from plenum.plans.registry import query

DISTANCE_SQL = """SELECT e.vec_id, e.label,
      round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q"""


def query_vector(t):
    """The vector with the smallest id."""
    first = t("embeddings", "vec_id", "embedding")
    return first.agg(F.min_by("embedding", "vec_id").alias("q")).first()["q"]


@query("cosine_distance", f"SELECT vec_id, distance FROM ({DISTANCE_SQL})")
def distances(t):
    return t("embeddings", "vec_id", "embedding").select(
        "vec_id", distance_to("embedding", query_vector(t), 6).alias("distance")
    )


@query(
    "cosine_distance_pairs",
    """SELECT a.vec_id, a.label, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
        CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings
      GROUP BY label) b ON b.label = a.label""",
)
def distance_to_first(t):
    """Every vector against the first one of its label."""
    rows = t("embeddings", "vec_id", "label", "embedding")
    first = top_per_key(rows, ["label"], ["vec_id"], 1).select("label", F.col("embedding").alias("first"))
    return rows.join(first, "label").select(
        "vec_id", "label", cosine_distance("embedding", "first", 6).alias("distance")
    )


@query("nearest", f"SELECT vec_id, label, distance FROM ({DISTANCE_SQL}) ORDER BY distance, vec_id LIMIT 10")
def nearest(t):
    rows = t("embeddings", "vec_id", "label", "embedding")
    return similarity.knn(rows, query_vector(t), 10, id_="vec_id", digits=6).drop("embedding")


@query(
    "nearest_filtered",
    f"SELECT vec_id, label, distance FROM ({DISTANCE_SQL}) WHERE label IN (1, 3) ORDER BY distance, vec_id LIMIT 10",
)
def nearest_filtered(t):
    rows = t("embeddings", "vec_id", "label", "embedding")
    return similarity.knn(
        rows, query_vector(t), 10, id_="vec_id", where=F.col("label").isin(1, 3), digits=6
    ).drop("embedding")


@query("nearest_owner", f"SELECT label, min(distance) AS distance FROM ({DISTANCE_SQL}) GROUP BY label")
def nearest_owner(t):
    rows = t("embeddings", "label", "embedding")
    found = aggregates.nearest_owner(rows, query_vector(t), "label")
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "nearest_join",
    """SELECT left_id, right_id, distance, CAST(position AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS position
      FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id,
          round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
    WHERE position <= 3""",
)
def nearest_join(t):
    rows = t("embeddings", "vec_id", "embedding")
    return similarity.knn_join(rows, rows, 3, left_id="vec_id", right_id="vec_id", skip_same=True)


@query(
    "classify",
    """WITH nodes AS (SELECT label AS node_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
    scored AS (SELECT e.vec_id, n.node_id,
        round(1 - round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])), 6), 6) AS score
      FROM embeddings e, nodes n)
    SELECT vec_id, node_id, least(score, 1.0::DOUBLE) AS score FROM scored WHERE score >= 0.2
    UNION ALL
    SELECT vec_id, -1, 0.0 FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM scored WHERE score >= 0.2)""",
)
def classify(t):
    """The first vector of each label is the node of that label."""
    rows = t("embeddings", "vec_id", "label", "embedding")
    nodes = top_per_key(rows, ["label"], ["vec_id"], 1).select(F.col("label").alias("node_id"), "embedding")
    return similarity.classify(
        rows, nodes, 0.2, group_id="vec_id", node_id="node_id", unclassified=-1
    )


@query(
    "dimension_report",
    "SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n, len(embedding) = 64 AS conforms FROM embeddings GROUP BY ALL",
)
def dimension_report(t):
    return quality.dim_report(t("embeddings", "embedding"), "embedding", 64)


@query(
    "embed_backlog",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def embed_backlog(t):
    vectors = t("embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    rows = t("documents", "doc_id", "lang").join(vectors, "doc_id", "left")
    return similarity.embed_backlog(rows).select("doc_id", "lang")


@query(
    "concept_groups",
    """WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON
        round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) <= 0.52),
    reached AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM embeddings
      UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
    SELECT a AS vec_id, min(b) AS concept_group FROM reached GROUP BY a""",
)
def concept_groups(t):
    return similarity.concept_groups(t("embeddings", "vec_id", "embedding"), 0.52, id_="vec_id")
