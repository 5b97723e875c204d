"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.functions import vectors as v
from mnemion.operators import retrieval as op
from mnemion.operators.ranking import global_rank
from mnemion.plans.temporal import EDGES
from mnemion.sources.tables import causal_edges, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.doubles("embedding").alias("v"), "label")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches, against all rows."""
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest(_vectors(spark, d).select("id", "v"), _queries(spark, d), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest(_vectors(spark, d).select("id", "v"), _queries(spark, d), 10, "l2").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest(_vectors(spark, d).where("label in (1, 2, 3)").select("id", "v"), _queries(spark, d), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


KNN = """x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS query_id, v AS qv FROM x WHERE id % 20 = 0),
s AS (SELECT query_id, id, label, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS cos, 1 / (1 + list_distance(v, qv)) AS l2 FROM x, q WHERE id != query_id)"""


def _ranked(by: str, k: int, where: str = "true") -> str:
    return f"WITH {KNN}, r AS (SELECT query_id, id, {by} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({by}, 12) DESC, id)::INTEGER AS rank FROM s WHERE {where}) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").where("value is not null")
    a = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("id"), (F.col("value") / 1000.0).alias("score"))
    b = e.where("event_type = 'purchase' and user_id % 3 != 0").select(F.col("user_id").alias("id"), (F.col("value") / 500.0).alias("score"))
    return a, b


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return op.weighted_fusion(*_sides(spark, d), 0.3, 0.7).select("id", F.round("score", 9).alias("score"), "source")


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    lists = []
    for side in _sides(spark, d):
        best = side.groupBy("id").agg(F.max("score").alias("score"))
        lists.append(global_rank(best, F.desc("score"), "id"))
    return op.rank_fusion(lists).select("id", F.round("score", 12).alias("score"))


SIDES = """a AS (SELECT user_id AS id, max(value / 1000.0) AS vs FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1),
b AS (SELECT user_id AS id, max(value / 500.0) AS gs FROM events WHERE event_type = 'purchase' AND user_id % 3 != 0 AND value IS NOT NULL GROUP BY 1)"""


def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_type") == "click", "why did ").when(F.col("event_type") == "view", "When did ").when(F.col("event_type") == "error", "find ").otherwise("about "), "event_type").alias("q"))
    return asked.groupBy(op.intent(F.col("q")).alias("intent")).agg(F.count("*").alias("n"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return op.keyword_scores(table(spark, d, "documents"), ["license", "token", "thing"]).select("doc_id", F.round("score", 9).alias("score"))


def schema_compatible(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("id", (F.lit(1.0) + F.col("id") % 7).alias("score"), (F.col("label") % 6).alias("schema_version"))
    return op.compatible(rows, 5).select("id", F.round("score", 9).alias("score"))


def minmax_by_source(spark: SparkSession, d: str) -> DataFrame:
    return op.minmax(table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")), "source").select("doc_id", F.round("norm", 9).alias("norm"))


def distinct_signature(spark: SparkSession, d: str) -> DataFrame:
    return op.distinct_by_signature(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score")).where("text is not null")).select("id")


def balanced_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("score"))
    return op.balanced(rows, 50, "lang").select("id", "lang")


def boosts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in [*op.BOOSTS, "other"]])
    rows = _vectors(spark, d).select("id", F.element_at(kinds, (F.col("id") % 7).cast("int") + 1).alias("kind"), ((F.col("id") % 11) / 10.0).alias("c"))
    return rows.select("id", F.round(op.retrieval_boost(F.col("kind"), F.col("c")), 9).alias("boost"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return op.centroid(_vectors(spark, d), "label").select("label", F.round(v.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


def sequence_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Weights 0.9^i over a label's vectors in order of id."""
    from pyspark.sql import Window as W

    rows = _vectors(spark, d).withColumn("i", F.row_number().over(W.partitionBy("label").orderBy("id")) - 1)
    return op.centroid(rows, "label", F.pow(F.lit(0.9), F.col("i"))).select("label", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    u = v.unit(F.col("v"))
    return _vectors(spark, d).select("id", F.round(v.norm(u), 9).alias("norm"), F.round(u[0], 6).alias("first"))


def fused_embedding(spark: SparkSession, d: str) -> DataFrame:
    """0.6 of a vector and 0.4 of its label's centroid."""
    c = op.centroid(_vectors(spark, d), "label").withColumnRenamed("v", "c")
    mixed = F.zip_with("v", "c", lambda x, y: 0.6 * x + 0.4 * y)
    return _vectors(spark, d).join(c, "label").select("id", F.round(v.norm(mixed), 6).alias("norm"))


def embedding_quality(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", F.round(op.quality(F.col("v")), 6).alias("quality"))


def embedding_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector, vectors without a document, and the share of documents that have one."""
    docs, vecs = table(spark, d, "documents").select(F.col("doc_id").alias("id")), _vectors(spark, d).select("id")
    missing = docs.join(vecs, "id", "left_anti").agg(F.count("*").alias("missing"))
    orphans = vecs.join(docs, "id", "left_anti").agg(F.count("*").alias("orphans"))
    total = docs.agg(F.count("*").alias("total"))
    return missing.join(orphans).join(total).select("missing", "orphans", F.round(F.greatest(F.lit(0.0), (F.col("total") - F.col("missing")) / F.col("total")), 9).alias("ratio"))  # three single rows


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Questions are the stated set of vectors with intents in turn; entities are joined by consecutive events of one user."""
    intents = F.array(*[F.lit(x) for x in ("causal", "temporal", "lookup", "exploratory")])
    asked = _queries(spark, d).withColumn("intent", F.element_at(intents, ((F.col("query_id") / 20).cast("int") % 4) + 1))
    out = op.hybrid_search(_vectors(spark, d).select("id", "v"), causal_edges(spark, d), asked)
    return out.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "source", "via")


HYBRID = """n AS (SELECT query_id, id, round(cos, 12) AS vs, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 12) DESC, id) AS r FROM s),
v AS (SELECT * FROM n WHERE r <= 20), i AS (SELECT query_id, CASE query_id // 20 % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'temporal' WHEN 2 THEN 'lookup' ELSE 'exploratory' END AS intent FROM q),
b AS (SELECT src, dst, confidence AS c, true AS forth FROM g UNION ALL SELECT dst, src, confidence, false FROM g),
h1 AS (SELECT query_id, intent, node, max(gs) AS gs, arg_max(seed, (gs, -seed)) AS seed FROM (SELECT v.query_id, intent, dst AS node, vs * c * 0.5 AS gs, v.id AS seed FROM v JOIN i USING (query_id) JOIN b ON b.src = v.id WHERE r <= 10 AND (intent != 'causal' OR forth)) GROUP BY 1, 2, 3),
h2 AS (SELECT query_id, intent, node, max(gs) AS gs, arg_max(seed, (gs, -seed)) AS seed FROM (SELECT query_id, intent, dst AS node, gs * c * 0.5 AS gs, seed FROM h1 JOIN b ON b.src = h1.node WHERE intent = 'exploratory' OR intent = 'causal' AND forth) GROUP BY 1, 2, 3),
h3 AS (SELECT query_id, intent, node, max(gs) AS gs, arg_max(seed, (gs, -seed)) AS seed FROM (SELECT query_id, intent, dst AS node, gs * c * 0.5 AS gs, seed FROM h2 JOIN b ON b.src = h2.node WHERE intent = 'causal' AND forth) GROUP BY 1, 2, 3),
w AS (SELECT query_id, node AS id, max(gs) AS gs, arg_max(seed, (gs, -seed)) AS via FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2),
z AS (SELECT i.query_id, intent, (SELECT count(*) FROM v WHERE v.query_id = i.query_id) AS nv, (SELECT count(*) FROM w WHERE w.query_id = i.query_id) AS ng, CASE intent WHEN 'temporal' THEN -0.1 WHEN 'causal' THEN -0.15 WHEN 'lookup' THEN 0.1 ELSE 0 END AS t FROM i),
y AS (SELECT query_id, 0.5 + t + CASE WHEN ng < 5 AND nv > 10 THEN 0.1 ELSE 0 END AS a, 0.5 - t + CASE WHEN nv < 5 AND ng > 10 THEN 0.1 ELSE 0 END AS b FROM z),
f AS (SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.id, w.id) AS id, vs, gs, via FROM v FULL JOIN w ON v.query_id = w.query_id AND v.id = w.id),
k AS (SELECT f.query_id, id, round(coalesce(vs, 0) * a / (a + b) + coalesce(gs, 0) * b / (a + b), 9)::DOUBLE AS score, CASE WHEN gs IS NULL THEN 'vector' WHEN vs IS NULL THEN 'graph' ELSE 'hybrid' END AS source, via FROM f JOIN y ON y.query_id = f.query_id)"""


def diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    near = op.nearest(_vectors(spark, d).select("id", "v"), _queries(spark, d), 30)
    return op.diverse(near.join(_vectors(spark, d).select("id", "v"), "id"), 8)


QUERIES = {f.__name__: f for f in (knn_cosine, knn_l2, knn_filtered, weighted_fusion, rank_fusion, intent_rules, keyword_search, schema_compatible, minmax_by_source, distinct_signature, balanced_topk, boosts, centroids, sequence_embedding, unit_vectors, fused_embedding, embedding_quality, embedding_consistency, hybrid_search, diverse_topk)}

X = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT id, label, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM x)"
SQL = {
    "hybrid_search": f"WITH {KNN}, {EDGES}, {HYBRID} SELECT query_id, id, rank, round(score, 6) AS score, source, via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM k) WHERE rank <= 10",
    "knn_cosine": _ranked("cos", 10),
    "knn_l2": _ranked("l2", 10),
    "knn_filtered": _ranked("cos", 5, "label IN (1, 2, 3)"),
    "weighted_fusion": f"WITH {SIDES} SELECT coalesce(a.id, b.id) AS id, round(0.3 * coalesce(vs, 0) + 0.7 * coalesce(gs, 0), 9) AS score, CASE WHEN gs IS NULL THEN 'vector' WHEN vs IS NULL THEN 'graph' ELSE 'hybrid' END AS source FROM a FULL JOIN b ON a.id = b.id",
    "rank_fusion": f"WITH {SIDES}, r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY vs DESC, id)) AS s FROM a UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY gs DESC, id)) FROM b) SELECT id, round(sum(s), 12) AS score FROM r GROUP BY 1",
    "intent_rules": "SELECT CASE event_type WHEN 'click' THEN 'causal' WHEN 'view' THEN 'temporal' WHEN 'error' THEN 'lookup' ELSE 'exploratory' END AS intent, count(*) AS n FROM events GROUP BY 1",
    "keyword_search": "WITH h AS (SELECT doc_id, (contains(lower(text), 'license'))::INT + (contains(lower(text), 'token'))::INT + (contains(lower(text), 'thing'))::INT AS h FROM documents) SELECT doc_id, round(0.5 + 0.5 * h / 3, 9) AS score FROM h WHERE h > 0",
    "schema_compatible": "WITH r AS (SELECT vec_id AS id, 1.0 + vec_id % 7 AS s, 5 - label % 6 AS d FROM embeddings) SELECT id, round((s * CASE WHEN d <= 0 THEN 1 WHEN d = 1 THEN .95 ELSE .85 END)::DOUBLE, 9) AS score FROM r WHERE d <= 3",
    "minmax_by_source": "WITH m AS (SELECT doc_id, n_chars AS s, min(n_chars) OVER w AS lo, max(n_chars) OVER w AS hi FROM documents WINDOW w AS (PARTITION BY source)) SELECT doc_id, round(CASE WHEN hi > lo THEN (s - lo)::DOUBLE / (hi - lo) ELSE 1 END, 9) AS norm FROM m",
    "distinct_signature": "SELECT doc_id AS id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(text[:200]) ORDER BY n_chars DESC, doc_id) = 1",
    "balanced_topk": "WITH r AS (SELECT doc_id AS id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT id, lang FROM r WHERE r <= 50 ORDER BY (r > 35)::INT, n_chars DESC, id LIMIT 50",
    "boosts": "SELECT vec_id AS id, round((CASE vec_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN .9 WHEN 2 THEN .85 WHEN 3 THEN .85 WHEN 4 THEN .8 WHEN 5 THEN .75 ELSE .7 END * (.5 + .5 * (vec_id % 11) / 10.0))::DOUBLE, 9) AS boost FROM embeddings",
    "centroids": f"WITH {X}, m AS (SELECT label, i, avg(c) AS m FROM p GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS norm, round(max(m) FILTER (i = 1), 6) AS first FROM m GROUP BY 1",
    "sequence_embedding": f"WITH {X}, k AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS k FROM x), m AS (SELECT p.label, i, sum(c * pow(0.9, k)) / sum(pow(0.9, k)) AS m FROM p JOIN k ON k.id = p.id GROUP BY 1, 2) SELECT label, round(max(m) FILTER (i = 1), 6) AS first, round(max(m) FILTER (i = 64), 6) AS last FROM m GROUP BY 1",
    "unit_vectors": "WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM x",
    "fused_embedding": f"WITH {X}, m AS (SELECT label, i, avg(c) AS m FROM p GROUP BY 1, 2) SELECT id, round(sqrt(sum(pow(0.6 * c + 0.4 * m, 2))), 6) AS norm FROM p JOIN m ON m.label = p.label AND m.i = p.i GROUP BY 1",
    "embedding_quality": f"""WITH {X}, s AS (SELECT id, sqrt(sum(c * c)) AS n, stddev_pop(c) AS sd FROM p GROUP BY 1)
        SELECT id, round((CASE WHEN abs(n - 1) < .01 THEN 1 WHEN abs(n - 1) < .1 THEN .8 WHEN n > 0 THEN .5 ELSE 0 END + 1 + CASE WHEN sd < .001 THEN 0 WHEN sd < .01 THEN .3 WHEN sd < .1 THEN .7 ELSE least(1.0, 5 * sd) END) / 3, 6) AS quality FROM s""",
    "embedding_consistency": """WITH m AS (SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), o AS (SELECT count(*) AS orphans FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)), t AS (SELECT count(*) AS total FROM documents)
        SELECT missing, orphans, round(greatest(0.0, (total - missing)::DOUBLE / total), 9) AS ratio FROM m, o, t""",
}
