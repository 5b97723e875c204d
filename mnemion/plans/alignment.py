"""Queries of schemas found in data, bulk relationships and set overlap, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.operators import alignment as op
from mnemion.sources.tables import table

FAMILIES = {"type": 0.4, "size": 0.2, "nation": 0.4}


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the brand, type and size of their part and the nation of their supplier."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    return lines.join(parts, "l_partkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")


def _profiles(rows: DataFrame) -> DataFrame:
    return op.profiles(rows, "p_brand", type=F.col("p_type"), size=F.floor(F.col("p_size") / 5), nation=F.col("s_nationkey"))


def kind_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Brands shipped before a day against those shipped after it."""
    rows = _shipped(spark, d)
    early, late = (_profiles(rows.where(x)) for x in (F.col("l_shipdate") < "1998-05-24", F.col("l_shipdate") >= "1998-05-24"))
    return op.kind_similarity(early, late, FAMILIES)


def kind_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The same brands one to one. Taken round after round; tests hold it against one pass in the order of scores."""
    return op.aligned(kind_similarity(spark, d), 0.3)


def _schema(rows: DataFrame) -> DataFrame:
    """Brands as entities, their types as properties and the nations they come from as relationships."""
    no, brand = F.lit(False), F.col("p_brand")
    parts = [(F.lit("entity"), F.lit(""), brand, no, no), (F.lit("property"), brand, F.col("p_type"), no, no), (F.lit("relationship"), brand, F.col("s_nationkey").cast("string"), F.col("l_quantity") > 45, F.col("l_discount") > 0.08)]
    each = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, ("part", "owner", "name", "temporal", "causal"), strict=True)]) for p in parts]))
    return rows.select(each.alias("x")).select("x.*")


def schema_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The schema of the first lines shipped against that of all later ones."""
    rows = _shipped(spark, d)
    return op.schema_agreement(_schema(rows.where(F.col("l_shipdate") < "1995-02-01")), _schema(rows.where(F.col("l_shipdate") >= "1995-02-01")))


def edge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Supplies of all lines, where some orders and suppliers are missing and first lines are there already."""
    lines = table(spark, d, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("FROM").alias("rel"), "l_linenumber")
    orders = table(spark, d, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("id"))
    suppliers = table(spark, d, "supplier").where("s_nationkey != 7").select(F.col("s_suppkey").alias("id"))
    return op.edge_outcomes(edges.drop("l_linenumber"), orders, suppliers, edges.where("l_linenumber = 1"))


def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Of each supplier the parts of small lines and of large ones."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("item"), "l_quantity")
    return op.set_overlap(lines.where("l_quantity < 25"), lines.where("l_quantity >= 25")).withColumn("jaccard", F.round("jaccard", 9))


QUERIES = {f.__name__: f for f in (kind_similarity, kind_alignment, schema_agreement, edge_outcomes, set_overlap)}

SHIPPED = "l AS (SELECT l_shipdate, l_quantity, l_discount, p_brand, p_type, p_size, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"

SQL = {
    "kind_similarity": f"""WITH {SHIPPED}, f AS (SELECT l_shipdate >= TIMESTAMP '1998-05-24' AS late, p_brand AS kind, unnest(['type', 'size', 'nation']) AS family, unnest([p_type, (p_size // 5)::VARCHAR, s_nationkey::VARCHAR]) AS feature FROM l),
        p AS (SELECT late, kind, family, feature, count(*) / sum(count(*)) OVER (PARTITION BY late, kind, family) AS share FROM f GROUP BY 1, 2, 3, 4)
        SELECT a.kind AS found, b.kind AS reference, round(sum(CASE WHEN a.family = 'size' THEN 0.2 ELSE 0.4 END * least(a.share, b.share)), 9) AS score FROM p a JOIN p b ON NOT a.late AND b.late AND a.family = b.family AND a.feature = b.feature GROUP BY 1, 2""",
    "schema_agreement": f"""WITH {SHIPPED}, e AS (SELECT p_brand AS b, bool_or(l_shipdate < TIMESTAMP '1995-02-01') AS f, bool_or(l_shipdate >= TIMESTAMP '1995-02-01') AS r FROM l GROUP BY 1),
        p AS (SELECT p_brand AS b, p_type, bool_or(l_shipdate < TIMESTAMP '1995-02-01') AS f, bool_or(l_shipdate >= TIMESTAMP '1995-02-01') AS r FROM l GROUP BY 1, 2),
        q AS (SELECT bool_or(l_shipdate < TIMESTAMP '1995-02-01') AS f, bool_or(l_shipdate >= TIMESTAMP '1995-02-01') AS r, coalesce(bool_or(l_quantity > 45) FILTER (l_shipdate < TIMESTAMP '1995-02-01'), false) AS ft, coalesce(bool_or(l_quantity > 45) FILTER (l_shipdate >= TIMESTAMP '1995-02-01'), false) AS rt,
          coalesce(bool_or(l_discount > 0.08) FILTER (l_shipdate < TIMESTAMP '1995-02-01'), false) AS fc, coalesce(bool_or(l_discount > 0.08) FILTER (l_shipdate >= TIMESTAMP '1995-02-01'), false) AS rc FROM l GROUP BY p_brand, s_nationkey),
        x AS (SELECT coalesce(count(*) FILTER (f AND r) / nullif(count(*) FILTER (r), 0), 1.0) AS ec, coalesce(count(*) FILTER (f AND r) / nullif(count(*) FILTER (f), 0), 1.0) AS ep FROM e),
        y AS (SELECT coalesce(count(*) FILTER (f AND r) / nullif(count(*) FILTER (r), 0), 1.0) AS rc, coalesce(count(*) FILTER (f AND r) / nullif(count(*) FILTER (f), 0), 1.0) AS rp,
          coalesce(count(*) FILTER (f AND r AND rt AND ft) / nullif(count(*) FILTER (f AND r AND rt), 0), 1.0) AS tc, coalesce(count(*) FILTER (f AND r AND rc AND fc) / nullif(count(*) FILTER (f AND r AND rc), 0), 1.0) AS cc FROM q),
        z AS (SELECT coalesce(avg(s), 1.0) AS pa FROM (SELECT count(*) FILTER (p.f) / count(*) AS s FROM p JOIN e USING (b) WHERE p.r AND e.f AND e.r GROUP BY b)),
        w AS (SELECT *, 0.30 * ec + 0.30 * rc + 0.10 * ec + 0.10 * rc + 0.10 * pa + 0.05 * tc + 0.05 * cc AS a FROM x, y, z)
        SELECT round(ec, 9) AS entity_coverage, round(rc, 9) AS relationship_coverage, round(ec, 9) AS entity_matches, round(rc, 9) AS relationship_matches, round(pa, 9) AS property_alignment, round(tc, 9) AS temporal_correctness, round(cc, 9) AS causal_correctness,
          round(greatest(ep, ec), 9) AS entity_precision, round(greatest(rp, rc), 9) AS relationship_precision, round(a, 4) AS agreement, a >= 0.9 AS passes FROM w""",
    "edge_outcomes": """SELECT l_orderkey AS src, l_suppkey AS dst, 'FROM' AS rel, count(*) AS n, CASE WHEN any_value(o_orderkey) IS NULL THEN 'missing_source' WHEN any_value(s_suppkey) IS NULL THEN 'missing_target' WHEN bool_or(l_linenumber = 1) THEN 'exists' ELSE 'created' END AS outcome
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus != 'P' LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey != 7 GROUP BY 1, 2""",
    "set_overlap": """WITH x AS (SELECT l_suppkey AS key, l_partkey, bool_or(l_quantity < 25) AS a, bool_or(l_quantity >= 25) AS b FROM lineitem GROUP BY 1, 2)
        SELECT key, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right, round(count(*) FILTER (a AND b) / count(*), 9) AS jaccard FROM x GROUP BY 1""",
}
