"""Queries of communities, temporal consistency, causal structure, graph patterns and rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.operators import attention as att
from mnemion.operators import communities as com
from mnemion.operators import consistency as con
from mnemion.operators import graph as gra
from mnemion.operators import patterns as pat
from mnemion.operators import relations as rel
from mnemion.operators import structure as stc
from mnemion.plans.graph import COMMUNITIES, _communities
from mnemion.plans.temporal import EDGES, E
from mnemion.sources.tables import causal_edges, event_nodes, knowledge_edges, table


def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    """(id, community) at the top, of customers and suppliers by lines. Moves depend on rounds; tests hold it against a literal loop."""
    edges, nodes = _communities(spark, d)
    levels = com.community_levels(edges, nodes, refine=False)
    top = levels.agg(F.max("level")).first()[0]
    return com.members(levels).where(F.col("level") == top).select("id", "community")


def community_levels(spark: SparkSession, d: str) -> DataFrame:
    """The levels of connected communities of parts and suppliers."""
    lines = table(spark, d, "lineitem").select(_named("p", "l_partkey").alias("src"), _named("s", "l_suppkey").alias("dst"))
    return com.community_levels(lines)


def _named(kind: str, c: str) -> Column:
    return F.concat(F.lit(kind), F.col(c).cast("string"))


def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    """What the nations add to modularity as communities of customers and suppliers."""
    edges, nodes = _communities(spark, d)
    return com.modularity(edges, nodes).select("community", "internal", "total", F.round("contribution", 9).alias("contribution"))


def joined_communities(spark: SparkSession, d: str) -> DataFrame:
    """Parts join the nation of most of their lines' suppliers."""
    lines = table(spark, d, "lineitem").select(_named("p", "l_partkey").alias("src"), _named("s", "l_suppkey").alias("dst"))
    suppliers = table(spark, d, "supplier").select(_named("s", "s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    found = com.joined_communities(lines, suppliers, table(spark, d, "part").select(_named("p", "p_partkey").alias("id")))
    return found.select("id", "community", F.round("share", 9).alias("share"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Customers in nations in regions as levels of a hierarchy."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    one = c.select(F.lit(1).alias("level"), _named("c", "c_custkey").alias("id"), _named("n", "c_nationkey").alias("parent"))
    two = n.select(F.lit(2).alias("level"), _named("n", "n_nationkey").alias("id"), _named("r", "n_regionkey").alias("parent"))
    three = table(spark, d, "region").select(F.lit(3).alias("level"), _named("r", "r_regionkey").alias("id"), F.lit("world").alias("parent"))
    return one.unionByName(two).unionByName(three)


def hierarchy_members(spark: SparkSession, d: str) -> DataFrame:
    return com.members(_places(spark, d))


def hierarchy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return com.ancestors(_places(spark, d))


def semantic_split(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label as a community, split around leaders. Greedy in the order of ids; tests hold it against the loop."""
    v = table(spark, d, "embeddings")
    return com.split_by_meaning(v.select(F.col("vec_id").alias("id"), F.col("label").alias("community")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def _relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Relations of consecutive events, among them turned ones, unknown ends and intervals, and events of which some lack a time."""
    edges = causal_edges(spark, d).select("src", "dst", "rel")
    more = (("src % 7 = 0", "dst", "src", "AFTER"), ("src % 11 = 0", "dst", "src", "BEFORE"), ("src % 13 = 0", "src", "-src - 1", "PREVENTS"), ("src % 3 = 0", "dst", "src", "DURING"), ("src % 3 = 1", "src", "dst", "CONTAINS"), ("src % 19 = 0", "src", "dst", "SIMULTANEOUS"), ("src % 19 = 1", "src", "src", "SIMULTANEOUS"))
    # Every relation of a pair is a row of its own: made in one pass over the pairs.
    rows = [F.when(F.expr(where), F.struct(F.expr(a).alias("src"), F.expr(b).alias("dst"), F.lit(rel).alias("rel"))) for where, a, b, rel in (("true", "src", "dst", ""), *more)]
    rows[0] = F.struct("src", "dst", "rel")
    relations = edges.select(F.explode(F.array(*rows)).alias("r")).where("r is not null").select("r.*")
    events = event_nodes(spark, d).select("id", F.when(F.col("id") % 17 != 0, F.col("t")).alias("t"), (F.col("id") % 5 * 600_000_000).alias("duration"))
    return relations, events


def temporal_cycles(spark: SparkSession, d: str) -> DataFrame:
    return con.cycles(_relations(spark, d)[0])


def transitive_violations(spark: SparkSession, d: str) -> DataFrame:
    return con.transitive_violations(*_relations(spark, d))


def relation_violations(spark: SparkSession, d: str) -> DataFrame:
    return con.pair_violations(*_relations(spark, d))


def consistency_report(spark: SparkSession, d: str) -> DataFrame:
    return con.report(con.violations(*_relations(spark, d), strict=False))


def independence_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of event types, alone and given any other type."""
    events = event_nodes(spark, d).select("entity", "ts", "type")
    types = stc.event_types(events)
    bits = spark.createDataFrame([(t, 1 << i) for i, t in enumerate(types)], "name string, bit long")
    a, b = bits.select(F.col("name").alias("type_a"), F.col("bit").alias("a")), bits.select(F.col("name").alias("type_b"), F.col("bit").alias("b"))
    given = bits.select(F.col("name").alias("given_type"), F.col("bit").alias("given")).unionByName(spark.createDataFrame([("", 0)], "given_type string, given long"))
    named = a.join(F.broadcast(b), F.col("a") < F.col("b")).join(F.broadcast(given), F.col("given").bitwiseAND(F.col("a").bitwiseOR(F.col("b"))) == 0)  # types only
    tested = stc.independence(stc.presence(events, types), named.select("a", "b", "given"))
    return tested.join(named, ["a", "b", "given"]).select("type_a", "type_b", F.col("given_type").alias("given"), F.round("g", 4).alias("g"), "dof", (F.col("p_value") > 0.05).alias("independent"))


def causal_structure(spark: SparkSession, d: str) -> DataFrame:
    events = event_nodes(spark, d).select("entity", "ts", "type")
    return stc.causal_structure(events, stc.type_order(causal_edges(spark, d)))


def _typed_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, orders, parts, suppliers, nations and regions, with their labels."""
    kinds = {"customer": ("customer", "c_custkey"), "order": ("orders", "o_orderkey"), "part": ("part", "p_partkey"), "supplier": ("supplier", "s_suppkey"), "nation": ("nation", "n_nationkey"), "region": ("region", "r_regionkey")}
    link = lambda t, a, x, b, y, rel: table(spark, d, t).select(_named(f"{a}:", x).alias("src"), _named(f"{b}:", y).alias("dst"), F.lit(rel).alias("rel"))
    edges = knowledge_edges(spark, d).select("src", "dst", "rel")
    for row in (("customer", "customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"), ("nation", "nation", "n_nationkey", "region", "n_regionkey", "PART_OF")):
        edges = edges.unionByName(link(*row))
    nodes = None
    for label, (t, key) in kinds.items():
        some = table(spark, d, t).select(_named(f"{label}:", key).alias("id"), F.lit(label).alias("label"))
        nodes = some if nodes is None else nodes.unionByName(some)
    return edges, nodes


def frequent_patterns(spark: SparkSession, d: str) -> DataFrame:
    return pat.frequent_patterns(*_typed_graph(spark, d), size=3, least=2)


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges with regions of two thirds of the customers, a fifth of them wrong, and rules that may explain them."""
    edges, _ = _typed_graph(spark, d)
    c = table(spark, d, "customer").where("c_custkey % 3 != 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wrong = F.when(F.col("c_custkey") % 5 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    edges = edges.unionByName(c.select(_named("customer:", "c_custkey").alias("src"), F.concat(F.lit("region:"), wrong.cast("string")).alias("dst"), F.lit("IN_REGION").alias("rel")))
    rules = [("place", ["LOCATED_IN", "PART_OF"], "IN_REGION"), ("trade", ["PLACED", "CONTAINS", "SUPPLIED_BY", "LOCATED_IN"], "LOCATED_IN")]
    return edges, spark.createDataFrame(rules, "rule string, path array<string>, conclusion string")


def rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = pat.rule_metrics(*_rules(spark, d))
    return found.select("rule", "support", "true_positives", "false_positives", "false_negatives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def missing_edges(spark: SparkSession, d: str) -> DataFrame:
    return pat.missing_edges(*_rules(spark, d))


def _told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A text for each entity that tells its pairs of events, some without a cause and some the wrong way round, and its events' names."""
    verb = F.expr("case src % 5 when 0 then 'led to' when 1 then 'was an important reason for and directly triggered' when 2 then 'came before' when 3 then 'prevented' else 'was due to' end")
    name = lambda kind, c: F.concat_ws(" ", F.initcap(kind), F.lit("number"), F.col(c).cast("string"))
    told = F.concat(name("src_type", "src"), F.lit(" "), verb, F.lit(" the "), name("dst_type", "dst"), F.lit("."))
    texts = causal_edges(spark, d).groupBy(F.col("entity").alias("id")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(told))).alias("text"))
    return texts, event_nodes(spark, d).select(F.col("entity").alias("id"), name("type", "id").alias("name"), "t")


def causal_sentences(spark: SparkSession, d: str) -> DataFrame:
    return rel.causal_candidates(*_told(spark, d)).select("id", "cause", "effect", "relation", "evidence", "confidence")


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """How often the parts' names of two words or more occur in other parts' names and kinds."""
    p = table(spark, d, "part")
    texts = p.select(F.col("p_partkey").alias("id"), F.concat_ws(". ", "p_type", "p_name", "p_brand", "p_name").alias("text"))
    return rel.phrase_mentions(texts, p.select(F.col("p_name").alias("name")).distinct()).groupBy("id", "name").agg(F.count("*").alias("n")).groupBy("name").agg(F.count("*").alias("parts"), F.sum("n").alias("n"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every vector whose id is divisible by 100 asks, from the part of its id; parts and suppliers, and vectors of parts."""
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    seeds = queries.select("query", _named("p", "query").alias("id"))
    edges = table(spark, d, "lineitem").select(_named("p", "l_partkey").alias("src"), _named("s", "l_suppkey").alias("dst")).distinct()
    return queries, seeds, edges, v.select(_named("p", "vec_id").alias("id"), F.col("embedding").alias("vector"))


def multi_hop_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of the parts that they contain."""
    docs = table(spark, d, "lineitem").select(_named("p", "l_partkey").alias("id"), F.col("l_orderkey").alias("doc")).distinct()
    return att.multi_hop(*_asked(spark, d), docs).select("query", "doc", F.round("score", 6).alias("score"))


def graph_attention(spark: SparkSession, d: str) -> DataFrame:
    """Node scores after two rounds between all parts that share a supplier; tests hold them against a loop in numpy."""
    queries, seeds, edges, nodes = _asked(spark, d)
    # Only parts with a vector send or take messages.
    near = edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return att.attention(queries, seeds, gra.sharing(near), nodes).select("query", "id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (louvain_communities, community_levels, community_modularity, joined_communities, hierarchy_members, hierarchy_ancestors, semantic_split, temporal_cycles, transitive_violations, relation_violations, consistency_report, independence_tests, causal_structure, frequent_patterns, rule_metrics, missing_edges, causal_sentences, part_names, multi_hop_documents, graph_attention)}

PLACES = """p AS (SELECT 1 AS level, 'c' || c_custkey AS id, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 2, 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 3, 'r' || r_regionkey, 'world' FROM region)"""

RELATIONS = f"""{EDGES}, rel AS (SELECT src, dst, rel FROM g UNION ALL SELECT dst, src, 'AFTER' FROM g WHERE src % 7 = 0 UNION ALL SELECT dst, src, 'BEFORE' FROM g WHERE src % 11 = 0 UNION ALL SELECT src, -src - 1, 'PREVENTS' FROM g WHERE src % 13 = 0
  UNION ALL SELECT dst, src, 'DURING' FROM g WHERE src % 3 = 0 UNION ALL SELECT src, dst, 'CONTAINS' FROM g WHERE src % 3 = 1 UNION ALL SELECT src, dst, 'SIMULTANEOUS' FROM g WHERE src % 19 = 0 UNION ALL SELECT src, src, 'SIMULTANEOUS' FROM g WHERE src % 19 = 1),
ev AS (SELECT id, CASE WHEN id % 17 != 0 THEN t END AS t, (id % 5) * 600000000 AS d FROM e),
o AS (SELECT DISTINCT CASE WHEN rel = 'AFTER' THEN dst ELSE src END AS a, CASE WHEN rel = 'AFTER' THEN src ELSE dst END AS b FROM rel WHERE rel IN ('BEFORE', 'AFTER', 'CAUSES', 'ENABLES', 'TRIGGERS', 'PREVENTS')),
way AS (SELECT a, b FROM o UNION SELECT way.a, o.b FROM way JOIN o ON o.a = way.b),
cyc AS (SELECT x.a AS id, min(x.b) AS cycle FROM way x JOIN way y ON y.a = x.b AND y.b = x.a GROUP BY 1),
tra AS (SELECT way.a AS src, way.b AS dst, x.t AS t_src, y.t AS t_dst FROM way JOIN ev x ON x.id = way.a JOIN ev y ON y.id = way.b WHERE way.a != way.b AND x.t >= y.t),
pv AS (SELECT rel.*, CASE WHEN rel IN ('CAUSES', 'ENABLES', 'TRIGGERS', 'PREVENTS') THEN CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'unknown_event' WHEN x.t IS NULL OR y.t IS NULL THEN 'missing_time' WHEN x.t >= y.t THEN 'causal_order' END
  WHEN x.t IS NULL OR y.t IS NULL THEN NULL WHEN rel = 'DURING' AND y.d != 0 AND NOT (x.t BETWEEN y.t AND y.t + y.d) THEN 'interval' WHEN rel = 'CONTAINS' AND x.d != 0 AND NOT (y.t BETWEEN x.t AND x.t + x.d) THEN 'interval'
  WHEN rel = 'SIMULTANEOUS' AND x.t != y.t THEN 'interval' END AS violation FROM rel LEFT JOIN ev x ON x.id = src LEFT JOIN ev y ON y.id = dst)"""

GRAPH = """e AS (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'PLACED' AS rel FROM orders UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN' FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation)"""

RULES = f"""{GRAPH}, h AS (SELECT * FROM e UNION SELECT 'customer:' || c_custkey, 'region:' || CASE WHEN c_custkey % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END, 'IN_REGION' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 != 0),
q AS (SELECT DISTINCT 'place' AS rule, 'IN_REGION' AS conclusion, a.src AS head, b.dst AS tail FROM h a JOIN h b ON b.src = a.dst WHERE a.rel = 'LOCATED_IN' AND b.rel = 'PART_OF'
  UNION ALL SELECT DISTINCT 'trade', 'LOCATED_IN', a.src, x.dst FROM h a JOIN h b ON b.src = a.dst JOIN h c ON c.src = b.dst JOIN h x ON x.src = c.dst WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND c.rel = 'SUPPLIED_BY' AND x.rel = 'LOCATED_IN'),
z AS (SELECT rule, h.src AS head, h.dst AS tail FROM h JOIN (VALUES ('place', 'IN_REGION'), ('trade', 'LOCATED_IN')) v(rule, c) ON h.rel = c)"""


def _pattern_sql(size: int = 3, least: int = 2) -> str:
    """One count over joins for each tree that the labels and relations allow."""
    ways = {"customer": (("LOCATED_IN", "nation"), ("PLACED", "order")), "order": (("CONTAINS", "part"),), "part": (("SUPPLIED_BY", "supplier"),), "supplier": (("LOCATED_IN", "nation"),), "nation": (("PART_OF", "region"),), "region": ()}

    def trees(label: str, k: int, after: str = "") -> list[list]:
        """Lists of (relation, (label, subtree)) with k edges in all, relations in order."""
        if k == 0:
            return [[]]
        return [[(rel, (end, below)), *rest] for rel, end in ways[label] if rel > after for j in range(k) for below in trees(end, j) for rest in trees(label, k - 1 - j, rel)]

    def name(label: str, tree: list) -> str:
        return label + ("[" + ",".join(f"{rel}>{name(*sub)}" for rel, sub in tree) + "]" if tree else "")

    def joins(tree: list, root: str, out: list[str]) -> list[str]:
        for rel, (_, below) in tree:
            x = f"e{len(out)}"
            out.append(f"JOIN e {x} ON {x}.src = {root} AND {x}.rel = '{rel}'")
            joins(below, f"{x}.dst", out)
        return out

    every = [(label, t, k) for k in range(1, size + 1) for label in ways for t in trees(label, k)]
    counts = [f"SELECT '{name(label, t)}' AS signature, {k} AS edges, count(DISTINCT r.src) AS support, count(*) AS matches FROM (SELECT DISTINCT src FROM e WHERE src LIKE '{label}:%') r {' '.join(joins(t, 'r.src', []))}" for label, t, k in every]
    return f"WITH {GRAPH} SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE support >= {least}"


SQL = {
    "community_modularity": f"WITH {COMMUNITIES}, s AS (SELECT c AS community, sum(w)::DOUBLE AS internal, sum(t)::DOUBLE AS total FROM (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS w, 1 AS t FROM x UNION ALL SELECT cb, 0, 1 FROM x) GROUP BY 1) SELECT community, internal, total, round(2 * internal / sum(total) OVER () - pow(total / sum(total) OVER (), 2), 9) AS contribution FROM s",
    "joined_communities": """WITH n AS (SELECT l_partkey AS p, s_nationkey AS c, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), b AS (SELECT p, c, n / sum(n) OVER (PARTITION BY p) AS share, row_number() OVER (PARTITION BY p ORDER BY n DESC, c) AS r FROM n)
        SELECT 'p' || p_partkey AS id, CASE WHEN share > 0.3 THEN c END AS community, round(coalesce(share, 0), 9) AS share FROM part LEFT JOIN b ON p = p_partkey AND r = 1""",
    "hierarchy_members": f"WITH RECURSIVE {PLACES}, m AS (SELECT level, id, parent AS community FROM p WHERE level = 1 UNION ALL SELECT p.level, m.id, p.parent FROM m JOIN p ON p.level = m.level + 1 AND p.id = m.community) SELECT * FROM m",
    "hierarchy_ancestors": f"WITH RECURSIVE {PLACES}, m AS (SELECT level - 1 AS level, id AS community, level AS ancestor_level, parent AS ancestor FROM p WHERE level > 1 UNION ALL SELECT m.level, m.community, p.level, p.parent FROM m JOIN p ON p.level = m.ancestor_level + 1 AND p.id = m.ancestor) SELECT * FROM m",
    "temporal_cycles": f"WITH RECURSIVE {RELATIONS} SELECT id, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM cyc",
    "transitive_violations": f"WITH RECURSIVE {RELATIONS} SELECT * FROM tra",
    "relation_violations": f"WITH RECURSIVE {RELATIONS} SELECT src, dst, rel, violation, CASE WHEN violation IN ('causal_order', 'missing_time') THEN 'error' ELSE 'warning' END AS severity FROM pv WHERE violation IS NOT NULL",
    "consistency_report": f"""WITH RECURSIVE {RELATIONS}, v AS (SELECT 'cycle' AS violation, true AS error FROM cyc UNION ALL SELECT 'transitivity', true FROM tra UNION ALL SELECT violation, violation = 'causal_order' FROM pv WHERE violation IS NOT NULL)
        SELECT violation, count(*) FILTER (error) AS errors, count(*) FILTER (NOT error) AS warnings FROM v GROUP BY 1""",
    "independence_tests": f"""WITH e AS ({E}), u AS (SELECT entity, ts::DATE AS day, list_sort(list(DISTINCT type)) AS ts FROM e GROUP BY 1, 2), k AS (SELECT (SELECT count(DISTINCT entity) FROM u) * (SELECT date_diff('day', min(day), max(day)) + 1 FROM u) AS units),
        p AS (SELECT ts, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT [], units - (SELECT count(*) FROM u) FROM k), t AS (SELECT DISTINCT type FROM e),
        c AS (SELECT a.type AS type_a, b.type AS type_b, s.type AS given, list_contains(ts, a.type) AS x, list_contains(ts, b.type) AS y, list_contains(ts, s.type) AS z, sum(n)::DOUBLE AS n FROM p, t a, t b, (SELECT type FROM t UNION ALL SELECT '') s WHERE a.type < b.type AND s.type != a.type AND s.type != b.type GROUP BY 1, 2, 3, 4, 5, 6),
        m AS (SELECT *, sum(n) OVER (PARTITION BY type_a, type_b, given, z) AS nz, sum(n) OVER (PARTITION BY type_a, type_b, given, z, x) AS nx, sum(n) OVER (PARTITION BY type_a, type_b, given, z, y) AS ny FROM c),
        g AS (SELECT type_a, type_b, given, greatest(0, 2 * sum(CASE WHEN n > 0 THEN n * ln(n * nz / (nx * ny)) ELSE 0 END)) AS g, CASE WHEN given = '' THEN 1 ELSE 2 END AS dof FROM m GROUP BY 1, 2, 3)
        SELECT type_a, type_b, given, round(g, 4) AS g, dof, CASE WHEN dof = 1 THEN g < 3.841458820694124 ELSE exp(-g / 2) > 0.05 END AS independent FROM g""",
    "causal_structure": f"""WITH {EDGES}, t AS (SELECT type, (1 << (row_number() OVER (ORDER BY type) - 1)::INT) AS bit FROM (SELECT DISTINCT type FROM e)), u AS (SELECT entity, ts::DATE AS day, bit_or(bit) AS ts FROM e JOIN t USING (type) GROUP BY 1, 2),
        k AS (SELECT (SELECT count(DISTINCT entity) FROM u) * (SELECT date_diff('day', min(day), max(day)) + 1 FROM u) AS units), p AS (SELECT ts, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 0, units - (SELECT count(*) FROM u) FROM k),
        s AS (SELECT m AS given, bit_count(m::INT)::INT AS size FROM range(1 << (SELECT count(*) FROM t)::INT) r(m) WHERE bit_count(m::INT) <= 3),
        c AS (SELECT a.type AS x, b.type AS y, given, size, (ts & given) AS z, (ts & a.bit) != 0 AS px, (ts & b.bit) != 0 AS py, sum(n)::DOUBLE AS n FROM p, t a, t b, s WHERE a.type < b.type AND (given & a.bit) = 0 AND (given & b.bit) = 0 GROUP BY 1, 2, 3, 4, 5, 6, 7),
        m AS (SELECT *, sum(n) OVER (PARTITION BY x, y, given, z) AS nz, sum(n) OVER (PARTITION BY x, y, given, z, px) AS nx, sum(n) OVER (PARTITION BY x, y, given, z, py) AS ny FROM c),
        h AS (SELECT x, y, size, greatest(0, sum(CASE WHEN n > 0 THEN n * ln(n * nz / (nx * ny)) ELSE 0 END)) AS h FROM m GROUP BY x, y, given, size),
        q AS (SELECT x, y, min(CASE WHEN CASE size WHEN 0 THEN 2 * h < 3.841458820694124 WHEN 1 THEN exp(-h) > 0.05 WHEN 2 THEN exp(-h) * (1 + h) > 0.05 ELSE exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) > 0.05 END THEN size END) AS size FROM h GROUP BY 1, 2),
        o AS (SELECT src_type, dst_type, count(*) AS n FROM g GROUP BY 1, 2), d AS (SELECT q.*, coalesce(a.n, 0) AS xy, coalesce(b.n, 0) AS yx FROM q LEFT JOIN o a ON a.src_type = x AND a.dst_type = y LEFT JOIN o b ON b.src_type = y AND b.dst_type = x)
        SELECT CASE WHEN yx > xy THEN y ELSE x END AS cause, CASE WHEN yx > xy THEN x ELSE y END AS effect, size IS NULL AS linked, size, xy = yx AS undecided FROM d""",
    "causal_sentences": f"""WITH {EDGES}, s AS (SELECT *, upper(src_type[1]) || lower(src_type[2:]) || ' number ' || src AS cause, upper(dst_type[1]) || lower(dst_type[2:]) || ' number ' || dst AS effect,
        CASE src % 5 WHEN 0 THEN 'led to' WHEN 1 THEN 'was an important reason for and directly triggered' WHEN 3 THEN 'prevented' ELSE 'was due to' END AS verb FROM g WHERE src % 5 != 2), v AS (SELECT *, cause || ' ' || verb || ' the ' || effect AS evidence FROM s)
        SELECT entity AS id, cause, effect, CASE src % 5 WHEN 0 THEN 'LEADS_TO' WHEN 1 THEN 'TRIGGERS' WHEN 3 THEN 'PREVENTS' ELSE 'CAUSES' END AS relation, evidence, round(least(1.0, 0.7 + CASE WHEN src % 5 IN (0, 1) THEN 0.2 ELSE 0 END + CASE WHEN length(evidence) > 50 THEN 0.1 ELSE 0 END), 9) AS confidence FROM v""",
    "part_names": r"""WITH n AS (SELECT DISTINCT p_name AS name, list_filter(string_split_regex(lower(p_name), '[^\w]+'), lambda x: x != '') AS k FROM part), w AS (SELECT p_partkey AS id, list_filter(string_split_regex(lower(p_type || '. ' || p_name || '. ' || p_brand || '. ' || p_name), '[^\w]+'), lambda x: x != '') AS ws FROM part),
        x AS (SELECT id, array_to_string(list_slice(ws, i, i + l - 1), ' ') AS run FROM w, (SELECT DISTINCT len(k) AS l FROM n), unnest(range(1, len(ws) + 1)) u(i) WHERE i + l - 1 <= len(ws))
        SELECT name, count(DISTINCT id) AS parts, count(*) AS n FROM n JOIN x ON run = array_to_string(k, ' ') WHERE len(k) > 0 GROUP BY 1""",
    "multi_hop_documents": """WITH RECURSIVE b AS (SELECT DISTINCT 'p' || l_partkey AS x, 's' || l_suppkey AS y FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
        q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), w AS (SELECT query, 'p' || query AS id, 0 AS hop FROM q UNION SELECT query, b.y, hop + 1 FROM w JOIN b ON b.x = w.id WHERE hop < 2),
        m AS (SELECT query, id, min(hop) AS hop FROM w GROUP BY 1, 2), s AS (SELECT m.query, m.id, CASE WHEN e.vec_id IS NULL THEN 0.5 ELSE list_cosine_similarity(q.v, e.embedding::DOUBLE[]) END * pow(0.7, hop) AS score FROM m JOIN q ON q.query = m.query LEFT JOIN embeddings e ON m.id = 'p' || e.vec_id)
        SELECT query, l_orderkey AS doc, round(max(score), 6) AS score FROM s JOIN lineitem ON s.id = 'p' || l_partkey WHERE score >= 0.3 GROUP BY 1, 2""",
    "frequent_patterns": _pattern_sql(),
    "rule_metrics": f"""WITH {RULES}, c AS (SELECT coalesce(q.rule, z.rule) AS rule, count(q.head) AS support, count(*) FILTER (q.head IS NOT NULL AND z.head IS NOT NULL) AS tp, count(*) FILTER (z.head IS NULL) AS fp, count(*) FILTER (q.head IS NULL) AS fn FROM q FULL JOIN z ON q.rule = z.rule AND q.head = z.head AND q.tail = z.tail GROUP BY 1)
        SELECT rule, support, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "missing_edges": f"WITH {RULES} SELECT rule, head, conclusion, tail FROM q WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.rule = q.rule AND z.head = q.head AND z.tail = q.tail)",
}
