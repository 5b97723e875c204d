"""Frequent patterns of a typed graph, the edges that they miss, and the quality of rules.

Edges are (src, dst, rel), nodes (id, label). A pattern is a tree of relations that lead away from its root, no two of one kind
from one node, written as label[REL>label[...],REL>label] with relations in order: the text is its signature. Its support is
the number of roots that have it and its matches are all ways of putting nodes to it; a node may stand in several places.

Matches are not listed but counted: those under a root are the product, over its relations, of the sums over the neighbours.
So a level of growth is a join on the root, however many matches a hub has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.sources.staging import discard, stage

LISTED = 1024  # ends of a node in one row
DEALT = 500_000  # edges of a task


def _frequent(table: DataFrame, least: int) -> DataFrame:
    """The rows of table (signature, id, n, ...) whose signature at least so many roots have."""
    often = table.groupBy("signature").agg(F.count("*").alias("support")).where(F.col("support") >= least).select("signature")
    return table.join(F.broadcast(often), "signature", "left_semi")


def _sources(edges: DataFrame) -> DataFrame:
    """(dst, rel, sources): the distinct sources of each node by relation, of a node with many edges in lists of about LISTED."""
    rows = edges.select("src", "dst", "rel").dropna()
    hubs = rows.groupBy("dst").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("cuts")).where("cuts > 1")  # a row for LISTED edges at most
    dealt = rows.join(F.broadcast(hubs), "dst", "left").withColumn("cut", F.pmod(F.xxhash64("src"), F.coalesce("cuts", F.lit(1))))
    return dealt.repartition("dst", "cut").groupBy("dst", "rel", "cut").agg(F.collect_set("src").alias("sources")).drop("cut")


def frequent_patterns(edges: DataFrame, nodes: DataFrame, size: int = 3, least: int = 2) -> DataFrame:
    """(signature, edges, support, matches) of the patterns of 1 to size edges that have the least support.

    A pattern of k edges is a smaller one and a new last relation with a smaller one behind it. No pattern has more support
    than what is left of it at the same root, so the last and largest level grows from frequent ones only. Below that, rare
    ones are kept for what they stand behind: many roots may lead to few. Signatures are as many as the labels and relations
    combine to, not as the rows.

    Edges are lists of the sources of a node and relation, so a level moves a list an edge; what arrives at the sources is
    dealt over as many tasks as bound the sums of one, as few edges of a task have source, relation and tree in common.
    """
    links = stage(_sources(edges), "links")
    tasks = 1 + (links.agg(F.sum(F.size("sources"))).first()[0] or 0) // DEALT
    whole = F.concat(F.col("label"), F.when(F.col("inner") != "", F.concat(F.lit("["), F.col("inner"), F.lit("]"))).otherwise(""))
    # Trees by number of edges: signature; label, inner (what is in brackets) and last (its last relation); root; matches.
    trees = {0: nodes.where("id is not null").select("id", "label").distinct().select("id", "label", F.lit("").alias("inner"), F.lit("").alias("last"), F.lit(1).cast("decimal(38,0)").alias("n")).withColumn("signature", F.col("label"))}
    often, planted = {0: trees[0]}, {}
    for k in range(1, size + 1):
        # A relation that leads to a tree of k - 1 edges, summed over a root's neighbours.
        below = trees[k - 1].select(F.col("id").alias("dst"), F.col("signature").alias("below"), "n")
        arrived = links.join(below, "dst").select(F.explode("sources").alias("id"), "rel", "below", "n").repartition(tasks, "id")
        planted[k] = stage(arrived.groupBy("id", "rel", "below").agg(F.sum("n").alias("m")), "planted")
        grown = []
        for j in range(1, k + 1):
            met = (often if k == size else trees)[k - j].join(planted[j], "id").where("rel > last")
            inner = F.concat("inner", F.when(F.col("inner") != "", ",").otherwise(""), "rel", F.lit(">"), "below")
            grown.append(met.select("id", "label", inner.alias("inner"), F.col("rel").alias("last"), (F.col("n") * F.col("m")).cast("decimal(38,0)").alias("n")))
        trees[k] = reduce(DataFrame.unionByName, grown).withColumn("signature", whole)
        if k < size:
            trees[k] = stage(trees[k], "trees")
            often[k] = _frequent(trees[k], least)
    counts = [trees[k].groupBy("signature").agg(F.count("*").alias("support"), F.sum("n").alias("matches")).where(F.col("support") >= least).withColumn("edges", F.lit(k)) for k in range(1, size + 1)]
    out = stage(reduce(DataFrame.unionByName, counts).select("signature", "edges", "support", F.col("matches").cast("long").alias("matches")), "frequent")
    discard(links, *planted.values(), *[trees[k] for k in range(1, size)])
    return out


def path_pairs(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, head, tail): the distinct ends of ways along the relations of each rule (rule, path: array of relations, conclusion).

    A rule is followed from the side that has fewer ends, its near side. A row of a step is a node with a list of the near
    ends that it is joined to, so a step shuffles one list an edge and not one row a pair; distinct ends are taken where the
    list arrives. Where a side has many ends lists are cut by a hash of the end, at about LISTED of them. Rules are a small table.
    """
    todo = {r.rule: list(r.path) for r in rules.select("rule", "path").collect() if r.path}
    kinds = edges.schema
    if not todo:
        return rules.select("rule", F.lit(None).cast(kinds["src"].dataType).alias("head"), F.lit(None).cast(kinds["dst"].dataType).alias("tail")).limit(0)
    outer = sorted({path[k] for path in todo.values() for k in (0, -1)})
    ends = edges.where(F.col("rel").isin(outer)).groupBy("rel").agg(F.approx_count_distinct("src").alias("heads"), F.approx_count_distinct("dst").alias("tails")).collect()  # a row a relation
    heads, tails = {r.rel: r.heads for r in ends}, {r.rel: r.tails for r in ends}
    back = {rule: tails.get(path[-1], 0) <= heads.get(path[0], 0) for rule, path in todo.items()}
    cuts = {rule: 1 + (tails.get(path[-1], 0) if back[rule] else heads.get(path[0], 0)) // LISTED for rule, path in todo.items()}
    ways = {rule: path[::-1] if back[rule] else path for rule, path in todo.items()}

    def step(k: int) -> DataFrame:
        """(rule, near, far): of each rule the edges of its k-th relation from the near side."""
        mine = rules.sparkSession.createDataFrame([(rule, way[k], back[rule], cuts[rule]) for rule, way in ways.items() if k < len(way)], f"rule {rules.schema['rule'].dataType.simpleString()}, rel string, back boolean, cuts int")
        met = edges.where(F.col("rel").isin(sorted({way[k] for way in ways.values() if k < len(way)}))).join(F.broadcast(mine), "rel")
        return met.select("rule", "cuts", F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("near"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("far"))

    first = step(0)
    names = stage(first.select("near").distinct().withColumn("number", F.monotonically_increasing_id()), "ends")
    numbered = first.join(names.withColumnRenamed("near", "name"), F.col("near").eqNullSafe(F.col("name")))
    met = numbered.select("rule", F.col("far").alias("node"), F.pmod(F.xxhash64("number"), "cuts").alias("cut"), F.array("number").alias("list"))
    longest, found, held = max(map(len, ways.values())), [], [names]
    for k in range(1, longest + 1):
        # The rows of a node and cut are in one task from here on: neither step shuffles again.
        pairs = met.repartition("rule", "node", "cut").select("rule", "node", "cut", F.explode("list").alias("number")).distinct()
        if k == longest:
            found.append(pairs.select("rule", "node", "number"))
            break
        at = stage(pairs.groupBy("rule", "node", "cut").agg(F.collect_list("number").alias("list")), "ways")
        held.append(at)
        if ended := [rule for rule, way in ways.items() if len(way) == k]:
            found.append(at.where(F.col("rule").isin(ended)).select("rule", "node", F.explode("list").alias("number")))
        met = step(k).select("rule", F.col("near").alias("node"), "far").join(at, ["rule", "node"]).select("rule", F.col("far").alias("node"), "cut", "list")
    every = reduce(DataFrame.unionByName, found).join(names, "number")
    turned = F.col("rule").isin([rule for rule in ways if back[rule]])
    out = stage(every.select("rule", F.when(turned, F.col("node")).otherwise(F.col("near")).alias("head"), F.when(turned, F.col("near")).otherwise(F.col("node")).alias("tail")), "path-pairs")
    discard(*held)
    return out


def _concluded(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(head, conclusion, tail) of the edges that some rule concludes."""
    some = [r[0] for r in rules.select("conclusion").distinct().collect()]  # a small table
    return edges.where(F.col("rel").isin(some)).select(F.col("src").alias("head"), F.col("rel").alias("conclusion"), F.col("dst").alias("tail"))


def missing_edges(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, head, conclusion, tail): pairs that a rule's path joins but its conclusion doesn't."""
    pairs = path_pairs(edges, rules).join(F.broadcast(rules.select("rule", "conclusion")), "rule")
    return pairs.join(_concluded(edges, rules), ["head", "conclusion", "tail"], "left_anti").select("rule", "head", "conclusion", "tail")


def rule_metrics(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, support, true_positives, false_positives, false_negatives, precision, recall, f1) over all pairs.

    Support is the number of pairs that the path joins; a false negative is a pair that has the conclusion without the path.
    """
    pairs = path_pairs(edges, rules).withColumn("predicted", F.lit(1))
    known = _concluded(edges, rules).distinct().join(F.broadcast(rules.select("rule", "conclusion")), "conclusion")
    both = pairs.join(known.select("rule", "head", "tail", F.lit(1).alias("true")), ["rule", "head", "tail"], "full_outer")
    p, t = F.col("predicted").isNotNull(), F.col("true").isNotNull()
    sums = both.groupBy("rule").agg(F.count_if(p).alias("support"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    sums = rules.select("rule").join(sums, "rule", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("rule", "support", F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), "precision", "recall", f1.alias("f1"))
