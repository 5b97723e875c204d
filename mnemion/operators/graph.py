"""Property-graph analytics on an edge table (src, dst, rel, ...).

Paths are grown by one join a hop from the frontier only, with the edges walked so far in an array, as a path repeats no edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemion.operators.components import connected_components
from mnemion.sources.staging import CLEANUP, discard, setting, stage

HUB = 10_000  # neighbours of a node beyond which pairs of them are made in several tasks
MET = 1 << 21  # pairs counted in a task
SHIFT = 7  # bits of an id that are left out in a block of nodes, to which a list goes out once
ENTRIES = 1 << 20  # of lists made, or pairs counted, at once
ROWS = 1024  # of lists that are paired at once
NODES = 2_000_000  # rows by node, at most, that are sent to all tasks
NEAR = 4096  # neighbours in a row
CELL = 2048  # of a node's neighbours that meet all of them in one task
PAIRS = 1 << 21  # met in one task, about


def one_hop(edges: DataFrame, nodes: DataFrame, direction: str = "out", rel: str | None = None) -> DataFrame:
    """(id, neighbour, rel) of the given nodes (id): along edges, against them, or both, distinct."""
    e = edges.where(F.col("rel") == rel) if rel else edges
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "rel")
    back = e.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "rel")
    found = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return found.join(nodes.select("id").distinct(), "id", "left_semi").distinct()


def paths(edges: DataFrame, starts: DataFrame, most: int, least: int = 1, rels: Sequence[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """(start, end, nodes, confidences, rels, hops) of the directed paths from the starts (id) of least to most edges.

    Null confidences count as 0.5 and pass any threshold. No edge is walked twice in a path.
    """
    e = edges.where(F.col("rel").isin(list(rels))) if rels else edges
    e = e.where((F.col("confidence") >= min_confidence) | F.col("confidence").isNull())
    e = e.select("src", "dst", "rel", F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.concat_ws("|", "src", "rel", "dst").alias("edge"))
    first = starts.select(F.col("id").alias("src")).distinct().join(e, "src")
    at = first.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("nodes"), F.array("confidence").alias("confidences"), F.array("rel").alias("rels"), F.array("edge").alias("walked"))
    found = at
    for _ in range(most - 1):
        step = at.join(e, at["end"] == e["src"]).where(~F.array_contains("walked", F.col("edge")))
        at = step.select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("confidences", F.array("confidence")).alias("confidences"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("walked", F.array("edge")).alias("walked"))
        found = found.unionByName(at)
    return found.drop("walked").withColumn("hops", F.size("confidences")).where(F.col("hops") >= least)


def product(c: str) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda a, x: a * x)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def shortest(edges: DataFrame, start: int, end: int, most: int = 10, min_confidence: float = 0.0) -> DataFrame:
    """(nodes, hops, confidence) of one shortest path, the first by its nodes; confidence is the least edge's.

    One frontier a level: a node is kept once, with the first of its paths.
    """
    e = edges.where((F.col("confidence") >= min_confidence) | F.col("confidence").isNull()).select("src", "dst", F.coalesce("confidence", F.lit(0.5)).alias("c"))
    spark = edges.sparkSession
    at = spark.createDataFrame([(start, [start], 1.0)], "node long, nodes array<long>, confidence double")
    seen = at.select("node")
    for hop in range(1, most + 1):
        grown = at.join(e, at["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.least("confidence", "c").alias("confidence"))
        best = grown.groupBy("node").agg(F.min(F.struct("nodes", (-F.col("confidence")).alias("less"))).alias("b"))
        at = stage(best.join(seen, "node", "left_anti").select("node", "b.nodes", (-F.col("b.less")).alias("confidence")), "frontier")
        if not (hit := at.where(F.col("node") == end)).isEmpty():
            return hit.select("nodes", F.lit(hop).alias("hops"), "confidence")
        if at.isEmpty():
            break
        seen = stage(seen.unionByName(at.select("node")), "seen")
    return spark.createDataFrame([], "nodes array<long>, hops int, confidence double")


def path_validity(found: DataFrame, times: DataFrame) -> DataFrame:
    """(start, end, nodes, valid): do the times (id, t) of a path's nodes strictly increase?"""
    rows = found.select("start", "end", "nodes", F.posexplode("nodes").alias("k", "id")).join(times, "id")
    w = W.partitionBy("nodes").orderBy("k")
    steps = rows.withColumn("ok", F.coalesce(F.col("t") > F.lag("t").over(w), F.lit(True)))
    return steps.groupBy("start", "end", "nodes").agg(F.bool_and("ok").alias("valid"))


def chain_scores(found: DataFrame, times: DataFrame, near_days: float = 30.0, causal: Sequence[str] = ("CAUSES", "ENABLES", "TRIGGERS")) -> DataFrame:
    """found with temporal, structural, statistical and total scores (weights 0.4, 0.3, 0.3)."""
    rows = found.select("nodes", F.posexplode("nodes").alias("k", "id")).distinct().join(times, "id", "left")
    w = W.partitionBy("nodes").orderBy("k")
    gap = (F.col("t") - F.lag("t").over(w)) / 86_400_000_000
    pair = F.when(F.col("k") > 0, F.when(gap.isNull(), 0.5).when(gap <= 0, 0.0).when(gap <= near_days, 1.0).otherwise(0.5))
    temporal = rows.withColumn("pair", pair).groupBy("nodes").agg(F.avg("pair").alias("temporal"))
    mean = F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x) / F.size("confidences")
    share = F.size(F.filter("rels", lambda r: r.isin(list(causal)))) / F.size("rels")
    out = found.join(temporal, "nodes").withColumn("structural", 0.5 * share + 0.5 * mean).withColumn("statistical", 0.3 + 0.7 * mean)
    return out.withColumn("score", 0.4 * F.col("temporal") + 0.3 * F.col("structural") + 0.3 * F.col("statistical"))


def mediators(edges: DataFrame) -> DataFrame:
    """(a, m, b, confidence): paths of two edges between different ends, with the lesser confidence."""
    x = edges.select(F.col("src").alias("a"), F.col("dst").alias("m"), F.col("confidence").alias("c1"))
    y = edges.select(F.col("src").alias("m"), F.col("dst").alias("b"), F.col("confidence").alias("c2"))
    return x.join(y, "m").where("a != b").select("a", "m", "b", F.least("c1", "c2").alias("confidence"))


def common_causes(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """(a, b, cause): nodes from which both of a pair (a, b) are reached within some hops."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    up = paths(reversed_edges(edges), ends, hops).select("start", F.col("end").alias("cause")).distinct()
    a, b = up.withColumnRenamed("start", "a"), up.withColumnRenamed("start", "b")
    return pairs.join(a, "a").join(b, ["b", "cause"]).where("cause != a and cause != b").select("a", "b", "cause").distinct()


def sharing(edges: DataFrame) -> DataFrame:
    """(src, dst), both ways and distinct: different src nodes that have a dst in common. Tasks are as many as the pairs ask for, and a hub is several."""
    e = stage(edges.select("src", "dst").distinct(), "sharing")
    n = stage(e.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")), "sizes")
    tasks = 1 + (n.agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).first().pairs or 0) // PAIRS
    e = e.join(n, "dst")
    one = e.select("dst", "src", F.pmod(F.xxhash64("src"), "cells").cast("int").alias("cell")).repartition(tasks, "dst", "cell")
    other = e.select("dst", F.col("src").alias("other"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).repartition(tasks, "dst", "cell")
    return one.join(other.hint("merge"), ["dst", "cell"]).where("src != other").select("src", F.col("other").alias("dst")).distinct()


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, adamic): of distinct neighbours of src nodes a < b that have one in common.

    adamic sums 1 / ln(degree) over common neighbours of degree above 1. A pair is counted where its lists arrive and leaves
    the task only as a row of the result: no row a pair is shuffled, but by Spark's joins where there are more than NODES src nodes.
    """
    kind = edges.schema["src"].dataType
    if not isinstance(kind, T.IntegralType):  # other ids are numbered
        numbers = stage(edges.select("src").distinct().where("src is not null").withColumn("k", F.monotonically_increasing_id()), "numbers")
        found = shared_neighbours(edges.join(numbers, "src").select(F.col("k").alias("src"), "dst"))
        for c in ("a", "b"):
            found = found.join(_sent(numbers.select(F.col("src").alias(f"{c}_id"), F.col("k").alias(c))), c)
        return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "shared", "jaccard", "adamic")
    e = stage(edges.select(F.col("src").cast("long").alias("src"), "dst").distinct(), "edges")
    degree = stage(e.groupBy("src").agg(F.count("*").alias("d")), "degrees")
    ends = e.where("src is not null and dst is not null")
    hubs = stage(ends.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > HUB), "hubs")
    some = not hubs.isEmpty()
    near = (ends.join(hubs, "dst", "left_anti") if some else ends).groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("near"))
    near = stage(near.where("size(near) > 1").select("near"), "near")
    work = near.mapInArrow(_to_blocks(SHIFT, sizes=True), "block long, n long")
    if some:
        # The neighbours of a hub are lists of about HUB, which all its blocks of nodes meet.
        rows = ends.join(hubs.withColumn("lists", F.ceil(F.col("n") / HUB).cast("int")), "dst")
        lists = rows.groupBy("dst", F.pmod(F.xxhash64("src"), "lists").cast("int").alias("list")).agg(F.array_sort(F.collect_list("src")).alias("others"))
        mine = rows.groupBy("dst", "n", "lists", F.shiftright("src", SHIFT).alias("block")).agg(F.array_sort(F.collect_list("src")).alias("mine"))
        mine = mine.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)))
        more = mine.join(lists, ["dst", "list"]).select("block", (1.0 / F.ln("n")).alias("w"), "mine", F.filter("others", lambda x: x > F.col("mine")[0]).alias("others")).where("size(others) > 0")
        work = work.unionByName(more.select("block", (F.size("mine").cast("long") * F.size("others")).alias("n")))
    else:
        discard(e)
    # A block whose nodes meet more than MET others (so they are few) is dealt over tasks by a hash of the other.
    work = stage(work.groupBy("block").agg(F.sum("n").alias("n")), "work")
    tasks = 1 + 2 * (work.agg(F.sum("n").alias("n")).first().n or 0) // MET
    # A list goes out once to each block of nodes that it names, with those (`mine`) and all that come after the first of them.
    met = near.repartition(1 + tasks // 4).mapInArrow(_to_blocks(SHIFT), "block long, w double, mine array<long>, others array<long>")
    met = met.unionByName(more) if some else met
    many = work.select("block", F.ceil(F.col("n") / MET).cast("int").alias("parts")).where("parts > 1")
    met = met.join(F.broadcast(many), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = F.when(F.col("parts") == 1, F.col("others")).otherwise(F.filter("others", lambda b: F.pmod(F.xxhash64(b), F.col("parts")) == F.col("part")))
    met = met.select("block", "part", "w", "mine", others.alias("others")).where("size(others) > 0")
    both = met.repartition(tasks, "block", "part").sortWithinPartitions("block", "part").mapInArrow(_counted, "a long, b long, shared long, adamic double")
    both = both.join(_sent(degree.select(F.col("src").alias("a"), F.col("d").alias("da"))), "a").join(_sent(degree.select(F.col("src").alias("b"), F.col("d").alias("db"))), "b")
    return both.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared", (F.col("shared") / (F.col("da") + F.col("db") - F.col("shared"))).alias("jaccard"), "adamic")


def _to_blocks(shift: int, sizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted lists (near) the rows (block, w, mine, others) that go to the blocks of nodes, or the numbers (block, n) of what they meet there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = b.column(0)
            flat, counts = near.flatten().to_numpy(), pc.list_value_length(near).to_numpy()
            ends = np.cumsum(counts)
            blocks, end = flat >> shift, np.repeat(ends, counts)
            new = np.concatenate(([True], blocks[1:] != blocks[:-1]))
            new[ends[:-1]] = True
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(flat))
            after = end[starts] - starts - 1
            starts, stops, after = starts[after > 0], stops[after > 0], after[after > 0]
            if sizes:
                found, at = np.unique(blocks[starts], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, (stops - starts) * after).astype(np.int64))], ["block", "n"])
                continue
            w = 1.0 / np.log(np.repeat(counts, counts)[starts])
            total = np.cumsum(after)
            cuts = np.searchsorted(total, np.arange(0, total[-1], ENTRIES)[1:]) if len(total) else []
            for some in np.split(np.arange(len(starts)), cuts):
                if len(some):
                    mine, others = (_slices(flat, x, n) for x, n in ((starts[some], (stops - starts)[some]), (starts[some] + 1, after[some])))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[starts[some]]), pa.array(w[some]), mine, others], ["block", "w", "mine", "others"])

    return run


def _slices(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists of so many values from each start."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[at]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, adamic) of rows (block, part, w, mine, others) in the order of block and part, which alone hold a pair."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        block, part, w = (b.column(i).to_numpy() for i in range(3))
        mine, others = b.column(3), b.column(4)
        k, m = pc.list_value_length(mine).to_numpy().astype(np.int64), pc.list_value_length(others).to_numpy().astype(np.int64)
        every, rest = mine.flatten().to_numpy(), others.flatten().to_numpy()
        ends, first = np.cumsum(k), np.cumsum(m) - m
        new = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        marks = np.concatenate((new, np.arange(0, b.num_rows, ROWS)[1:], [0, b.num_rows])).astype(np.int64)
        groups = set(new.tolist())
        if (block[0], part[0]) != last:
            groups.add(0)
        marks = np.unique(marks)
        for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
            if lo in groups and n >= ENTRIES:
                yield from _sums(held)
                held, n = [], 0
            rows = np.repeat(np.arange(lo, hi), k[lo:hi])  # of each of mine
            row = np.repeat(rows, m[rows])
            a = np.repeat(every[ends[lo] - k[lo] : ends[hi - 1]], m[rows])
            c = rest[np.arange(len(row)) + np.repeat(first[rows] - np.cumsum(m[rows]) + m[rows], m[rows])]
            later = c > a
            held.append((a[later], c[later], w[row[later]]))
            n += int(later.sum())
        last = (block[-1], part[-1])
    if held:
        yield from _sums(held)


def _sums(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b, w = (np.concatenate(x) for x in zip(*held, strict=True))
    (left, i), (right, j) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    keys, at = np.unique(i * max(1, len(right)) + j, return_inverse=True)
    found = [left[keys // max(1, len(right))], right[keys % max(1, len(right))], np.bincount(at, minlength=len(keys)).astype(np.int64), np.bincount(at, w, len(keys))]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "shared", "adamic"])
    for start in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(start, 1 << 16)


def _sent(nodes: DataFrame) -> DataFrame:
    """A staged table with a row a node, to be joined to pairs: sent to all tasks up to NODES rows, so that pairs stay where they are."""
    return F.broadcast(nodes) if nodes.count() <= NODES else nodes


def predict_links(scores: DataFrame, linked: DataFrame | None = None, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3), groups: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of pairs not linked yet: the mean of common neighbours (of 10), Jaccard and Adamic-Adar (of the largest).

    linked has pairs (a, b); groups (id, group) links all members of a group without a row for each of their pairs. Scores are
    read twice, first for the largest Adamic-Adar, as pairs are many more than what they are made from: none are written down.
    """
    new = scores if linked is None else scores.join(linked, ["a", "b"], "left_anti")
    if groups is not None:
        of = stage(groups.groupBy("id").agg(F.collect_set("group").alias("g")), "groups")
        new = new.join(_sent(of.select(F.col("id").alias("a"), F.col("g").alias("ga"))), "a", "left").join(_sent(of.select(F.col("id").alias("b"), F.col("g").alias("gb"))), "b", "left")
        new = new.where(~F.coalesce(F.arrays_overlap("ga", "gb"), F.lit(False)))
    with setting(scores.sparkSession, CLEANUP, "true"):
        top = new.agg(F.max("adamic").alias("top")).first().top or 1.0
    parts = (F.least(F.lit(1.0), F.col("shared") / 10), F.col("jaccard"), F.col("adamic") / max(top, 1.0))
    return new.select("a", "b", (sum(w * p for w, p in zip(weights, parts, strict=True)) / sum(weights)).alias("score"))


def pattern_support(edges: DataFrame, least: int = 1) -> DataFrame:
    """(src_label, rel, dst_label, support) of typed ids (label:key)."""
    label = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return edges.groupBy(label(F.col("src")).alias("src_label"), "rel", label(F.col("dst")).alias("dst_label")).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def missing_relation(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """The nodes (id) without an outgoing edge of a kind."""
    return nodes.join(edges.where(F.col("rel") == rel).select(F.col("src").alias("id")), "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, either way."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def memory_decay(edges: DataFrame, reference: str, half_life: float = 30.0) -> DataFrame:
    """(id, days, decay, importance, recall, reinforce): time since a node's last edge, and its degree of the largest."""
    ends = edges.select(F.col("src").alias("id"), "valid_from").unionByName(edges.select(F.col("dst").alias("id"), "valid_from"))
    rows = ends.groupBy("id").agg(F.count("*").alias("degree"), F.max("valid_from").alias("last"))
    top = rows.agg(F.max("degree").alias("m")).first().m or 1
    days = F.coalesce(F.datediff(F.lit(reference).cast("date"), F.to_date("last")).cast("double"), F.lit(90.0))
    out = rows.withColumn("days", days).withColumn("decay", F.exp(-0.693 * F.greatest(F.col("days"), F.lit(0.0)) / half_life)).withColumn("importance", F.col("degree") / F.lit(top))
    out = out.withColumn("recall", 0.6 * F.col("decay") + 0.4 * F.col("importance"))
    return out.select("id", "days", "decay", "importance", "recall", ((F.col("decay") < 0.3) & (F.col("importance") > 0.5)).alias("reinforce"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) by the smallest id."""
    return connected_components(edges, "src", "dst")


def community_links(edges: DataFrame, membership: DataFrame, isolated: float = 0.1, least_size: int = 3) -> DataFrame:
    """(community, size, internal, external, ratio, density, isolated) given membership (id, community)."""
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal"))
    crossing = e.where("ca != cb").select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("external"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    out = sizes.join(inside, "community", "left").join(crossing, "community", "left").fillna(0, ["internal", "external"])
    ratio = F.when(F.col("internal") + F.col("external") > 0, F.col("external") / (F.col("internal") + F.col("external"))).otherwise(0.0)
    n = F.col("size")
    density = F.when(n > 1, F.col("internal") / (n * (n - 1) / 2)).otherwise(0.0)
    return out.select("community", "size", "internal", "external", ratio.alias("ratio"), density.alias("density"), ((ratio < isolated) & (n >= least_size)).alias("isolated"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): in each round a node takes the commonest label among its neighbours, the smaller of equals.

    Deterministic; a round is two joins and an aggregation with partial counts, written down between rounds.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    # A node's neighbours in lists of about NEAR: a round moves a row a list, and not one an edge, to the node's label.
    cut = F.pmod(F.xxhash64("src"), F.ceil(F.col("n") / NEAR).cast("int"))
    cuts = both.groupBy("dst").agg(F.count("*").alias("n"))
    near = both.join(cuts, "dst").groupBy("dst", cut.alias("cut")).agg(F.collect_list("src").alias("near"))
    near = stage(near.select(F.col("dst").alias("id"), "near"), "neighbours")
    at = near.select("id").distinct().withColumn("community", F.col("id"))
    for turn in range(rounds):
        seen = near.join(at, "id").select(F.explode("near").alias("src"), "community").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = seen.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("community").alias("c"))).alias("b"))
        now = best.select(F.col("src").alias("id"), F.col("b.c").alias("community"))
        last, at = at, stage(now, "labels")
        if turn:
            discard(last)
    discard(near)
    return at


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(id, score): relevance that spreads from seeds (id, score) along edges, as in personalised PageRank."""
    e = edges.select("src", "dst").distinct()
    out_degree = e.groupBy("src").agg(F.count("*").alias("d"))
    e = stage(e.join(out_degree, "src"), "weighted")
    at = seeds.select("id", F.col("score").cast("double").alias("score"))
    for turn in range(rounds):
        sent = e.join(at.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (damping * F.col("score") / F.col("d")).alias("score"))
        restart = seeds.select("id", ((1 - damping) * F.col("score")).alias("score"))
        last, at = at, stage(sent.unionByName(restart).groupBy("id").agg(F.sum("score").alias("score")), "spread")
        if turn:
            discard(last)
    discard(e)
    return at


def bradford_hill(pairs: DataFrame) -> DataFrame:
    """pairs with the criteria's scores, their weighted mean and the verdict. Without experiments that criterion doesn't apply.

    pairs has strength, effect, p_value, n, avg_gap, min_gap, causes (of the effect), effects (of the cause), monotonic and
    mechanism (boolean), contradicted (boolean) and data_support; optionally consistency (of gaps), linear, replicated,
    known_mechanism, supported, patterns (number of like pairs), known_pair, positive and negative (numbers of experiments).
    """
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    strength = 0.4 * F.least(F.col("strength"), F.lit(1.0)) + F.when(F.col("effect") > 2, 0.3).when(F.col("effect") > 1.5, 0.2).when(F.col("effect") > 1, 0.1).otherwise(0.0) + F.when(F.col("p_value") < 0.001, 0.3).when(F.col("p_value") < 0.01, 0.2).when(F.col("p_value") < 0.05, 0.15).otherwise(0.0)
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in pairs.columns else F.lit(False)
    gaps = F.when(F.col("consistency") > 0.7, 0.2).when(F.col("consistency") < 0.3, -0.1).otherwise(0.0) if "consistency" in pairs.columns else F.lit(0.0)
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    even = 0.5 + F.when(F.col("n") >= 20, 0.3).when(F.col("n") >= 10, 0.2).when(F.col("n") >= 5, 0.1).otherwise(-0.2) + gaps + plus(has("replicated"), 0.2)
    specific = 0.5 + F.when(F.col("causes") > 5, -0.2).when(F.col("causes") > 2, -0.1).otherwise(0.1) + F.when(F.col("effects") > 5, -0.1).otherwise(0.0)
    temporal = F.when((F.col("avg_gap") > 0) & (F.col("min_gap") >= 0), 1.0).when(F.col("avg_gap") > 0, 0.8).otherwise(0.3)
    gradient = F.least(F.lit(1.0), 0.5 + plus(has("monotonic"), 0.3) + plus(has("linear"), 0.2)) + plus(F.col("effect") > 1.5, 0.1)
    plausible = 0.5 + plus(has("mechanism"), 0.2 + plus(F.col("strength") > 0.6, 0.1)) + plus(has("known_mechanism"), 0.2)
    coherent = 0.5 + F.when(has("contradicted"), -0.3).otherwise(0.1) + 0.2 * F.col("data_support") + plus(has("supported"), 0.2)
    analogous = 0.5 + (0.1 * F.col("patterns") if "patterns" in pairs.columns else F.lit(0.0)) + plus(has("known_pair"), 0.2)
    criteria = {"strength": clamp(strength), "consistency": clamp(even), "specificity": clamp(specific), "temporality": temporal, "gradient": clamp(gradient), "plausibility": clamp(plausible), "coherence": clamp(coherent), "analogy": clamp(analogous)}
    weights = dict.fromkeys(criteria, 1.0) | {"temporality": 1.5}
    if "positive" in pairs.columns:
        criteria["experiment"] = F.when(F.col("positive") > F.col("negative"), 0.8).when(F.col("positive") == F.col("negative"), 0.5).otherwise(0.3)
        weights["experiment"] = 0.5
    out = pairs.withColumns({f"bh_{k}": v for k, v in criteria.items()})
    total = sum(w * F.col(f"bh_{k}") for k, w in weights.items()) / sum(weights.values())
    out = out.withColumn("score", total)
    verdict = F.when(F.col("bh_temporality") < 0.5, "not_causal").when(total >= 0.75, "strong").when(total >= 0.55, "moderate").when(total >= 0.4, "weak").when(total >= 0.25, "very_weak").otherwise("not_causal")
    return out.withColumn("verdict", verdict)
