"""Causal structure among event types, learned from what occurs together.

A unit is one entity on one day; its pattern is the set of types that occur. Units are counted by pattern once, so every test
reads a table of patterns and not the events. Patterns are bits of one number: at most 62 types.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.functions.stats import normal_tail
from mnemion.sources.staging import discard, stage

MOST_TYPES = 62
BROADCAST_ROWS = 100_000  # patterns or tests that are broadcast at once


def event_types(events: DataFrame) -> list[str]:
    """The types, sorted; a list that doesn't grow with the events. An error beyond 62."""
    found = sorted(r[0] for r in events.where("type is not null").select("type").distinct().limit(MOST_TYPES + 1).collect())
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types")
    return found


def presence(events: DataFrame, types: list[str]) -> DataFrame:
    """(pattern, n): the number of units by their pattern; bit i is set if types[i] occurs.

    events has entity, ts and type. Every entity has every day from the first to the last one; most of these units are empty.
    """
    bit = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(1 << i))])[F.col("type")]
    rows = events.where(F.col("type").isin(types)).select("entity", F.to_date("ts").alias("day"), bit.alias("bit"))
    units = rows.groupBy("entity", "day").agg(F.bit_or("bit").alias("pattern"))
    seen = units.groupBy("pattern").agg(F.count("*").alias("n"))
    span = units.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("days"), F.count("*").alias("seen")).crossJoin(units.agg(F.count_distinct("entity").alias("entities")))  # one row
    empty = span.select(F.lit(0).cast("long").alias("pattern"), (F.col("days") * F.col("entities") - F.col("seen")).alias("n")).where("n > 0")
    return seen.select(F.col("pattern").cast("long").alias("pattern"), "n").unionByName(empty)


def chi_square_tail(x: Column, dof: Column, most: int) -> Column:
    """P(X > x) for 1 degree of freedom, or an even number of them up to `most`."""
    half = F.greatest(x, F.lit(0.0)) / 2
    term, total = F.lit(1.0), F.lit(1.0)
    out = F.when(dof == 1, normal_tail(F.sqrt(2 * half))).when(dof == 2, F.exp(-half))
    for k in range(1, most // 2):
        term = term * half / k
        total = total + term
        out = out.when(dof == 2 * (k + 1), F.exp(-half) * total)
    return out


def independence(patterns: DataFrame, tests: DataFrame) -> DataFrame:
    """tests (a, b, given: bits) with g, dof, p_value: the G test of two types given the strata of the others.

    Patterns and tests meet with the smaller side broadcast, in blocks of tests where both are large; four cells a stratum
    are counted with partial sums.
    """
    bit = lambda c: F.col("pattern").bitwiseAND(F.col(c)) != 0
    key = ("a", "b", "given")
    if patterns.count() <= BROADCAST_ROWS:
        met = tests.crossJoin(F.broadcast(patterns))
    else:
        blocks = max(1, -(-tests.count() // BROADCAST_ROWS))
        parts = [patterns.crossJoin(F.broadcast(tests.where(F.pmod(F.xxhash64(*key), F.lit(blocks)) == k))) for k in range(blocks)]
        met = parts[0]
        for x in parts[1:]:
            met = met.unionByName(x)
    cells = met.groupBy(*key, F.col("pattern").bitwiseAND(F.col("given")).alias("s"), bit("a").alias("x"), bit("b").alias("y")).agg(F.sum("n").alias("n"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    x, y = F.col("x"), F.col("y")
    strata = cells.groupBy(*key, "s").agg(count(x & y).alias("n11"), count(x & ~y).alias("n10"), count(~x & y).alias("n01"), count(~x & ~y).alias("n00"))
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    part = lambda n, r, c: F.when(F.col(n) > 0, F.col(n) * F.ln(F.col(n) * total / (r * c))).otherwise(0.0)
    r1, r0, c1, c0 = F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00"), F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00")
    g = 2 * (part("n11", r1, c1) + part("n10", r1, c0) + part("n01", r0, c1) + part("n00", r0, c0))
    summed = strata.groupBy(*key).agg(F.sum(g).alias("g"))
    dof = F.pow(F.lit(2.0), F.bit_count("given")).cast("int")
    return summed.select(*key, F.greatest("g", F.lit(0.0)).alias("g"), dof.alias("dof")).withColumn("p_value", chi_square_tail(F.col("g"), F.col("dof"), 8))


def conditioning_sets(types: list[str], size: int) -> list[tuple[int]]:
    """The bits of every set of so many types."""
    return [(sum(1 << i for i in s),) for s in combinations(range(len(types)), size)]


def causal_structure(events: DataFrame, order: DataFrame, most: int = 3, alpha: float = 0.05) -> DataFrame:
    """(cause, effect, linked, size, undecided) of all pairs of types, by tests of independence given up to `most` (at most 3) others.

    Sets grow from none. A pair isn't linked if, given any set of so many other types, it is independent (p_value > alpha);
    size is that of the smallest such set. A pair's direction is that of the larger count in order (src_type, dst_type, n);
    without a larger one it stays as listed, undecided.
    """
    types = event_types(events)
    spark = events.sparkSession
    patterns = stage(presence(events, types), "patterns")
    bits = [(t, 1 << i) for i, t in enumerate(types)]
    edges = spark.createDataFrame([(a, b) for (_, a), (_, b) in combinations(bits, 2)], "a long, b long")
    removed = edges.limit(0).withColumn("size", F.lit(0))
    for size in range(min(most, 3, max(0, len(types) - 2)) + 1):
        sets = spark.createDataFrame(conditioning_sets(types, size), "given long")  # 37,820 of three at most
        tests = edges.crossJoin(F.broadcast(sets)).where(F.col("given").bitwiseAND(F.col("a").bitwiseOR(F.col("b"))) == 0)
        gone = stage(independence(patterns, tests).where(F.col("p_value") > alpha).select("a", "b").distinct().withColumn("size", F.lit(size)), "removed")
        removed = removed.unionByName(gone)
        edges = stage(edges.join(gone, ["a", "b"], "left_anti"), "pairs")
    every = removed.withColumn("linked", F.lit(False)).unionByName(edges.select("a", "b", F.lit(None).cast("int").alias("size"), F.lit(True).alias("linked")))
    names = spark.createDataFrame(bits, "name string, bit long")
    first, second = (names.select(F.col("name").alias(n), F.col("bit").alias(c)) for n, c in (("x", "a"), ("y", "b")))
    pairs = every.join(F.broadcast(first), "a").join(F.broadcast(second), "b")
    ahead = order.select(F.col("src_type").alias("x"), F.col("dst_type").alias("y"), F.col("n").alias("xy"))
    back = order.select(F.col("dst_type").alias("x"), F.col("src_type").alias("y"), F.col("n").alias("yx"))
    pairs = pairs.join(ahead, ["x", "y"], "left").join(back, ["x", "y"], "left").fillna(0, ["xy", "yx"])
    turned = F.col("yx") > F.col("xy")
    out = stage(pairs.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("cause"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("effect"), "linked", "size", (F.col("xy") == F.col("yx")).alias("undecided")), "structure")
    discard(patterns)
    return out


def type_order(edges: DataFrame) -> DataFrame:
    """(src_type, dst_type, n) of edges."""
    return edges.groupBy("src_type", "dst_type").agg(F.count("*").alias("n"))
