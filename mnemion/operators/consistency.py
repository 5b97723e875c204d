"""Consistency of temporal relations (src, dst, rel) with one another and with the times of events (id, t, optionally duration).

BEFORE and the causal relations put src before dst, AFTER the other way round. Times and durations are in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.sources.staging import discard, stage

#: The relations that order their ends, and those of them that need cause before effect.
ORDERING = ("BEFORE", "CAUSES", "ENABLES", "TRIGGERS", "PREVENTS")
CAUSAL = ("CAUSES", "ENABLES", "TRIGGERS", "PREVENTS")
WIDE = 16  # tables under one union
TRIMS = 20


def ordering_graph(relations: DataFrame) -> DataFrame:
    """(a, b): a is said to be before b; distinct."""
    turned = F.col("rel") == "AFTER"
    rows = relations.where(F.col("rel").isin(*ORDERING) | turned).where("src is not null and dst is not null")
    return rows.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id) of all nodes that starts (id) lead to, themselves included. A round a step of the longest way, over the last step's nodes only."""
    seen = at = stage(starts.select("id").distinct(), "reached")
    turn = 0
    while not at.isEmpty():
        new = edges.join(at.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        at = stage(new.join(seen, "id", "left_anti"), "frontier")
        seen = seen.unionByName(at)
        turn += 1
        if turn % WIDE == 0:
            seen = stage(seen, "reached")
    return seen


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without ends that have no way in or out, peeled TRIMS times at most: what is left over costs time only."""
    at, n = edges, None
    for turn in range(TRIMS):
        inner = at.select(F.col("a").alias("id")).distinct().join(at.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        kept = at.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi")
        last, at = at, stage(kept, "trimmed")
        if turn:
            discard(last)
        before, n = n, at.count()
        if n == before:
            break
    return at


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b): b is reached from a over one edge or more. Ways double in length each round; only new pairs are joined.

    Its size is that of the answer: cut edges down to what is asked for first.
    """
    known = new = stage(edges.select("a", "b").distinct(), "closure")
    for _ in range(rounds):
        if new.isEmpty():
            return known
        left = new.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        right = known.select("a", F.col("b").alias("m")).join(new.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        new = stage(left.unionByName(right).distinct().join(known, ["a", "b"], "left_anti"), "closure")
        known = known.unionByName(new)
    raise RuntimeError("ways longer than 2^rounds")


def cycles(relations: DataFrame) -> DataFrame:
    """(id, cycle, size): the events that lie on a cycle of the ordering, by the least event that each reaches and is reached from.

    Nodes that can't lie on one are trimmed first; the closure is taken of what stays.
    """
    edges = stage(ordering_graph(relations), "ordering")
    loops = edges.where("a = b").select("a", "b")
    core = _trimmed(edges.where("a != b"))
    reach = closure(core)
    both = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    named = both.unionByName(loops).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("cycle"))
    named = named.select("id", F.least("cycle", "id").alias("cycle"))
    return named.join(named.groupBy("cycle").agg(F.count("*").alias("size")), "cycle").select("id", "cycle", "size")


def transitive_violations(relations: DataFrame, events: DataFrame) -> DataFrame:
    """(src, dst, t_src, t_dst): src leads to dst in the ordering, yet its time isn't before dst's. Events without a time are passed through.

    Along edges whose times rise nothing can go wrong, so a way that does holds an edge whose times don't rise or aren't
    both known. Only what leads to such edges and what they lead to takes part in the closure.
    """
    times = events.select("id", "t")
    edges = ordering_graph(relations)
    timed = edges.join(times.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a", "left").join(times.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b", "left")
    timed = stage(timed.select("a", "b", F.coalesce(F.col("ta") < F.col("tb"), F.lit(False)).alias("rises")), "timed")
    bad = timed.where("not rises")
    up = _reached(timed.select(F.col("b").alias("a"), F.col("a").alias("b")), bad.select(F.col("a").alias("id")))
    down = _reached(timed.select("a", "b"), bad.select(F.col("b").alias("id")))
    part = stage(up.unionByName(down).distinct(), "part")
    inside = timed.join(part.withColumnRenamed("id", "a"), "a", "left_semi").join(part.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = closure(inside.select("a", "b")).where("a != b")
    known = times.where("t is not null")
    met = pairs.join(known.select(F.col("id").alias("a"), F.col("t").alias("t_src")), "a").join(known.select(F.col("id").alias("b"), F.col("t").alias("t_dst")), "b")
    return met.where("t_src >= t_dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "t_src", "t_dst")


def _timed(relations: DataFrame, events: DataFrame) -> DataFrame:
    """relations with found_src, found_dst, t_src, t_dst, d_src, d_dst; unknown ends stay."""
    duration = F.col("duration").cast("long") if "duration" in events.columns else F.lit(None).cast("long")
    ends = events.select("id", F.lit(True).alias("found"), "t", duration.alias("d"))
    out = relations
    for end in ("src", "dst"):
        out = out.join(ends.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("found", "t", "d")]), end, "left")
    return out


def pair_violations(relations: DataFrame, events: DataFrame, strict: bool = True) -> DataFrame:
    """(src, dst, rel, violation, severity) of single relations: causal order, missing events or times, DURING, CONTAINS, SIMULTANEOUS."""
    both = F.col("found_src").isNotNull() & F.col("found_dst").isNotNull()
    timed = F.col("t_src").isNotNull() & F.col("t_dst").isNotNull()
    within = lambda t, start, length: (t >= start) & (t <= start + length)
    lasts = lambda d: F.coalesce(d != 0, F.lit(False))
    causal = F.col("rel").isin(*CAUSAL)
    wrong = (
        F.when(causal & ~both, "unknown_event")
        .when(causal & ~timed, "missing_time")
        .when(causal & (F.col("t_src") >= F.col("t_dst")), "causal_order")
        .when(both & timed & (F.col("rel") == "DURING") & lasts(F.col("d_dst")) & ~within(F.col("t_src"), F.col("t_dst"), F.col("d_dst")), "interval")
        .when(both & timed & (F.col("rel") == "CONTAINS") & lasts(F.col("d_src")) & ~within(F.col("t_dst"), F.col("t_src"), F.col("d_src")), "interval")
        .when(both & timed & (F.col("rel") == "SIMULTANEOUS") & (F.col("t_src") != F.col("t_dst")), "interval")
    )
    severity = F.when(F.col("violation") == "causal_order", "error").when(F.col("violation") == "missing_time", "error" if strict else "warning").otherwise("warning")
    return _timed(relations, events).withColumn("violation", wrong).where("violation is not null").select("src", "dst", "rel", "violation", severity.alias("severity"))


def violations(relations: DataFrame, events: DataFrame, strict: bool = True) -> DataFrame:
    """(src, dst, rel, violation, severity): every violation; a cycle has a row for each event on it, with the cycle's name as dst."""
    none = F.lit(None).cast("string").alias("rel")
    round_ = cycles(relations).select(F.col("id").alias("src"), F.col("cycle").alias("dst"), none, F.lit("cycle").alias("violation"), F.lit("error").alias("severity"))
    over = transitive_violations(relations, events).select("src", "dst", none, F.lit("transitivity").alias("violation"), F.lit("error").alias("severity"))
    return round_.unionByName(over).unionByName(pair_violations(relations, events, strict))


def report(found: DataFrame) -> DataFrame:
    """(violation, errors, warnings) of violations."""
    return found.groupBy("violation").agg(F.count_if(_is("error")).alias("errors"), F.count_if(_is("warning")).alias("warnings"))


def _is(severity: str) -> Column:
    return F.col("severity") == severity
