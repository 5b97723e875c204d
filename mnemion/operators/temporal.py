"""Temporal event analytics. Events have (id, entity, type, ts, t): t is the time in microseconds.

What needs the order of events works within an entity, so it partitions by that; nothing orders the whole table in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.functions import stats
from mnemion.sources.staging import stage

SECOND = 1_000_000
DAY = 86_400 * SECOND
CELL = 2048  # starts of intervals, and intervals, that meet in one cell
PAIRS = 1 << 22  # that may meet in one task, about


def time_range(events: DataFrame, start: str, end: str, types: Sequence[str] | None = None) -> DataFrame:
    """Events from start to end, both included. A start after the end is an error."""
    if start > end:
        raise ValueError("start is after end")
    found = events.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return found.where(F.col("type").isin(list(types))) if types else found


def with_decay(events: DataFrame, reference: str, half_life: float = 30.0) -> DataFrame:
    days = (F.unix_micros(F.lit(reference).cast("timestamp")) - F.col("t")) / float(DAY)
    return events.withColumn("score", stats.decay(days, half_life))


def relative_to(events: DataFrame, reference_id: int, kind: str, window_s: int, limit: int | None = None) -> DataFrame:
    """Events before, after or within a tolerance of a reference event, nearest first; the reference is left out."""
    ref = events.where(F.col("id") == reference_id).agg(F.min("t").alias("t")).first().t  # one number
    gap = F.col("t") - F.lit(ref).cast("long")
    inside = {"before": (gap < 0) & (gap >= -window_s * SECOND), "after": (gap > 0) & (gap <= window_s * SECOND), "simultaneous": F.abs(gap) <= window_s * SECOND}[kind]
    found = events.where(inside & (F.col("id") != reference_id)).withColumn("gap_s", gap / SECOND)
    return found.orderBy(F.abs("gap_s"), "id").limit(limit) if limit else found


def weekdays(events: DataFrame, peak: float = 25.0) -> DataFrame:
    """Counts of the seven weekdays (Monday is 0), also of empty ones, and their deviation from the mean in percent."""
    days = events.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    counts = events.groupBy(F.weekday("ts").alias("weekday")).count()
    n = F.coalesce("count", F.lit(0))
    mean = F.sum(n).over(W.partitionBy()) / 7  # over seven rows
    deviation = F.when(mean > 0, (n - mean) / mean * 100).otherwise(0.0)
    return days.join(F.broadcast(counts), "weekday", "left").select("weekday", n.alias("n"), F.round(deviation, 6).alias("deviation"), F.when(deviation > peak, "peak").when(deviation < -peak, "trough").otherwise("normal").alias("kind"))


def gaps(events: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """events with the seconds since the one before of the same group."""
    w = W.partitionBy(*by).orderBy("t", "id")
    return events.withColumn("gap_s", (F.col("t") - F.lag("t").over(w)) / SECOND)


def gap_statistics(rows: DataFrame, by: Sequence[str], gap: str = "gap_s") -> DataFrame:
    """n, mean, least, largest, sample deviation, consistency and strength of gaps."""
    std = F.coalesce(F.stddev_samp(gap), F.lit(0.0))
    out = rows.where(F.col(gap).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(gap).alias("avg_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"), std.alias("std_gap"))
    even = stats.consistency(F.col("avg_gap"), F.col("std_gap"))
    return out.withColumn("consistency", even).withColumn("strength", even * F.least(F.lit(1.0), F.col("n") / 10))


def ngrams(events: DataFrame, length: int, least: int = 3) -> DataFrame:
    """Sequences of `length` types in an entity's order of time, with their number and share; windows holding a null are left out."""
    w = W.partitionBy("entity").orderBy("t", "id")
    pattern = F.concat_ws(">", *[F.lead("type", i).over(w) for i in range(length)])
    whole = F.lead("type", length - 1).over(w).isNotNull()
    parts = [F.lead("type", i).over(w).isNotNull() for i in range(length)]
    for p in parts:
        whole = whole & p
    found = events.select(F.when(whole, pattern).alias("pattern")).where("pattern is not null")
    return found.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def sequences(events: DataFrame, types: Sequence[str], max_gap_s: int) -> DataFrame:
    """From each event of the first type the earliest event of the next type after it within the gap, and so on; candidates
    may be shared. The next event of a type is the least among those that follow: a frame that only grows when an entity's
    events are read backwards, so the work is linear."""
    # An event at the same time isn't after it: range frames leave it out.
    later = W.partitionBy("entity").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, -1)
    at = events.select("entity", "id", "t", "type")
    for a, b in zip(types[:-1], types[1:], strict=True):
        nxt = F.min(F.when(F.col("type") == b, F.struct("t", "id"))).over(later)
        at = at.withColumn(f"next_{a}_{b}", F.when(nxt["t"] - F.col("t") <= max_gap_s * SECOND, nxt))
    heads = at.where(F.col("type") == types[0]).select("entity", F.col("id").alias("id_0"), F.col("t").alias("t_0"), F.col(f"next_{types[0]}_{types[1]}").alias("n"))
    heads = heads.where("n is not null").select("entity", "id_0", "t_0", F.col("n.id").alias("id_1"), F.col("n.t").alias("t_1"))
    for i in range(2, len(types)):
        step = at.where(F.col("type") == types[i - 1]).select(F.col("id").alias(f"id_{i - 1}"), F.col(f"next_{types[i - 1]}_{types[i]}").alias("n")).where("n is not null")
        heads = heads.join(step, f"id_{i - 1}").withColumn(f"id_{i}", F.col("n.id")).withColumn(f"t_{i}", F.col("n.t")).drop("n")
    return heads


class Matcher:
    """One-to-one matches of a and b events that come in the order of time: an a takes the earliest b not yet taken with
    least <= b - a <= most. A b is offered to the first a that still waits; one too early for it is too early for all others."""

    def __init__(self, least: int, most: int):
        self.least, self.most = least, most
        self.waiting: deque = deque()

    def add_a(self, t: int, name) -> None:
        self.waiting.append((t, name))

    def add_b(self, t: int):
        """(time, name) of the a that takes this b, if any."""
        while self.waiting and t - self.waiting[0][0] > self.most:
            self.waiting.popleft()
        return self.waiting.popleft() if self.waiting and t - self.waiting[0][0] >= self.least else None


def match_one_to_one(a: np.ndarray, b: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(i, j) of sorted times a and b, in the order of a."""
    m, out = Matcher(least, most), []
    for t, role, i in sorted([(t, 0, i) for i, t in enumerate(a)] + [(t, 1, i) for i, t in enumerate(b)]):
        if role == 0:
            m.add_a(t, i)
        elif found := m.add_b(t):
            out.append((found[1], i))
    return sorted(out)


def greedy_pairs(events: DataFrame, pairs: Iterable[tuple[str, str]], max_gap_s: int, min_lag_s: float = 1e-6) -> DataFrame:
    """(entity, type_a, type_b, id_a, id_b, gap_s): one-to-one matches of each pair of different types, within an entity.

    An entity's events are cut where nothing happens for longer than the gap; each run streams past one matcher a pair, which
    holds only the events that still wait.
    """
    pairs = [(a, b) for a, b in pairs if a != b]
    least, most = max(1, int(min_lag_s * SECOND)), max_gap_s * SECOND
    as_a: dict[str, list[int]] = {}
    as_b: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(pairs):
        as_a.setdefault(a, []).append(i)
        as_b.setdefault(b, []).append(i)
    w = W.partitionBy("entity").orderBy("t", "id")
    rows = events.where(F.col("type").isin(sorted({*as_a, *as_b}))).select("entity", "type", "id", "t")
    pause = F.coalesce((F.col("t") - F.lag("t").over(w) > most).cast("int"), F.lit(0))
    rows = rows.withColumn("pause", pause).withColumn("run", F.sum("pause").over(w))
    names = ["entity", "type_a", "type_b", "id_a", "id_b", "gap_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_a = None, []
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for entity, part, kind, i, t in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (entity, part) != at:
                    at, open_a = (entity, part), [Matcher(least, most) for _ in pairs]
                for p in as_b.get(kind, ()):
                    if found := open_a[p].add_b(t):
                        for c, v in zip(out, (entity, *pairs[p], found[1], i, (t - found[0]) / SECOND), strict=True):
                            c.append(v)
                for p in as_a.get(kind, ()):
                    open_a[p].add_a(t, i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.float64())], names)

    kind = events.schema["entity"].dataType.simpleString()
    dealt = rows.repartition("entity", "run").sortWithinPartitions("entity", "run", "t", "id").select("entity", "run", "type", F.col("id").cast("long").alias("id"), "t")
    return dealt.mapInArrow(run, f"entity {kind}, type_a string, type_b string, id_a long, id_b long, gap_s double")


def types_of(events: DataFrame) -> list[str]:
    """The types of events, which are few."""
    return sorted(r.type for r in events.select("type").where("type is not null").distinct().collect())


def following(events: DataFrame, gap_s: int) -> DataFrame:
    """(id, type_a, type_b, after, ties): of each event and each other type, how many events of it follow within the gap, and how many are at the same time.

    Running counts of each type in an entity's order of time, read off just before and after an event's time and at the end
    of its gap: linear, however many pairs there are.
    """
    types = types_of(events)
    marks = F.array(*[F.struct((F.col("t") + d).alias("at"), F.lit(role).alias("role"), F.lit(i).alias("mark")) for d, role, i in ((0, -1, 0), (0, 0, 1), (0, 1, 2), (gap_s * SECOND, 1, 3))])
    rows = events.where("type is not null").select("entity", "id", "type", F.explode(marks).alias("m")).select("entity", "id", "type", "m.*")
    w = W.partitionBy("entity").orderBy("at", "role", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = F.array(*[F.sum(((F.col("mark") == 1) & (F.col("type") == k)).cast("long")).over(w) for k in types])
    seen = rows.select("entity", "id", "type", "mark", counts.alias("c")).where("mark != 1")
    read = [F.max(F.when(F.col("mark") == i, F.col("c"))).alias(f"c{i}") for i in (0, 2, 3)]
    one = seen.groupBy("entity", "id", "type").agg(*read)
    pairs = F.array(*[F.struct(F.lit(k).alias("type_b"), (F.col("c3")[i] - F.col("c2")[i]).alias("after"), (F.col("c2")[i] - F.col("c0")[i]).alias("ties")) for i, k in enumerate(types)])
    out = one.select("id", F.col("type").alias("type_a"), F.explode(pairs).alias("p")).select("id", "type_a", "p.*")
    return out.where("type_a != type_b")


def nearest_following(events: DataFrame, gap_s: int) -> DataFrame:
    """(type_a, type_b, avg_gap, min_gap): seconds from events of type a to the next of type b, where one follows within the gap."""
    types = types_of(events)
    later = W.partitionBy("entity").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, -1)
    nexts = F.array(*[F.struct(F.lit(k).alias("type_b"), (F.min(F.when(F.col("type") == k, F.col("t"))).over(later) - F.col("t")).alias("gap")) for k in types])
    pairs = events.select(F.col("type").alias("type_a"), nexts.alias("n")).select("type_a", F.explode("n").alias("n")).select("type_a", "n.*").where(F.col("gap").isNotNull() & (F.col("gap") <= gap_s * SECOND) & (F.col("type_a") != F.col("type_b")))
    return pairs.groupBy("type_a", "type_b").agg((F.avg("gap") / SECOND).alias("avg_gap"), (F.min("gap") / SECOND).alias("min_gap"))


def cooccurrence(events: DataFrame, max_gap_s: int) -> DataFrame:
    """(type_a, type_b, n_a, n_b, observed): of the events of type a, those that an event of type b follows within the gap."""
    observed = following(events, max_gap_s).where("after > 0").groupBy("type_a", "type_b").agg(F.count("*").alias("observed"))
    sizes = events.groupBy("type").agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col("type").alias("type_a"), F.col("n").alias("n_a")), sizes.select(F.col("type").alias("type_b"), F.col("n").alias("n_b"))
    return observed.join(a, "type_a").join(b, "type_b").select("type_a", "type_b", "n_a", "n_b", "observed")


def significance(pairs: DataFrame, gap_days: float, range_days: float, alpha: float = 0.05, least_effect: float = 0.1) -> DataFrame:
    """pairs with expected, chi, p_value, effect, effect_label, significant: few observations take the Fisher form."""
    obs, n_a, n_b = F.col("observed"), F.col("n_a"), F.col("n_b")
    few = (n_a + n_b < 20) | (obs < 5)
    out = pairs.withColumn("expected", stats.expected_cooccurrence(n_a, n_b, gap_days, range_days))
    out = out.withColumn("chi", F.when(few, stats.fisher_chi(obs, n_a, n_b)).otherwise(stats.chi_square(obs, F.col("expected"), n_a)))
    out = out.withColumn("p_value", F.greatest(F.lit(0.0), stats.chi_p_value(F.col("chi"))))
    odds, v = stats.odds_ratio(obs, n_a, n_b), stats.cramers_v(F.col("chi"), n_a + n_b)
    out = out.withColumn("effect", F.when(few, odds).otherwise(v)).withColumn("effect_label", F.when(few, stats.band(odds, (1.5, 2.5, 4.0))).otherwise(stats.band(v, (0.1, 0.3, 0.5))))
    return out.withColumn("significant", (F.col("p_value") < alpha) & (obs > F.col("expected")) & (F.col("effect") >= least_effect))


def corrected(tests: DataFrame, order: Sequence[str], alpha: float = 0.05, method: str = "running_max") -> DataFrame:
    """tests (one row per pair of types) with rank, bonferroni and fdr: Bonferroni- and false-discovery-corrected p-values. p-values that agree to nine places are ties.

    running_max takes the running maximum from the smallest p upward; standard is Benjamini and Hochberg's step-up minimum.
    """
    w = W.orderBy(F.round("p_value", 9), *order)  # as many rows as pairs of types
    n = F.count("*").over(W.partitionBy())
    ranked = tests.withColumn("rank", F.row_number().over(w)).withColumn("tests", n)
    ranked = ranked.withColumn("bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("tests"))).withColumn("raw", F.least(F.lit(1.0), F.col("p_value") * F.col("tests") / F.col("rank")))
    up = F.max("raw").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    down = F.min("raw").over(W.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))
    out = ranked.withColumn("fdr", up if method == "running_max" else down)
    return out.withColumn("bonferroni_significant", F.col("p_value") < F.lit(alpha) / F.col("tests")).withColumn("fdr_significant", F.col("fdr") < alpha).drop("raw")


def precedence(events: DataFrame, lag_s: int, least: int = 3, threshold: float = 0.6) -> DataFrame:
    """(type_a, type_b, pairs, p_ab, p_ba, edge) for a < b: how often an entity's a comes before its b within the lag.

    Equal times count as b before a.
    """
    counts = following(events, lag_s).groupBy("type_a", "type_b").agg(F.sum("after").alias("after"), F.sum("ties").alias("ties"))
    first = F.col("type_a") < F.col("type_b")
    sides = counts.select(F.least("type_a", "type_b").alias("a"), F.greatest("type_a", "type_b").alias("b"), F.when(first, F.col("after")).otherwise(0).alias("ab"), F.when(first, F.col("ties")).otherwise(F.col("after")).alias("ba"))
    out = sides.groupBy("a", "b").agg(F.sum(F.col("ab") + F.col("ba")).alias("pairs"), F.sum("ab").alias("n_ab")).where(F.col("pairs") >= least)
    p = F.col("n_ab") / F.col("pairs")
    return out.select(F.col("a").alias("type_a"), F.col("b").alias("type_b"), "pairs", p.alias("p_ab"), (1 - p).alias("p_ba"), F.when(p >= threshold, "a->b").when(1 - p >= threshold, "b->a").otherwise("none").alias("edge"))


def causal_order(matrix: DataFrame) -> tuple[list[str], float]:
    """(types in causal order, confidence) of a precedence matrix, whose rows are pairs of types: few, whatever the events.

    Types without a predecessor come first, alphabetically; what is in a cycle follows, sorted.
    """
    rows = matrix.collect()
    types = sorted({t for r in rows for t in (r.type_a, r.type_b)})
    after = {t: set() for t in types}
    weight = {}
    for r in rows:
        weight[r.type_a, r.type_b], weight[r.type_b, r.type_a] = r.p_ab, r.p_ba
        if r.edge != "none":
            a, b = (r.type_a, r.type_b) if r.edge == "a->b" else (r.type_b, r.type_a)
            after[b].add(a)
    order: list[str] = []
    while free := sorted(t for t in types if t not in order and after[t] <= set(order)):
        order.append(free[0])
    order += sorted(set(types) - set(order))
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    return order, sum(weight.get(p, 0.5) >= 0.5 for p in pairs) / len(pairs) if pairs else 1.0


def lag_buckets(matches: DataFrame, lo_s: float, width_s: float, least: int = 3, share: float = 0.15) -> DataFrame:
    """(type_a, type_b, bucket_s, n, avg_gap, share, significant) of matched gaps."""
    bucket = lo_s + F.floor((F.col("gap_s") - lo_s) / width_s) * width_s
    out = matches.groupBy("type_a", "type_b", bucket.alias("bucket_s")).agg(F.count("*").alias("n"), F.avg("gap_s").alias("avg_gap"))
    part = F.col("n") / F.sum("n").over(W.partitionBy("type_a", "type_b"))
    return out.withColumn("share", part).withColumn("significant", (F.col("n") >= least) & (F.col("share") > share))


def correlations(events: DataFrame, max_gap_s: int, least: int = 2, causal_consistency: float = 0.5) -> DataFrame:
    """Gap statistics of the one-to-one matches of all ordered pairs of types, and whether each is a causal candidate."""
    types = types_of(events)
    matched = greedy_pairs(events, [(a, b) for a in types for b in types if a != b], max_gap_s)
    out = gap_statistics(matched, ["type_a", "type_b"]).where(F.col("n") >= least)
    return out.withColumn("causal", (F.col("n") >= 2 * least) & (F.col("consistency") >= causal_consistency))


def scanned(events: DataFrame, max_gap_s: int, least: int = 3, drop: bool = True) -> DataFrame:
    """The correlations of all ordered pairs of types that agree with the causal order of types, tested and corrected.

    The matches of a pair are its observations, the table's span of time the range that is expected of chance. Those that
    aren't significant after correction are dropped, or else flagged.
    """
    found = correlations(events, max_gap_s, least).withColumnRenamed("n", "observed")
    order, _ = causal_order(precedence(events, 72 * 3600))  # a list of types
    place = lambda c: F.array_position(F.array(*[F.lit(t) for t in order]).cast("array<string>"), F.col(c))
    found = found.where((place("type_a") == 0) | (place("type_b") == 0) | (place("type_a") < place("type_b")))
    sizes = events.groupBy("type").agg(F.count("*").alias("n"))
    found = found.join(sizes.select(F.col("type").alias("type_a"), F.col("n").alias("n_a")), "type_a").join(sizes.select(F.col("type").alias("type_b"), F.col("n").alias("n_b")), "type_b")
    span = events.agg(((F.max("t") - F.min("t")) / DAY).alias("days")).first().days or 0.0
    tested = corrected(significance(found, max_gap_s * SECOND / DAY, span), ["type_a", "type_b"]).withColumn("remains", F.col("significant") & F.col("fdr_significant"))
    return tested.where("remains") if drop else tested


def summary(correlations: DataFrame) -> DataFrame:
    """(total, causal, avg_strength, strongest) of correlations, one row; strongest is null where there are none."""
    best = F.max(F.struct("strength", F.concat_ws(" > ", "type_a", "type_b").alias("pair")))
    return correlations.agg(F.count("*").alias("total"), F.count_if("causal").alias("causal"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("avg_strength"), best.alias("b")).select("total", "causal", "avg_strength", F.col("b.pair").alias("strongest"))


def neighbourhood(edges: DataFrame, centres: DataFrame, times: DataFrame, window_s: int) -> DataFrame:
    """(centre, neighbour, rel, way, decay): nodes one edge away from centres (id, t), either way, near in time.

    An edge counts if its valid_from is within the window around the centre's time or null, or if the neighbour is an event
    (times: id, t) within it. decay is that of the time between the centre and the neighbour, 1 where it has none.
    """
    ways = edges.select(F.col("src").alias("centre"), F.col("dst").alias("neighbour"), "rel", "valid_from", F.lit("outgoing").alias("way")).unionByName(edges.select(F.col("dst").alias("centre"), F.col("src").alias("neighbour"), "rel", "valid_from", F.lit("incoming").alias("way")))
    near = ways.join(centres.select(F.col("id").alias("centre"), F.col("t").alias("t_centre")), "centre").join(times.select(F.col("id").alias("neighbour"), F.col("t").alias("t_neighbour")), "neighbour", "left")
    inside = lambda c: F.abs(c - F.col("t_centre")) <= window_s * SECOND
    valid = F.unix_micros(F.col("valid_from").cast("timestamp"))
    found = near.where(valid.isNull() | inside(valid) | F.coalesce(inside(F.col("t_neighbour")), F.lit(False)))
    days = F.abs(F.col("t_neighbour") - F.col("t_centre")) / DAY
    return found.select("centre", "neighbour", "rel", "way", F.coalesce(stats.decay(days), F.lit(1.0)).alias("decay")).distinct()


def hybrid_neighbourhood(graph: DataFrame, similar: DataFrame, vector_weight: float = 0.3) -> DataFrame:
    """(centre, neighbour, score): the best decay of each neighbour and its similarity (centre, neighbour, similarity), weighted; 0 where one is missing."""
    near = graph.groupBy("centre", "neighbour").agg(F.max("decay").alias("decay"))
    both = near.join(similar, ["centre", "neighbour"], "full_outer")
    return both.select("centre", "neighbour", ((1 - vector_weight) * F.coalesce("decay", F.lit(0.0)) + vector_weight * F.coalesce("similarity", F.lit(0.0))).alias("score"))


def overlapping(intervals: DataFrame, others: DataFrame, width_s: int) -> DataFrame:
    """(id_a, id_b) of rows (id, lo, hi) of two tables whose intervals, both ends included, overlap: a range join.

    Of two that overlap one starts within the other; so each pair is met once, where a start, in its bucket of `width_s`,
    meets the intervals that touch the bucket. Few rows make very many pairs: the starts of a bucket and the intervals that
    touch it are dealt over cells of about CELL of either, and tasks are as many as the pairs ask for, whatever the bytes. So
    a task holds few rows of a bucket, however many it has, and the pairs that it writes, in order of time, name few ids.
    """
    width = width_s * SECOND
    one, other = (stage(df.select("id", "lo", "hi"), "intervals") for df in (intervals, others))
    within = lambda a, b, met: _starting(a, b, width).where(met)
    first = within(one, other, F.col("at") >= F.col("lo")).select(F.col("start").alias("id_a"), F.col("id").alias("id_b"))
    return first.unionByName(within(other, one, F.col("at") > F.col("lo")).select(F.col("id").alias("id_a"), F.col("start").alias("id_b")))


def _starting(starts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(start, at, end, id, lo, hi): rows of starts, by their id, lo and hi, with the spans that touch the same bucket and don't lie before or behind."""
    bucket = lambda c: F.floor(F.col(c) / width)
    a = starts.select(F.col("id").alias("start"), F.col("lo").alias("at"), F.col("hi").alias("end"), bucket("lo").alias("bucket"))
    b = spans.select("id", "lo", "hi", F.explode(F.sequence(bucket("lo"), bucket("hi"))).alias("bucket"))
    sizes = a.groupBy("bucket").agg(F.count("*").alias("n")).join(b.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    sizes = stage(sizes.select("bucket", "n", "m", *[(1 + F.floor(F.col(c) / CELL)).cast("int").alias(k) for c, k in (("n", "cells"), ("m", "parts"))]), "sizes")
    work = sizes.agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum(F.col("cells").cast("long") * F.col("parts")).alias("cells")).first()
    tasks = min(1 + (work.pairs or 0) // PAIRS, work.cells or 1)
    cells = sizes.select("bucket", "cells", "parts")
    mine = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ("bucket", "cell", "part")
    a = a.join(cells, "bucket").select("bucket", mine("start", "cells").alias("cell"), every("parts").alias("part"), "start", "at", "end")
    b = b.join(cells, "bucket").select("bucket", every("cells").alias("cell"), mine("id", "parts").alias("part"), "id", "lo", "hi")
    a, b = (df.repartition(tasks, *key).sortWithinPartitions(*key, by) for df, by in ((a, "at"), (b, "lo")))
    return a.join(b.hint("merge"), list(key)).where("at <= hi and lo <= end")


def rhythm(events: DataFrame) -> DataFrame:
    """(entity, n, period_s, cv, cyclic, trend, ratio) of each entity: regular gaps, and the later half's gaps against the earlier's."""
    w = W.partitionBy("entity").orderBy("t", "id")
    rows = gaps(events).withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(W.partitionBy("entity")))
    first = F.col("k") - 1 <= F.floor((F.col("m") - 1) / 2)
    out = rows.where("gap_s is not null").groupBy("entity").agg((F.count("*") + 1).alias("n"), F.avg("gap_s").alias("period_s"), F.stddev_pop("gap_s").alias("std"), F.avg(F.when(first, F.col("gap_s"))).alias("early"), F.avg(F.when(~first, F.col("gap_s"))).alias("late"))
    cv = F.when(F.col("period_s") > 0, F.col("std") / F.col("period_s")).otherwise(0.0)
    ratio = F.when(F.col("late") > 0, F.col("early") / F.col("late"))
    trend = F.when((F.col("n") < 5) | ratio.isNull(), "unknown").when(ratio > 1.3, "increasing").when(ratio < 0.7, "decreasing").otherwise("stable")
    return out.select("entity", "n", "period_s", cv.alias("cv"), ((F.col("n") >= 4) & (cv < 0.3)).alias("cyclic"), trend.alias("trend"), ratio.alias("ratio"))


def bootstrap_mean(rows: DataFrame, by: Sequence[str], value: str, resamples: int = 200, seed: int = 1) -> DataFrame:
    """95 % bootstrap interval of a mean, by Poisson resampling: each row weighs in every resample with a count that is hashed
    from it, so one pass with partial aggregation does, and reruns give the same."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(value), F.col("id_a"), F.col("b")), F.lit(1 << 30)) / float(1 << 30)
    cdf, total, weight = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += weight
        cdf.append(total)
        weight /= k + 1
    count = sum(((u > c).cast("int") for c in cdf[1:]), (u > cdf[0]).cast("int"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", count)
    means = drawn.groupBy(*by, "b").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def order_violations(edges: DataFrame, rels: Sequence[str] = ("CAUSES", "ENABLES", "TRIGGERS", "BEFORE")) -> DataFrame:
    """Edges whose source isn't strictly before their target."""
    return edges.where(F.col("rel").isin(list(rels)) & (F.col("t_src") >= F.col("t_dst")))


def markers(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, marker, k): dates in ISO, US and European form in texts, in order of each kind."""
    kinds = {"iso": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "us": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", "eu": r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b"}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("all")) for k, p in kinds.items()])
    rows = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.kind", F.posexplode("m.all").alias("k", "marker"))
    return rows.select("doc_id", "kind", "marker", "k")


def relative_marker(c: Column, reference: Column) -> Column:
    """The date that `yesterday`, `tomorrow`, `n days/weeks ago` or `in n days/weeks` means at a reference date."""
    low = F.lower(c)
    n = F.regexp_extract(low, r"([0-9]+)\s+(?:day|week)", 1).cast("int") * F.when(low.contains("week"), 7).otherwise(1)
    return F.when(low.contains("yesterday"), F.date_sub(reference, 1)).when(low.contains("tomorrow"), F.date_add(reference, 1)).when(low.contains("today"), F.to_date(reference)).when(low.rlike(r"[0-9]+\s+(?:day|week)s?\s+ago"), F.date_sub(reference, n)).when(low.rlike(r"in\s+[0-9]+\s+(?:day|week)s?"), F.date_add(reference, n))
