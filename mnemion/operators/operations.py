"""Operational analytics and insight scores: audit chains, anomalies, queues, latencies, feedback."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.operators.ranking import percentiles


def audit_breaks(log: DataFrame, by: str = "stream", order: str = "seq") -> DataFrame:
    """Rows of a hash-chained log whose own hash or link to the row before is wrong.

    log has payload, prev_hash and chain_hash = sha256(prev_hash + '|' + payload); a stream begins with prev_hash ''.
    """
    w = W.partitionBy(by).orderBy(order)
    own = F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("payload")).cast("binary"), 256)
    before = F.coalesce(F.lag("chain_hash").over(w), F.lit(""))
    rows = log.withColumn("tampered", own != F.col("chain_hash")).withColumn("unlinked", before != F.col("prev_hash"))
    return rows.where("tampered or unlinked")


def chained(log: DataFrame, by: str = "stream", order: str = "seq", cut: str = "cut") -> DataFrame:
    """log (payload, cut) with prev_hash and chain_hash; where cut, a row but a stream's first names no row before.

    A stream's rows are hashed one after the other as they pass, so a long stream needs no memory.
    """
    kind = log.schema[by].dataType.simpleString()
    names = [by, order, "payload", "prev_hash", "chain_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for b in batches:
            before, own = [], []
            for stream, _, payload, is_cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (stream,):
                    at, last = (stream,), ""
                elif is_cut:
                    last = "cut"
                before.append(last)
                last = sha256(f"{last}|{payload}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(before, pa.string()), pa.array(own, pa.string())], names)

    rows = log.select(by, F.col(order).cast("long").alias(order), "payload", cut)
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, f"`{by}` {kind}, `{order}` long, payload string, prev_hash string, chain_hash string")


def sliding_counts(events: DataFrame, by: str, minutes: int, least: int) -> DataFrame:
    """Events at which a key has at least `least` events within the last minutes; of a key's hour the first."""
    span = minutes * 60_000_000
    w = W.partitionBy(by).orderBy("t").rangeBetween(-span, 0)
    hits = events.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") >= least)
    hour = F.floor(F.col("t") / 3_600_000_000)
    first = F.min(F.struct("t", "id", "in_window"))
    return hits.groupBy(by, hour.alias("hour")).agg(first.alias("f")).select(by, "hour", F.col("f.id").alias("id"), F.col("f.in_window").alias("in_window"))


def volume_spikes(volumes: DataFrame, by: str, order: str, volume: str, factor: float = 3.0) -> DataFrame:
    """Rows whose volume is above `factor` times the mean of the up to nine before, if there are three."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(-9, -1)
    rows = volumes.withColumn("baseline", F.avg(volume).over(w)).withColumn("samples", F.count(volume).over(w))
    return rows.where((F.col("samples") >= 3) & (F.col(volume) > factor * F.col("baseline")))


def illegal_transitions(states: DataFrame, allowed: list[tuple[str, str]], by: str, order: str, state: str = "status") -> DataFrame:
    """(by, order, before, after): consecutive states that no allowed pair names."""
    w = W.partitionBy(by).orderBy(order)
    steps = states.select(by, order, F.lag(state).over(w).alias("before"), F.col(state).alias("after")).where("before is not null")
    legal = states.sparkSession.createDataFrame(allowed, "before string, after string")
    return steps.join(F.broadcast(legal), ["before", "after"], "left_anti").select(by, order, "before", "after")


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean and exact 50th, 95th and 99th percentiles of what isn't null."""
    found = percentiles(rows, by, value, (0.5, 0.95, 0.99))
    return found.select(by, "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def fairness(rows: DataFrame, value: str) -> DataFrame:
    """(n, jain, cv, ratio) of values: 1 if they are all equal, or all zero."""
    x = F.col(value).cast("double")
    out = rows.agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.stddev_pop(x).alias("sd"), F.avg(x).alias("m"), F.max(x).alias("hi"), F.min(x).alias("lo"))
    return out.select("n", F.when(F.col("q") > 0, F.col("s") * F.col("s") / (F.col("n") * F.col("q"))).otherwise(1.0).alias("jain"), F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0).alias("cv"), F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).alias("ratio"))


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 300.0, kind: str = "exponential") -> Column:
    grown = {"exponential": base * F.pow(F.lit(factor), attempt), "linear": base * (attempt + 1), "fixed": F.lit(base)}[kind]
    return F.least(F.lit(most), grown)


def search_rates(searches: DataFrame, by: str) -> DataFrame:
    """Rates of clicks, refinements and searches without results of searches (clicked, refined, results), and click less refine."""
    rate = lambda c: F.avg(c.cast("double"))
    out = searches.groupBy(by).agg(F.count("*").alias("n"), rate(F.col("clicked")).alias("click_rate"), rate(F.col("refined")).alias("refine_rate"), rate(F.col("results") == 0).alias("empty_rate"))
    return out.withColumn("trend", F.col("click_rate") - F.col("refine_rate"))


def bandit(history: DataFrame, by: str, quality: str, success: str, explore: float = 1.4) -> DataFrame:
    """(by, n, score): upper confidence bounds of strategies by their history."""
    rows = history.groupBy(by).agg(F.count("*").alias("n"), F.avg(quality).alias("q"), F.avg(F.col(success).cast("double")).alias("s"))
    total = F.sum("n").over(W.partitionBy())  # one row a strategy
    return rows.select(by, "n", (F.col("q") * F.col("s") + explore * F.sqrt(F.ln(total) / F.col("n"))).alias("score"))


def priors(history: DataFrame, by: str, success: str) -> DataFrame:
    """(by, successes, failures, confidence)."""
    ok = F.col(success).cast("int")
    return history.groupBy(by).agg(F.sum(ok).alias("successes"), F.sum(1 - ok).alias("failures")).withColumn("confidence", F.col("successes") / (F.col("successes") + F.col("failures")))


def insight_confidence(n: Column, p: Column, strength: Column) -> Column:
    score = 0.5 + F.when(n >= 10, 0.2).when(n >= 5, 0.1).otherwise(0.0) + F.when(p <= 0.01, 0.3).when(p <= 0.05, 0.2).when(p <= 0.1, 0.1).otherwise(0.0) + 0.2 * strength
    return F.least(F.lit(1.0), score)


def data_support(n: Column, p: Column, strength: Column, consistency: Column) -> Column:
    score = 0.3 + 0.3 * strength + F.when(p < 0.01, 0.2).when(p < 0.05, 0.15).when(p < 0.1, 0.1).otherwise(0.0) + F.when(n >= 20, 0.1).when(n >= 10, 0.05).otherwise(0.0) + 0.1 * consistency
    return F.least(F.lit(1.0), score)


def missing_synthesis(topics: DataFrame, by: str, least: int = 3) -> DataFrame:
    """(by, n, severity, gain, priority): topics with many notes; priority is 0.4 severity + 0.4 gain + 0.2 confidence (0.7)."""
    out = topics.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    severity, gain = F.least(F.lit(0.9), 0.4 + 0.05 * F.col("n")), F.least(F.lit(1.0), F.col("n") / 10)
    return out.select(by, "n", severity.alias("severity"), gain.alias("gain"), (0.4 * severity + 0.4 * gain + 0.2 * 0.7).alias("priority"))


def type_preferences(feedback: DataFrame, by: str, rating: str) -> DataFrame:
    """(by, n, preference): the mean of ratings (valuable 1, dismiss -0.5, wrong -1, others 0)."""
    value = F.when(F.col(rating) == "valuable", 1.0).when(F.col(rating) == "dismiss", -0.5).when(F.col(rating) == "wrong", -1.0).otherwise(0.0)
    return feedback.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("preference"))


def unconsented(requests: DataFrame, by: str, active: str = "active") -> DataFrame:
    """(by, hour, n, first): hours since the epoch in which a key made requests (id, t in microseconds) without consent, one alert an hour."""
    rows = requests.where(~F.col(active)).withColumn("hour", F.floor(F.col("t") / 3_600_000_000))
    return rows.groupBy(by, "hour").agg(F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("f")).select(by, "hour", "n", F.col("f.id").alias("first"))
