"""Names of several words in texts, and causal relations between events that one sentence names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.functions.text import words

#: What points to a cause, what does so strongly, and the words that tell the kind of relation, the first that fits.
INDICATORS = (
    "caused", "causes", "cause of", "led to", "leads to", "leading to", "resulted in", "results in", "resulting in", "triggered", "triggers", "trigger", "enabled", "enables", "enable", "allowed", "allows", "allow",
    "prevented", "prevents", "prevent", "blocked", "blocks", "block", "contributed to", "contributes to", "contributing to", "consequence of", "consequences of", "because of", "due to", "owing to",
    "influenced", "influences", "influence", "affected", "affects", "affect",
)
STRONG = ("caused", "led to", "resulted in", "triggered")
KINDS = (("CAUSES", ("caused", "cause")), ("TRIGGERS", ("triggered", "trigger")), ("ENABLES", ("enabled", "enable", "allowed", "allow")), ("PREVENTS", ("prevented", "prevent", "blocked", "block")), ("CONTRIBUTES_TO", ("contributed", "contribute")), ("LEADS_TO", ("led to", "resulted in")))


DEALT = 50_000  # texts of a task


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Does the lower-cased text hold one of the phrases, as a run of characters?"""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def phrase_mentions(texts: DataFrame, names: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, name, at, length): where texts (id, text) have a name (name) as whole words, in any case; at counts words from 1.

    Names are known by their words: a text's runs of as many words as any name has are joined with them by equality, so no
    text meets a name that it doesn't have. There are as many lengths as names have, a few. Texts are dealt out by id first:
    runs are many times the texts, which may lie in one file.
    """
    keys = names.where("name is not null").select("name", words(F.col("name")).alias("w")).where("size(w) > 0").distinct()
    keys = keys.select("name", F.size("w").alias("length"), F.array_join("w", " ").alias("phrase"))
    lengths = sorted(r[0] for r in keys.select("length").distinct().collect())
    n = 1 + texts.count() // DEALT
    rows = texts.select(id_col, "text").repartition(n, id_col).select(id_col, words(F.col("text")).alias("w"))
    if not lengths:
        return rows.select(id_col, F.lit("").alias("name"), F.lit(1).alias("at"), F.lit(1).alias("length")).limit(0)
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("phrase"), F.lit(n).alias("length"))))
    every = rows.select(id_col, F.explode(F.flatten(F.array_compact(F.array(*[runs(n) for n in lengths])))).alias("run")).select(id_col, "run.*")
    return every.join(keys, ["phrase", "length"]).select(id_col, "name", "at", "length")


def sentences(texts: DataFrame, id_col: str = "id", ends: str = r"\.") -> DataFrame:
    """(id, sentence, text): the parts of texts between full stops, trimmed, that aren't empty; numbered from 0."""
    parts = F.posexplode(F.split("text", ends)).alias("sentence", "part")
    return texts.select(id_col, parts).select(id_col, "sentence", F.trim("part").alias("text")).where("text != ''")


def causal_candidates(texts: DataFrame, events: DataFrame, least: float = 0.6, most_days: float = 365.0) -> DataFrame:
    """(id, cause, effect, relation, evidence, confidence) of events (id, name, t in microseconds) that texts (id, text) name.

    Only sentences with an indicator are searched. A pair is two events of the text that one of its sentences names, the
    cause earlier than the effect by at most most_days; its evidence is the first such sentence. Pairs are made within a
    sentence, so their number follows the names in it and not those of the text.
    """
    told = sentences(texts).withColumn("lower", F.lower("text"))
    told = told.where(holds(F.col("lower"), INDICATORS)).withColumn("place", F.struct("id", "sentence"))
    named = phrase_mentions(told.select("place", "text"), events.select("name"), "place").select("place.id", "place.sentence", "name").distinct()
    timed = named.join(events.where("t is not null").select("id", "name", "t").distinct(), ["id", "name"])
    a = timed.select("id", "sentence", F.col("name").alias("cause"), F.col("t").alias("t_cause"))
    b = timed.select("id", "sentence", F.col("name").alias("effect"), F.col("t").alias("t_effect"))
    gap = F.col("t_effect") - F.col("t_cause")
    pairs = a.join(b, ["id", "sentence"]).where((gap > 0) & (gap <= int(most_days * 86_400_000_000)))
    first = pairs.groupBy("id", "cause", "effect").agg(F.min("sentence").alias("sentence"))
    found = first.join(told.select("id", "sentence", F.col("text").alias("evidence"), "lower"), ["id", "sentence"])
    kind = reduce(lambda c, k: c.when(holds(F.col("lower"), k[1]), k[0]), KINDS[1:], F.when(holds(F.col("lower"), KINDS[0][1]), KINDS[0][0])).otherwise("CAUSES")
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    both = F.contains("lower", F.lower("cause")) & F.contains("lower", F.lower("effect"))
    confidence = F.least(F.lit(1.0), 0.6 + add(holds(F.col("lower"), STRONG), 0.2) + add(F.length("evidence") > 50, 0.1) + add(both, 0.1))
    return found.select("id", "cause", "effect", kind.alias("relation"), "evidence", F.round(confidence, 9).alias("confidence")).where(F.col("confidence") >= least)
