"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def n_lines(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


def words(c: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def subject(c: Column) -> Column:
    """A subject line without its reply and forward marks."""
    return F.trim(F.regexp_replace(c, r"^(?:\s*(?:Re|RE|re|Fwd|FWD|fwd)(?:\[[0-9]+\])?:)+\s*", ""))


def chunks(c: Column, size: int) -> Column:
    """Windows of `size` characters; none of an empty text."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size)), lambda at: F.substring(c, at, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(c: Column, size: int) -> Column:
    """Paragraphs (split at blank lines) packed greedily up to `size` characters, not counting the joints."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(p) > size)
        done = F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        held = F.when(full | (acc["n"] == 0), p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), held.alias("held"), F.when(full, F.length(p)).otherwise(acc["n"] + F.length(p)).alias("n"))

    return F.aggregate(parts, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]))
