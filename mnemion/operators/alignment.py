"""Schemas found in data: profiles of kinds, their similarity and one-to-one alignment, and agreement of two schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.sources.staging import discard, stage

#: What each figure weighs in the agreement of two schemas, and the agreement that passes.
WEIGHTS = {"entity_coverage": 0.30, "relationship_coverage": 0.30, "entity_matches": 0.10, "relationship_matches": 0.10, "property_alignment": 0.10, "temporal_correctness": 0.05, "causal_correctness": 0.05}
PASSES = 0.90


def profiles(rows: DataFrame, kind: str, **features: Column) -> DataFrame:
    """(kind, family, feature, share): of each kind how its rows are spread over the features of a family.

    features: by family a column, an attribute's value or a neighbour's kind. Nulls are no feature; rows without a kind are left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), c.cast("string").alias("feature")) for f, c in features.items()]))
    counts = rows.where(F.col(kind).isNotNull()).select(F.col(kind).alias("kind"), each.alias("f")).select("kind", "f.family", "f.feature").where("feature IS NOT NULL")
    counts = counts.groupBy("kind", "family", "feature").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind", "family").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["kind", "family"]).select("kind", "family", "feature", (F.col("n") / F.col("total")).alias("share"))


def kind_similarity(found: DataFrame, reference: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(found, reference, score) of kinds that share a feature: the weighted mean over families of what their profiles have in common.

    Rows meet by feature, at most kinds times kinds a feature; profiles are no larger than the schema, whatever the data.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w / sum(weights.values()))]), F.col("family"))
    a = found.where(F.col("family").isin(*weights)).select("family", "feature", F.col("kind").alias("found"), F.col("share").alias("a"))
    b = reference.select("family", "feature", F.col("kind").alias("reference"), F.col("share").alias("b"))
    return a.join(b, ["family", "feature"]).groupBy("found", "reference").agg(F.round(F.sum(weight * F.least("a", "b")), 9).alias("score"))


def aligned(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(found, reference, score): each kind in one pair at most, best scores first, ties to smaller names.

    Pairs that are best for both their kinds are taken round after round, which gives what one pass in the order of scores would.
    """
    left = stage(pairs.where(F.col("score") >= least).select("found", "reference", "score"), "pairs")
    held: list[DataFrame] = []
    while True:
        best = [left.groupBy(k).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(o).alias("o"))).alias("m")).select(F.col(k), F.col("m.o").alias(o)) for k, o in (("found", "reference"), ("reference", "found"))]
        now = stage(left.join(best[0], ["found", "reference"]).join(best[1], ["found", "reference"]), "aligned")
        if now.isEmpty():
            discard(left)
            return reduce(DataFrame.unionByName, held) if held else now
        held.append(now)
        rest = stage(left.join(now.select("found"), "found", "left_anti").join(now.select("reference"), "reference", "left_anti").select("found", "reference", "score"), "pairs")
        discard(left)
        left = rest


def schema_agreement(found: DataFrame, reference: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """One row: how far the schema `found` covers `reference`, by part, with the weighted agreement and whether it passes.

    Schemas are (part, owner, name, temporal, causal): part 'entity' (owner ''), 'property' or 'relationship' (owner an entity).
    renamed: (found, reference) names of entities, as `aligned` gives; they count as matches, not as coverage. A part that
    the reference lacks counts as covered, one that the found schema lacks as precise.
    """
    key = ["part", "owner", "name"]
    a = found.groupBy(*key).agg(F.max("temporal").alias("ft"), F.max("causal").alias("fc"), F.lit(True).alias("f"))
    b = reference.groupBy(*key).agg(F.max("temporal").alias("rt"), F.max("causal").alias("rc"), F.lit(True).alias("r"))
    both = a.join(b, key, "full_outer")
    share = lambda what, of: F.coalesce(F.count(F.when(of & what, 1)) / F.nullif(F.count(F.when(of, 1)), F.lit(0)), F.lit(1.0))
    f, r, part = F.col("f").isNotNull(), F.col("r").isNotNull(), F.col("part")
    entity, relation = part == "entity", part == "relationship"
    flags = both.agg(
        share(f, entity & r).alias("entity_coverage"), share(r, entity & f).alias("entity_exact"), share(f, relation & r).alias("relationship_coverage"), share(r, relation & f).alias("relationship_exact"),
        share(F.col("ft"), relation & f & F.col("rt")).alias("temporal_correctness"), share(F.col("fc"), relation & f & F.col("rc")).alias("causal_correctness"),
    )
    common = both.where(entity & f & r).select(F.col("name").alias("owner"))
    covered = both.where((part == "property") & r).groupBy("owner").agg((F.count("f") / F.count("*")).alias("share")).join(common, "owner", "left_semi")
    properties = covered.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("property_alignment"))
    if renamed is None:
        matches = both
    else:
        to = renamed.groupBy(F.col("found").alias("was")).agg(F.min("reference").alias("now"))
        named = a.withColumn("was", F.when(entity, F.col("name")).otherwise(F.col("owner"))).join(to, "was", "left")
        now = F.coalesce("now", "was")
        named = named.select("part", F.when(entity, F.col("owner")).otherwise(now).alias("owner"), F.when(entity, now).otherwise(F.col("name")).alias("name"), "f")
        matches = a.select(*key, "f").unionByName(named).distinct().join(b, key, "right")
    matches = matches.agg(share(f, entity & r).alias("entity_matches"), share(f, relation & r).alias("relationship_matches"))
    out = flags.join(properties).join(matches)  # one row each
    agreement = sum(F.col(c) * w for c, w in WEIGHTS.items())
    precise = [F.greatest(f"{p}_exact", f"{p}_matches").alias(f"{p}_precision") for p in ("entity", "relationship")]
    return out.select(*[F.round(c, 9).alias(c) for c in WEIGHTS], *precise, F.round(agreement, 4).alias("agreement"), (agreement >= PASSES).alias("passes"))


def edge_outcomes(edges: DataFrame, sources: DataFrame, targets: DataFrame, old: DataFrame) -> DataFrame:
    """(src, dst, rel, n, outcome) of relationships to be created together; n: how often each was asked for.

    outcome: 'missing_source', 'missing_target', 'exists' or 'created', in this order of precedence. sources and targets hold
    `id`; old has src, dst, rel. A null end is missing.
    """
    asked = edges.groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))
    have = lambda ids, c, flag: ids.where("id IS NOT NULL").select(F.col("id").alias(c)).distinct().withColumn(flag, F.lit(True))
    known = old.select("src", "dst", "rel").distinct().withColumn("__old", F.lit(True))
    rows = asked.join(have(sources, "src", "__src"), "src", "left").join(have(targets, "dst", "__dst"), "dst", "left").join(known, ["src", "dst", "rel"], "left")
    outcome = F.when(F.col("__src").isNull(), "missing_source").when(F.col("__dst").isNull(), "missing_target").when(F.col("__old"), "exists").otherwise("created")
    return rows.select("src", "dst", "rel", "n", outcome.alias("outcome"))


def set_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, shared, only_left, only_right, jaccard) of sets given as (key, item) rows; null items are none."""
    a, b = (x.where("item IS NOT NULL").select("key", "item").distinct().withColumn(c, F.lit(1)) for x, c in ((left, "a"), (right, "b")))
    n = a.join(b, ["key", "item"], "full_outer").groupBy("key").agg(F.count(F.col("a") + F.col("b")).alias("shared"), F.count("a").alias("a"), F.count("b").alias("b"))
    return n.select("key", "shared", (F.col("a") - F.col("shared")).alias("only_left"), (F.col("b") - F.col("shared")).alias("only_right"), (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))
