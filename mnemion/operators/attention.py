"""Retrieval over a graph that depends on the question: attention along edges, and documents within some hops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.functions.vectors import cosine, dot, doubles, unit
from mnemion.sources.staging import discard, stage

LISTED = 4096  # edges of a node in a row
TARGETS = SOURCES = 4096  # of a question that meet in one group
AT_ONCE = 256  # sources whose messages are made at once


def attention(queries: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, rounds: int = 2, width: int | None = None) -> DataFrame:
    """(query, id, vector, score): node vectors after rounds of messages that the question weighs; score is the cosine with it.

    queries (query, vector), seeds (query, id), edges (src, dst, optionally bias), nodes (id, vector). A question's nodes are
    its seeds and, each round, what their edges lead to. A node reached takes the mean of its own vector and its messages:
    the vectors of the sources of its edges, weighted by the softmax over these edges of (v_dst + q).(v_src + q) / sqrt(width)
    + bias. All vectors are made of unit length first, so exponentials stay small, and a softmax is one pass of sums.

    A source goes out once with lists of what its edges lead to, not once an edge: about TARGETS targets of a question meet
    about SOURCES of its sources in one group, and the sums of a target are combined over groups, so a node with very many
    edges is no large group anywhere.
    """
    q = queries.select("query", unit(doubles("vector")).alias("q"))
    own = stage(nodes.select("id", unit(doubles("vector")).alias("v")).where("v is not null").withColumn("m", F.monotonically_increasing_id()), "vectors")
    size = len(own.first().v)
    d = width or size
    biased = ["bias"] if "bias" in edges.columns else []
    # Edges at a node without a vector carry nothing.
    links = edges.select("src", "dst", *[F.col(c).cast("double").alias(c) for c in biased]).join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst"), "m"), "dst")
    cuts = links.groupBy("src").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("cuts")).where("cuts > 1")
    cut = F.pmod(F.xxhash64("m"), F.coalesce("cuts", F.lit(1)))
    links = links.join(cuts, "src", "left").groupBy("src", cut.alias("cut")).agg(F.collect_list(F.struct("m", *biased)).alias("near"))
    links = stage(links.select("src", *[F.col(f"near.{c}").alias(c) for c in ("m", *biased)]), "links")
    # Of each node beside its vector its product with the question: (dst + q).(src + q) needs no more of the question.
    against = lambda df: df.join(q, "query").select("query", "id", "v", dot(F.col("v"), F.col("q")).alias("vq"), dot(F.col("q"), F.col("q")).alias("qq"), *[c for c in df.columns if c == "m"])
    kinds = [f.dataType.simpleString() for f in (queries.schema["query"], own.schema["id"])]
    at = stage(against(seeds.select("query", "id").distinct().join(own.drop("m"), "id")), "attention")
    for _ in range(rounds):
        ways = at.select("query", F.col("id").alias("src")).join(links.select("src", "m"), "src")
        met = stage(ways.select("query", F.explode("m").alias("m")).distinct().join(own.select("m", "id"), "m"), "met")
        groups = met.groupBy("query").agg(F.ceil(F.count("*") / TARGETS).cast("int").alias("chunks")).join(at.groupBy("query").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("parts")), "query")
        groups = stage(groups, "groups")
        old = at.select("query", "id", F.col("v").alias("now"))
        held = against(met.join(own.drop("m"), "id").join(old, ["query", "id"], "left").withColumn("v", F.coalesce("now", "v")))
        chunk = lambda m: F.pmod(F.xxhash64(m), F.col("chunks")).cast("int")
        targets = held.join(groups, "query").select(*held.columns, chunk(F.col("m")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sent = at.select("query", F.col("id").alias("src"), "v", "vq").join(links, "src").join(groups, "query").withColumn("part", F.pmod(F.xxhash64("src"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        near = F.filter(F.arrays_zip("m", *biased), lambda x: chunk(x["m"]) == F.col("chunk"))
        sent = sent.withColumn("near", F.when(F.col("chunks") > 1, near)).select("query", "chunk", "part", "v", "vq", *[F.coalesce(F.col(f"near.{c}"), F.col(c)).alias(c) for c in ("m", *biased)])
        key = ("query", "chunk", "part")
        parts = targets.groupBy(*key).cogroup(sent.where("size(m) > 0").groupBy(*key)).applyInArrow(_messages(d), f"query {kinds[0]}, id {kinds[1]}, v array<double>, e double, s array<double>")
        sums = parts.groupBy("query", "id").agg(F.sum("e").alias("e"), F.any_value("v").alias("v"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size)])
        mixed = sums.select("query", "id", unit(F.zip_with("v", F.array(*[F.col(f"s{i}") / F.col("e") for i in range(size)]), lambda a, b: (a + b) / 2)).alias("v"))
        kept = at.join(met, ["query", "id"], "left_anti")
        last, at = at, stage(against(mixed).unionByName(kept), "attention")
        discard(last, met, groups)
    discard(links, own)
    return at.join(q, "query").select("query", "id", F.col("v").alias("vector"), F.col("vq").alias("score"))


def _messages(d: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of targets (query, id, v, vq, qq, m) and sources (v, vq, m, the targets of their edges, perhaps their bias) of a question the weights and weighted vectors summed by target."""
    kinds = ("query", "id", "v")

    def run(targets: pa.Table, sources: pa.Table) -> pa.Table:
        numbers = targets["m"].to_numpy()
        order = np.argsort(numbers)
        mine, base = _matrix(targets["v"]), targets["vq"].to_numpy() + targets["qq"].to_numpy()
        e, sums = np.zeros(len(mine)), np.zeros(mine.shape)
        for start in range(0, sources.num_rows if len(mine) else 0, AT_ONCE):
            b = sources.slice(start, AT_ONCE).combine_chunks()
            theirs = _matrix(b["v"])
            i = np.repeat(np.arange(len(theirs)), pc.list_value_length(b["m"]).to_numpy())
            j = order[np.searchsorted(numbers, pc.list_flatten(b["m"]).to_numpy(), sorter=order)]
            touched = np.zeros(len(mine), bool)
            touched[j] = True
            rows = np.flatnonzero(touched)
            k = (np.cumsum(touched) - 1)[j]
            logits = ((mine[rows] @ theirs.T)[k, i] + base[j] + b["vq"].to_numpy()[i]) / d**0.5
            if "bias" in b.column_names:
                logits += pc.list_flatten(b["bias"]).to_numpy()
            weights = np.bincount(k * len(theirs) + i, np.exp(logits), len(rows) * len(theirs)).reshape(len(rows), -1)
            e[rows] += weights.sum(1)
            sums[rows] += weights @ theirs
        at = np.flatnonzero(e)
        lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * sums.shape[1], sums[at].ravel())
        return targets.select(kinds).take(at).append_column("e", pa.array(e[at])).append_column("s", lists)

    return run


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(vectors).to_numpy(), float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def multi_hop(queries: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, documents: DataFrame, hops: int = 3, decay: float = 0.7, least: float = 0.3) -> DataFrame:
    """(query, doc, score): the documents (id, doc) of the nodes within fewer than `hops` steps of a question's seeds, best score first come.

    A node is visited once a question, at its least distance; its score is its cosine with the question (0.5 without a
    vector) times decay for each step, and a document has that of its best node, if it is at least `least`. A frontier holds
    new nodes only, by question. Edges are followed both ways.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    both = stage(both, "both-ways")
    at = stage(seeds.select("query", "id").distinct().withColumn("hop", F.lit(0)), "hop")
    seen = at
    for hop in range(1, hops):
        step = at.select("query", F.col("id").alias("src")).join(both, "src").select("query", F.col("dst").alias("id")).distinct()
        at = stage(step.join(seen, ["query", "id"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(at)
    q = queries.select("query", doubles("vector").alias("q"))
    scored = seen.join(nodes.select("id", doubles("vector").alias("v")), "id", "left").join(q, "query")
    score = F.when(F.col("v").isNull(), F.lit(0.5)).otherwise(cosine(F.col("q"), F.col("v"))) * F.pow(F.lit(decay), F.col("hop"))
    found = scored.select("query", "id", score.alias("score")).where(F.col("score") >= least)
    return found.join(documents.select("id", "doc"), "id").groupBy("query", "doc").agg(F.max("score").alias("score"))
