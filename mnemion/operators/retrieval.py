"""Vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemion.functions import vectors as v
from mnemion.sources.staging import stage

if TYPE_CHECKING:
    import pandas as pd

VECTORS, QUERIES = 4096, 256  # in a block
CELLS = 1024  # twice as many at most
AT_ONCE = 1 << 23  # numbers in a table of distances, and rows of visits times their length
SLACK = 1e-6  # of distances, for rounded scores


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest other rows of (id, v), exactly. queries is (query_id, qv).

    Scores are compared to 12 places, ties go to the smaller id. Vectors are of one length and without nulls; a score that
    isn't defined is left out. Beyond VECTORS rows, vectors are dealt into cells around a bounded sample of them. A query
    searches its own cell, and then those only that may hold a nearer vector than its k-th there: by the triangle inequality
    none is nearer than the distance to the cell's centre less the cell's radius (distances of unit vectors for cosines). On
    vectors that cluster that is a few cells, on ones in all directions it is most.
    """
    n = vectors.count()
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv"))
    if n <= VECTORS:
        best = _searched(rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), {0: n}, k, metric)
    else:
        best = _by_cells(rows, asked, n, k, metric)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    with np.errstate(all="ignore"):
        if metric == "cosine":
            score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
        else:
            score = 1 / (1 + np.stack([np.linalg.norm(x - y, axis=1) for y in q]))
    return np.round(score, 12)


def _searched(rows: DataFrame, visits: DataFrame, sizes: Mapping[int, int], k: int, metric: str) -> DataFrame:
    """(query_id, id, score): the k best of each block of a cell for each query (query_id, qv, cell) that visits it.

    Blocks of a cell's vectors meet blocks of its queries, each pair in a task of its own. sizes has the rows of each cell.
    """
    asked = dict(visits.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row a cell
    spark = rows.sparkSession
    cells = spark.createDataFrame([(c, -(-max(1, m) // VECTORS), -(-asked[c] // QUERIES)) for c, m in sizes.items() if c in asked] or [(-1, 1, 1)], "cell int, n_v int, n_q int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    left = rows.join(F.broadcast(cells), "cell").select("cell", "id", "v", block("id", "n_v").alias("vb"), every("n_q").alias("qb"))
    right = visits.join(F.broadcast(cells), "cell").select("cell", "query_id", "qv", block("query_id", "n_q").alias("qb"), every("n_v").alias("vb"))

    def run(mine: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # in the tasks only

        if not len(mine) or not len(wanted):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, q = np.stack(mine["v"].to_numpy()), np.stack(wanted["qv"].to_numpy())
        ids, names = mine["id"].to_numpy(), wanted["query_id"].to_numpy()
        score = _scores(x, q, metric)
        score[(ids == names[:, None]) | ~np.isfinite(score)] = -np.inf
        out = []
        for i, name in enumerate(names):
            order = np.lexsort((ids, -score[i]))[:k]
            order = order[score[i][order] > -np.inf]
            out.append(pd.DataFrame({"query_id": name, "id": ids[order], "score": score[i][order]}))
        return pd.concat(out)

    key = ("cell", "vb", "qb")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, id long, score double")


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors where distances order as scores do; not-numbers where there is no direction."""
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _by_cells(rows: DataFrame, asked: DataFrame, n: int, k: int, metric: str) -> DataFrame:
    wanted = min(CELLS, -(-n // VECTORS) * 4)
    share = int(min(1.0, wanted / n) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) <= share).limit(2 * wanted).select("v").collect() or rows.limit(1).select("v").collect()
    centres = _placed(np.array([r.v for r in some], float), metric)
    centres = centres[np.isfinite(centres).all(1)]
    if not len(centres):
        centres = np.zeros((1, len(some[0].v)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            x = _placed(np.stack(b["v"].to_numpy()), metric)
            cell = np.zeros(len(x), np.int64)
            for lo in range(0, len(x), step := max(1, AT_ONCE // len(centres))):
                d = _distances(x[lo : lo + step], centres)
                d[~np.isfinite(d)] = np.inf
                cell[lo : lo + step] = d.argmin(1)
            # The sum of squares loses the last places of small distances, so the radius is measured again.
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": cell.astype(np.int32), "r": np.linalg.norm(x - centres[cell], axis=1)})

    dealt = stage(rows.mapInPandas(deal, "id long, v array<double>, cell int, r double"), "cells")
    found = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.when(~F.isnan("r"), F.col("r"))).alias("r")).collect()  # a row a cell
    sizes, radius = {r.cell: r.n for r in found}, {r.cell: r.r for r in found}
    numbers = np.array(sorted(sizes), np.int32)
    counts, radii = np.array([sizes[c] for c in numbers]), np.array([radius[c] if radius[c] is not None else 0.0 for c in numbers])

    def home(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the cells' centres, and the nearest cell that has k other rows (-1 if none)."""
        x, near = _placed(q, metric), centres[numbers]
        d = np.stack([np.linalg.norm(y - near, axis=1) for y in x])
        full = np.where(counts > k, d, np.inf)
        return d, np.where(np.isfinite(full).any(1), full.argmin(1), -1)

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches of so few queries that a row for each of their cells stays small."""
        for b in batches:
            for lo in range(0, len(b), step := max(1, AT_ONCE // (len(numbers) * len(b["qv"].iloc[0])))) if len(b) else ():
                yield b.iloc[lo : lo + step]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in few(batches):
            if len(b):
                at = home(np.stack(b["qv"].to_numpy()))[1]
                yield pd.DataFrame({"query_id": b["query_id"], "qv": b["qv"], "cell": np.where(at >= 0, numbers[at], -1).astype(np.int32)})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in few(batches):
            d, at = home(np.stack(b["qv"].to_numpy()))
            worst = b["worst"].to_numpy(float)  # the k-th score at home; none if there are fewer
            reach = np.sqrt(np.maximum(2 - 2 * worst, 0)) if metric == "cosine" else 1 / worst - 1
            reach = np.where(np.isfinite(reach), reach, np.inf) + SLACK
            may = ~(d - radii > reach[:, None])  # where there is no distance, all
            may[np.arange(len(b))[at >= 0], at[at >= 0]] = False
            i, c = np.nonzero(may)
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[i], "qv": b["qv"].to_numpy()[i], "cell": numbers[c]})

    kind = "query_id long, qv array<double>, cell int"
    near = stage(_searched(dealt.select("id", "v", "cell"), stage(asked.mapInPandas(first, kind), "homes"), sizes, k, metric), "near")
    worst = near.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), k, 1).alias("s")).select("query_id", F.get("s", F.lit(0)).alias("worst"))
    visits = stage(asked.join(worst, "query_id", "left").mapInPandas(rest, kind), "visits")
    return near.unionByName(_searched(dealt.select("id", "v", "cell"), visits, sizes, k, metric))


def weighted_fusion(vector: DataFrame, graph: DataFrame, vector_weight: float, graph_weight: float) -> DataFrame:
    """(id, score, source): best score of each id on either side (id, score), weighted; 0 where it is missing. Two zero weights count as halves."""
    total = vector_weight + graph_weight
    wv, wg = (vector_weight / total, graph_weight / total) if total > 0 else (0.5, 0.5)
    a = vector.groupBy("id").agg(F.max("score").alias("vs"))
    b = graph.groupBy("id").agg(F.max("score").alias("gs"))
    both = a.join(b, "id", "full_outer")
    source = F.when(F.col("gs").isNull(), "vector").when(F.col("vs").isNull(), "graph").otherwise("hybrid")
    return both.select("id", (F.coalesce("vs", F.lit(0.0)) * wv + F.coalesce("gs", F.lit(0.0)) * wg).alias("score"), source.alias("source"))


def rank_fusion(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over ranked lists (id, rank), where an id's first rank in a list counts."""
    parts = [df.groupBy("id").agg((1.0 / (k + F.min("rank"))).alias("s")) for df in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("s").alias("score"))


def adjusted_weights(intent: str, n_vector: int, n_graph: int, vector_weight: float = 0.5, graph_weight: float = 0.5) -> tuple[float, float]:
    """Weights by the query's intent and the number of results on either side, clamped and made to sum to 1."""
    dv, dg = {"temporal": (-0.1, 0.1), "causal": (-0.15, 0.15), "lookup": (0.1, -0.1)}.get(intent, (0.0, 0.0))
    a, b = vector_weight + dv, graph_weight + dg
    if n_vector < 5 and n_graph > 10:
        b += 0.1
    if n_graph < 5 and n_vector > 10:
        a += 0.1
    a, b = min(1.0, max(0.0, a)), min(1.0, max(0.0, b))
    return (a / (a + b), b / (a + b)) if a + b > 0 else (0.5, 0.5)


def intent(query: Column) -> Column:
    """Of a question in words: causal, temporal, lookup or exploratory."""
    q = F.lower(query)
    return F.when(q.rlike(r"\b(?:why|because|cause[sd]?|led to|effect)\b"), "causal").when(q.rlike(r"\b(?:when|before|after|during|between|last|yesterday|since)\b"), "temporal").when(q.rlike(r"\b(?:who|what is|where|find|show)\b"), "lookup").otherwise("exploratory")


def keyword_scores(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """docs with score: 0.5 + 0.5 * share of the terms that the text contains; those with none are left out."""
    hits = sum(F.contains(F.lower(F.col(text)), F.lit(t.lower())).cast("int") for t in terms)
    return docs.withColumn("hits", hits).where("hits > 0").withColumn("score", 0.5 + 0.5 * F.col("hits") / len(terms))


#: Hops, direction and edges that a question's intent expands seeds by; None follows all edges.
EXPANSION = {"causal": (3, "out", ("CAUSES", "ENABLES", "TRIGGERS")), "temporal": (1, "both", None), "lookup": (1, "both", None), "exploratory": (2, "both", None)}


def hybrid_search(vectors: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 10, seeds: int = 10, fade: float = 0.5) -> DataFrame:
    """(query_id, id, rank, score, source, via): each question's k best entities by vectors and graph together.

    questions is (query_id, qv, intent); vectors (id, v); edges (src, dst, rel, confidence). The 2k nearest vectors are the
    one side; their `seeds` best are expanded along edges as the intent says, a path's score being its seed's times its edges'
    confidences times `fade` a hop. Weights follow the intent and the sizes of both sides; `via` is the seed of the best path.
    """
    found = stage(nearest(vectors, questions.select("query_id", "qv"), 2 * k).select("query_id", "id", F.col("score").alias("vs"), "rank"), "nearest")
    asked = questions.select("query_id", "intent")
    at = found.where(F.col("rank") <= seeds).join(asked, "query_id").select("query_id", "intent", F.col("id").alias("seed"), F.col("id").alias("node"), F.col("vs").alias("gs"))
    edges = edges.select("src", "dst", "rel", F.coalesce("confidence", F.lit(1.0)).alias("c")).where("src != dst")
    both = edges.select("src", "dst", "rel", "c", F.lit("out").alias("way")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "c", F.lit("in").alias("way")))
    reached = None
    for hop in range(1, max(h for h, _, _ in EXPANSION.values()) + 1):
        may = F.lit(False)
        for name, (hops, way, rels) in EXPANSION.items():
            if hop <= hops:
                allowed = F.lit(True) if rels is None else F.col("rel").isin(list(rels))
                may = may | ((F.col("intent") == name) & allowed & (F.lit(True) if way == "both" else F.col("way") == way))
        step = at.join(both, at["node"] == both["src"]).where(may).select("query_id", "intent", "seed", F.col("dst").alias("node"), (F.col("gs") * F.col("c") * fade).alias("gs"))
        # The best path to each node is enough to go on from.
        best = F.max(F.struct("gs", (-F.col("seed")).alias("less"))).alias("b")
        at = stage(step.groupBy("query_id", "intent", "node").agg(best).select("query_id", "intent", (-F.col("b.less")).alias("seed"), "node", F.col("b.gs").alias("gs")), "reached")
        reached = at if reached is None else reached.unionByName(at)
    graph = reached.groupBy("query_id", F.col("node").alias("id")).agg(F.max(F.struct("gs", (-F.col("seed")).alias("less"))).alias("b")).select("query_id", "id", F.col("b.gs").alias("gs"), (-F.col("b.less")).alias("via"))
    sizes = found.groupBy("query_id").agg(F.count("*").alias("nv")).join(graph.groupBy("query_id").agg(F.count("*").alias("ng")), "query_id", "full_outer").fillna(0, ["nv", "ng"])
    weights = asked.join(sizes, "query_id").select("query_id", *fusion_weights(F.col("intent"), F.col("nv"), F.col("ng")))
    fused = found.drop("rank").join(graph, ["query_id", "id"], "full_outer").join(weights, "query_id")
    score = F.coalesce("vs", F.lit(0.0)) * F.col("wv") + F.coalesce("gs", F.lit(0.0)) * F.col("wg")
    source = F.when(F.col("gs").isNull(), "vector").when(F.col("vs").isNull(), "graph").otherwise("hybrid")
    out = fused.select("query_id", "id", F.round(score, 9).alias("score"), source.alias("source"), "via")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def fusion_weights(intent: Column, n_vector: Column, n_graph: Column, vector: float = 0.5, graph: float = 0.5) -> tuple[Column, Column]:
    """adjusted_weights for each question: (wv, wg)."""
    turn = F.when(intent == "temporal", -0.1).when(intent == "causal", -0.15).when(intent == "lookup", 0.1).otherwise(0.0)
    a = vector + turn + F.when((n_graph < 5) & (n_vector > 10), 0.1).otherwise(0.0)
    b = graph - turn + F.when((n_vector < 5) & (n_graph > 10), 0.1).otherwise(0.0)
    a, b = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in (a, b))
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5).alias("wv"), F.when(a + b > 0, b / (a + b)).otherwise(0.5).alias("wg")


def compatible(rows: DataFrame, current: int, version: str = "schema_version", score: str = "score") -> DataFrame:
    """rows with a score lowered by their schema's age; more than three versions behind is left out."""
    diff = F.lit(current) - F.col(version)
    factor = F.when(diff <= 0, 1.0).when(diff == 1, 0.95).when(diff <= 3, 0.85)
    return rows.withColumn("factor", factor).where("factor is not null").withColumn(score, F.col(score) * F.col("factor")).drop("factor")


def minmax(rows: DataFrame, by: str, score: str = "score") -> DataFrame:
    """rows with `norm`: the score between a group's least and largest; 1 where they are equal."""
    w = W.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("norm", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def distinct_by_signature(rows: DataFrame, text: str = "text", score: str = "score", key: str = "id", length: int = 200) -> DataFrame:
    """Of rows whose lower-cased first `length` characters agree, the one with the best score; the smaller key of equals."""
    signature = F.lower(F.substring(F.col(text), 1, length))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k")))
    keep = rows.groupBy(F.md5(signature.cast("binary")).alias("sig")).agg(best.alias("b")).select((-F.col("b.k")).alias(key))
    return rows.join(keep, key, "left_semi")


def balanced(rows: DataFrame, k: int, by: str, dominance: float = 0.7, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows, of which one modality has at most int(k * dominance) as long as others can fill up."""
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))
    # Beyond k of its own modality a row can't be chosen.
    capped = rows.withColumn("__r", r).where(F.col("__r") <= k)
    return capped.orderBy((F.col("__r") > int(k * dominance)).cast("int"), F.desc(score), key).limit(k).drop("__r")


#: The base boost of each way a text came about.
BOOSTS = {"native": 1.0, "ocr_document": 0.9, "ocr_image": 0.85, "audio": 0.85, "video": 0.8, "mixed": 0.75}


def retrieval_boost(kind: Column, confidence: Column) -> Column:
    base = F.lit(0.7)
    for k, b in BOOSTS.items():
        base = F.when(kind == k, b).otherwise(base)
    return base * (0.5 + 0.5 * confidence)


def centroid(vectors: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """(by, v): the (weighted) mean vector of each group: one partial aggregate a component."""
    w = weight if weight is not None else F.lit(1.0)
    parts = vectors.select(by, w.alias("w"), F.posexplode("v").alias("i", "x"))
    means = parts.groupBy(by, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select(by, F.col("c.m").alias("v"))


def quality(c: Column) -> Column:
    """Coherence of a vector: the mean of scores for its norm, its finiteness and its spread."""
    n = v.norm(c)
    norm = F.when(F.abs(n - 1) < 0.01, 1.0).when(F.abs(n - 1) < 0.1, 0.8).when(n > 0, 0.5).otherwise(0.0)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)).cast("double")
    mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    std = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(c))
    spread = F.when(std < 0.001, 0.0).when(std < 0.01, 0.3).when(std < 0.1, 0.7).otherwise(F.least(F.lit(1.0), 5 * std))
    return (norm + finite + spread) / 3


def diverse(rows: DataFrame, k: int, trade: float = 0.2, by: str = "query_id") -> DataFrame:
    """(by, id, place): maximal marginal relevance within each group's candidates (id, score, v), which are few (a top-k)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        left, most, chosen = list(range(len(pdf))), np.zeros(len(pdf)), []
        while left and len(chosen) < k:
            i = max(left, key=lambda j: ((1 - trade) * pdf["score"][j] - trade * most[j], -j))
            chosen.append(i)
            left.remove(i)
            most = np.maximum(most, x @ x[i])
        return pd.DataFrame({by: pdf[by].iloc[0], "id": pdf["id"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return rows.groupBy(by).applyInPandas(run, f"{by} long, id long, place long")


def strategy(costs: Mapping[str, tuple[float, float, float, float]], cached_share: float = 0.3, most_latency: float = 1000.0, least_accuracy: float = 0.7) -> str:
    """The cheapest of strategies (latency, resources, cache, accuracy) that is fast and accurate enough, else the fastest."""
    def total(x: tuple[float, float, float, float]) -> float:
        latency, resources, cache, accuracy = x
        return 0.4 * latency * (1 - 0.8 * cached_share) + 20 * resources * (1 - 0.5 * cached_share) + 20 * (1 - cache) + 20 * (1 - accuracy)

    able = {k: x for k, x in costs.items() if x[0] <= most_latency and x[3] >= least_accuracy}
    return min(able, key=lambda k: total(able[k])) if able else min(costs, key=lambda k: costs[k][0])
