"""Approximate nearest neighbours: an inverted file with product-quantised residuals, and exact reranking.

Coarse centroids (as many as the root of the rows) and, on the residuals, one codebook a subspace are fitted on a bounded
sample, on which the number of cells is chosen as well that queries must go to for the recall wanted: few where vectors
cluster, many where they don't. Every vector is normalised, assigned to its nearest centroid and encoded. A query first goes
to its nearest cell, which tells how near its k-th neighbour is at most, and then to its other cells. There a table of
distances from its residual to every codeword gives approximate distances to all codes by lookups, and only entries that can
still be among the nearest, being no nearer than their approximate distance less their own quantisation error, are
reranked on the original vectors in double precision. So the result is exact for the probed cells, also where many close
vectors share a code. Cells are cut in blocks of bounded size by a hash, so a popular cell is many tasks; equal vectors are
one entry that keeps its smallest ids, so copies neither crowd a cell nor a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import hashed_sample, salt, schema, stage

if TYPE_CHECKING:
    import pandas as pd

SAMPLE_ROWS = 20_000  # vectors that the index is fitted on, chosen by a hash of their id; fewer if they are wide:
SAMPLE_NUMBERS = 1 << 21  # components in the sample
CELLS = 4096  # coarse centroids at most
SUBSPACES = 32
CODES = 64  # codewords a subspace
RECALL = 0.95  # wanted on the sample
ASKED = 256  # sample vectors that are searched for, to choose the number of cells
RERANK = 32  # candidates of a block that are reranked at a time
SLACK = 1e-6  # above the rounding errors of distances between unit vectors
TIES = 1e-12  # above those of cosines
BLOCK = 4096  # entries of a cell in one task
QUERY_BLOCK = 1024  # queries that meet a block in one task


@dataclass(frozen=True)
class Index:
    """Fitted centroids (cells, dim) and codebooks (subspaces, codes, dim / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int  # cells that a query goes to

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(n, subspaces, width), padded with zeros."""
        m, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        parts = self.parts(residuals)
        codes = np.empty(parts.shape[:2], np.uint8)
        for j, book in enumerate(self.books):
            codes[:, j] = ((book**2).sum(1) - 2 * parts[:, j] @ book.T).argmin(1)
        return codes

    def errors(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each residual from what its code stands for."""
        return np.linalg.norm(self.parts(residuals) - self.books[np.arange(len(self.books)), codes], axis=(1, 2))

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """(n, subspaces, codes): squared distances of each part to each codeword."""
        parts = self.parts(residuals)
        return ((parts[:, :, None, :] - self.books[None]) ** 2).sum(-1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components are near 1: cosines are the same, and nothing overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, q: np.ndarray, approximate: np.ndarray, errors: np.ndarray, n: int, least: float = -np.inf) -> np.ndarray:
    """Of the unit vectors x the places of the n that are nearest to q, and of all that tie with the last.

    Those with a cosine below `least` needn't be found. RERANK at a time are compared exactly, by approximate distance less
    error, until no other can be as near.
    """
    reach = lambda c: np.sqrt(max(0.0, 2 - 2 * c)) + SLACK
    bounds = approximate - errors
    able = np.flatnonzero(bounds <= reach(least)) if least > -np.inf else np.arange(len(x))
    able = able[np.argsort(bounds[able], kind="stable")]
    cosines = np.full(len(able), -np.inf)
    for at in range(0, len(able), RERANK):
        part = able[at : at + RERANK]
        if bounds[part[0]] > reach(least):
            break
        cosines[at : at + RERANK] = x[part] @ q
        if at + len(part) >= n:
            least = max(least, np.partition(cosines[: at + RERANK], -n)[-n])
    return np.sort(able[cosines >= least - TIES])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        filled = n > 0
        centers[filled] = sums[filled] / n[filled, None]
        empty = np.flatnonzero(~filled)
        if len(empty):
            centers[empty] = distinct[rng.choice(len(distinct), len(empty))]
    return centers


def fit(vectors: DataFrame, rows: int = SAMPLE_ROWS, k: int = 5) -> Index | None:
    """An index fitted on about `rows` of the (id, v) rows, at most twice as many; None without rows."""
    head = vectors.select(F.size("v").alias("d")).first()
    if head is None:
        return None
    total = vectors.count()
    sample = [r.v for r in hashed_sample(vectors, "id", max(1, min(rows, SAMPLE_NUMBERS // head.d))).select("v").collect()]
    x = units(np.array(sample, np.float64)) if sample else units(np.array([vectors.first().v], np.float64))
    centroids = kmeans(x, max(1, min(CELLS, int(np.ceil(total**0.5)), int(2 * len(x) ** 0.5))))
    m = min(SUBSPACES, x.shape[1])
    width = -(-x.shape[1] // m)
    cell = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
    parts = np.pad(x - centroids[cell], ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)
    books = [kmeans(parts[:, j], CODES, seed=6 + j) for j in range(m)]
    books = [np.concatenate([b, np.full((CODES - len(b), width), 1e6)]) for b in books]  # unused codewords are far away
    # Of some vectors the nearest others, and how far down their cells are in the order of centroids.
    asked = np.random.default_rng(3).permutation(len(x))[:ASKED]
    cosines = x[asked] @ x.T
    cosines[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-cosines, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    index = Index(centroids, np.stack(books), len(centroids))
    order = index.nearest_cells(x[asked], len(centroids))
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], cell[near]]
    probes = int(np.quantile(place, RECALL, method="higher")) + 1 if place.size else 1
    return Index(centroids, index.books, probes)


def _entries(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, ids): the distinct vectors, each with its `keep` smallest ids (an array no longer than that, merged by salt first)."""
    rows = vectors.groupBy("v", salt(F.col("id")).alias("salt"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(64)).alias("part"))
    few = rows.agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids")).withColumn("id", F.explode("ids"))
    return few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by cosine, ties to the smaller id.

    `queries` has the same columns as `vectors`; a row with the query's own id is left out. Vectors that are null, empty,
    zero, hold null or non-finite components, or differ in length from most take no part, nor do null ids. Rows that
    repeat id and vector count once. Fewer than k candidates in the probed cells give fewer rows. Extra columns are left
    aside; empty tables give an empty result.
    """
    out = f"query_id long, rank int, {id_col} long, score double"
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.where(fine).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()  # -0.0 becomes 0.0

    rows, wanted = clean(vectors), clean(queries)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    rows, wanted = rows.where(F.size("v") == common.d), wanted.where(F.size("v") == common.d)
    index = fit(rows, k=k) if index is None else index
    shared = spark.sparkContext.broadcast(index)  # at most CELLS centroids and SUBSPACES codebooks, whatever the input
    probes = min(len(index.centroids), index.probes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            x = units(x)
            cell = ix.nearest_cells(x, 1)[:, 0]
            codes = ix.encode(x - ix.centroids[cell])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "cell", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            cells = ix.nearest_cells(units(x), probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(cells), pa.list_(pa.int32()))], ["id", "v", "cells"])

    entries = stage(_entries(rows, k + 1).mapInArrow(assign, schema("v array<double>, ids array<long>, cell int, code binary")), "entries")
    probing = stage(wanted.mapInArrow(probe, schema("id long, v array<double>, cells array<int>")), "probes")
    per_cell = entries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def compare(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # in the tasks only

        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(entry) or not len(query):
            return none
        ix = shared.value
        x, q = scaled(np.stack(entry["v"].to_numpy())), scaled(np.stack(query["v"].to_numpy()))
        codes = np.frombuffer(b"".join(entry["code"]), np.uint8).reshape(len(x), -1)
        x_norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        centre = ix.centroids[entry["cell"].iloc[0]]
        unit = x / x_norm[:, None]
        errors = ix.errors(unit - centre, codes)
        flat = codes.astype(np.int64) + np.arange(codes.shape[1]) * ix.books.shape[1]
        ids = entry["ids"].to_numpy()
        found: list[tuple[int, int, float]] = []
        for i, (own, least) in enumerate(zip(query["id"].to_numpy(), query["least"].to_numpy(), strict=True)):
            approximate = np.sqrt(ix.tables(q[i : i + 1] / q_norm[i] - centre).ravel()[flat].sum(1))
            # One entry more than wanted, as one may hold nothing but the query's own id.
            near = nearest(unit, q[i] / q_norm[i], approximate, errors, k + 1, least)
            # Summed in one order whatever the block, so that equal vectors get equal scores.
            scores = np.array([np.dot(x[j], q[i]) for j in near]) / (x_norm[near] * q_norm[i])
            mine = [(s, v) for s, j in zip(scores, near, strict=True) for v in ids[j] if v != own]
            mine.sort(key=lambda p: (-p[0], p[1]))
            found += [(own, v, s) for s, v in mine[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]) if found else none

    def met(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of (id, v, cell, least) rows: at most k of each block that a query meets."""
        per_asked = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("askers"))
        cells = F.broadcast(per_cell.join(per_asked, "cell"))  # at most CELLS rows
        left = entries.join(cells, "cell").select("cell", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), "ids", "v", "code")
        right = asked.join(cells, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("askers")).cast("int").alias("asker"), "id", "v", "least")
        key = ["cell", "block", "asker"]
        best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
        return best.groupBy("query_id", F.spark_partition_id().alias("p")).agg(_best(k).alias("b")).select("query_id", F.explode("b").alias("b")).select("query_id", "b.vec_id", (-F.col("b.less")).alias("score"))

    first = stage(met(probing.select("id", "v", F.col("cells")[0].alias("cell"), F.lit(float("-inf")).alias("least"))), "nearest-cell")
    # The k-th best so far is as bad as a neighbour can be.
    least = first.groupBy("query_id").agg(_best(k).alias("b")).where(F.size("b") == k).select(F.col("query_id").alias("id"), (-F.col("b")[k - 1]["less"] - TIES).alias("least"))
    others = probing.select("id", "v", F.explode(F.slice("cells", F.lit(2), F.size("cells"))).alias("cell"))
    others = others.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    ranked = first.unionByName(met(others)).groupBy("query_id").agg(_best(k).alias("b")).select("query_id", F.posexplode("b").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias(id_col), (-F.col("b.less")).alias("score"))


def _best(k: int) -> Column:
    return F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("vec_id")))), 1, k)
