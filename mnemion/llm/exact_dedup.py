"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is a polynomial in its bytes modulo two primes. Chunks are hashed on their own, in parallel, and
combined by shifting each hash by the length before it, so a text of any length is fingerprinted from its chunks without
a pass that depends on the one before. Only (row, fingerprint, length, digest) is grouped. Texts of equal fingerprints are
then compared chunk by chunk with the group's representative, each chunk being a row of its own; texts that differ after
all are grouped again among themselves by a cryptographic digest, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import LOWER_BYTES, lower_ascii, packed, salt, schema, small_batches, stage

CHUNK = 1024  # bytes hashed at once
COMPARE = 16384  # code points compared at once
SALTS = 512
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1103515245, 1566083941)
SLICE = 1 << 18  # bytes handled by one numpy pass


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % prime
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step) % np.uint64(prime)
        done += k
        step = step * step % prime
    return out[:n]


def chunk_hashes(data: np.ndarray, starts: np.ndarray, place: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Of each chunk beginning at starts: the sum of (byte + 1) * base**(place in the chunk), modulo prime."""
    w = powers(base, prime, CHUNK)
    terms = (data.astype(np.uint64) + np.uint64(1)) * w[place]  # below 2**40, 1024 of them below 2**50
    return np.add.reduceat(terms, starts) % np.uint64(prime)


def combine(hashes: np.ndarray, base: int, prime: int) -> int:
    """The fingerprint of a text from its chunks' hashes: each is shifted by the bytes before it."""
    shift = powers(pow(base, CHUNK, prime), prime, len(hashes))
    return int((hashes * shift % np.uint64(prime)).sum() % np.uint64(prime))


def fingerprints(texts: list[bytes]) -> list[tuple[int, int]]:
    """Two fingerprints of each normalised text; an empty text has (0, 0)."""
    out: list[tuple[int, int]] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        sizes = np.array([len(x) for x in group], np.int64)
        counts = -(-sizes // CHUNK)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        chunk_of = np.concatenate(([0], np.cumsum(counts)))
        total = int(chunk_of[-1])
        found = [np.zeros(total, np.uint64)] * 2
        if total:
            data = np.frombuffer(b"".join(group), np.uint8)
            starts = np.repeat(first, counts) + (np.arange(total) - np.repeat(chunk_of[:-1], counts)) * CHUNK
            place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            found = [chunk_hashes(data, starts, place, b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        single = counts == 1
        for i in range(len(group)):
            a, z = chunk_of[i], chunk_of[i + 1]
            if single[i]:
                out.append((int(found[0][a]), int(found[1][a])))
            else:
                out.append(tuple(combine(f[a:z], b, p) for f, b, p in zip(found, BASES, PRIMES, strict=True)) if z > a else (0, 0))
        group, held = [], 0

    for x in texts:
        group.append(x)
        held += len(x)
        if held >= SLICE:
            flush()
    flush()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        texts = [(x or "").encode().translate(LOWER_BYTES) for x in b.column("__text").to_pylist()]
        fps = fingerprints(texts)
        yield pa.RecordBatch.from_arrays(
            [b.column("__id"), pa.array([f << 32 | g for f, g in fps], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), b.column("text_sha256")],
            ["__id", "__fp", "__bytes", "text_sha256"],
        )


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with the largest id, its digest and the size of their group. Aggregated by key and salt first, and joined back by both."""
    rows = rows.withColumn("__salt", salt(F.col("__id"), SALTS))
    part = rows.groupBy(*key, "__salt").agg(F.max(F.struct(F.col("__id").alias("id"), F.col("text_sha256").alias("sha"))).alias("__max"), F.count("*").alias("__n"))
    whole = part.groupBy(*key).agg(F.max("__max").alias("__max"), F.sum("__n").alias("group_size"), F.collect_list("__salt").alias("__salts"))
    whole = whole.select(*key, F.col("__max.id").alias("keep_id"), F.col("__max.sha").alias("__keep_sha"), "group_size", F.explode("__salts").alias("__salt"))
    return rows.join(whole, [*key, "__salt"]).drop("__salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The largest id of equal texts stays. Rows
    that repeat an id with the same text count in group_size and share kept. A null id is the least: it stays only where no
    equal text has an id. An empty table gives an empty result. Other columns are left aside.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    hashed = texts.withColumn("text_sha256", F.sha2(lower_ascii(F.col("__text")).cast("binary"), 256))
    kind = "__id long, __fp long, __bytes long, text_sha256 string"
    found = stage(_groups(stage(hashed.mapInArrow(_fingerprint_batches, schema(kind)), "fingerprints"), ["__fp", "__bytes"]), "groups")
    differ = stage(_differing(texts, found), "differ")
    if not differ.isEmpty():
        # The texts of one fingerprint that differ from its representative are grouped by their digest as well.
        rows = found.drop("keep_id", "__keep_sha", "group_size").join(differ.withColumn("__other", F.lit(1)), ["__id", "text_sha256"], "left")
        found = _groups(rows.withColumn("__class", F.when(F.col("__other") == 1, F.col("text_sha256")).otherwise("")), ["__fp", "__bytes", "__class"])
    return found.select(
        F.col("__id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _differing(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, digest) of texts of which a chunk differs from that of the text that stays, though the fingerprints are equal.

    The members' chunks meet those of the representative under (representative, salt, chunk), so neither a large group nor
    a long text is in one task. Rows are told apart by id and digest, as ids may repeat.
    """
    key = ["__id", "text_sha256"]
    members = found.where("group_size > 1 and __id != keep_id").select(*key, "keep_id", "__keep_sha").distinct().withColumn("__salt", salt(F.col("__id"), SALTS))
    wanted = members.select("__id").unionByName(members.select(F.col("keep_id").alias("__id"))).distinct()
    lower = texts.join(wanted, "__id", "left_semi").select("__id", lower_ascii(F.col("__text")).alias("__text")).withColumn("text_sha256", F.sha2(F.col("__text").cast("binary"), 256))
    starts = F.sequence(F.lit(1), F.greatest(F.length("__text"), F.lit(1)), F.lit(COMPARE))
    chunks = lower.select(*key, "__text", F.posexplode(starts).alias("__k", "__at")).select(*key, "__k", F.expr(f"substring(__text, __at, {COMPARE})").alias("__part"))
    mine = chunks.join(members, key)
    theirs = chunks.select(F.col("__id").alias("keep_id"), F.col("text_sha256").alias("__keep_sha"), "__k", F.col("__part").alias("__theirs"))
    theirs = members.select("keep_id", "__keep_sha", "__salt").distinct().join(theirs, ["keep_id", "__keep_sha"])
    pairs = mine.join(theirs, ["keep_id", "__keep_sha", "__salt", "__k"], "left")
    return pairs.where(~F.col("__part").eqNullSafe(F.col("__theirs"))).select(*key).distinct()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns: one row of each text, that with the largest id."""
    found = exact_dedup(docs, id_col, text_col).where("kept")
    keys = found.groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__n"))
    keys = stage(keys, "kept")
    # Rows travel as one column, so that theirs can have any names.
    mine = docs.select(packed(docs).alias("__row"), F.col(id_col).cast("long").alias("__mine"), F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("__own"))
    out = mine.join(keys, F.col("__mine").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    if not keys.where("__n > 1").isEmpty():  # whole rows are repeated
        out = out.dropDuplicates(["__mine", "__own"])
    return out.select("__row.*")
