"""Secret scan in DataFrame operations only.

Patterns find assignments to secret names, access-key ids and long hexadecimal runs (the base kinds). Beside them, every
long unbroken token is scored by two character Markov models, one of random strings and one of ordinary identifiers, both
trained on labelled samples: a token is reported (kind `random`) if the log-likelihood ratio per transition and its sum
pass their thresholds. The models are tables of at most ALPHABET^2 transitions, so they go into the plan as a constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemion.llm.common import hashed_sample

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
#: Bounds of the training sample: random strings made, and rows from which ordinary words are taken.
RANDOM_STRINGS = 4000
WORD_ROWS = 2000
PER_STEP, IN_ALL = 0.45, 10.0
SMOOTH = 0.5


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the texts between them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"
RUN = 64  # matches whose offsets are summed up in one fold; runs of them are then shifted, so that many matches stay cheap


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<(start, end, kind, value)> of all matches; offsets are the running sum of the lengths of gaps and matches."""
    found, gaps = _pieces(text, pattern)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(span)).alias("all"))

    def runs(all_pairs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("all"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_pairs), F.lit(1)), F.lit(RUN))
        return F.transform(starts, lambda i: F.aggregate(F.slice(all_pairs, i, F.lit(RUN)), zero, step))

    def shift(acc: Column, run: Column) -> Column:
        moved = F.transform(run["all"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["all"], F.array(moved)).alias("all"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("all"))
    return F.when(text.rlike(pattern), F.aggregate(runs(pairs), zero, shift, lambda acc: F.flatten(acc["all"]))).otherwise(none)


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_strings: int = RANDOM_STRINGS, word_rows: int = WORD_ROWS) -> DataFrame:
    """(token, label): labelled samples. 1: strings drawn by digests in four alphabets; 0: words of a bounded, hashed sample of rows.

    Words inside a base match are left out of label 0. A secret of no base kind in the sample would count as ordinary, one
    token among thousands; `train` takes any other labelled table where that is not wanted.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    kind = F.pmod("id", F.lit(4))
    text = F.base64(F.unhex(digest))
    made = F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.substring(text, 1, 44)).when(kind == 2, F.substring(F.upper(F.regexp_replace(text, "[+/=]", "")), 1, 24)).otherwise(F.substring(F.regexp_replace(text, "[+/=]", ""), 1, 32))
    random = spark.range(random_strings).select(made.alias("token"), F.lit(1).alias("label"))
    rows = hashed_sample(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), "__id", word_rows).where("__text is not null")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("__text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = rows.select(F.explode(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"))
    # Ordinary identifiers are words, alone and joined as code and paths join them.
    joined = words.withColumn("token", F.element_at(F.array(F.col("token"), F.initcap("token"), F.concat(F.col("token"), F.lit("_")), F.concat(F.lit("/"), F.col("token"), F.lit("-"))), F.pmod(F.xxhash64("token"), F.lit(4)).cast("int") + 1))
    return random.unionByName(joined.withColumn("label", F.lit(0)))


def train(labelled: DataFrame, token_col: str = "token", label_col: str = "label") -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the N * N transitions (row: the character before).

    The table gathered has at most 2 * N * N rows. Label null and characters outside ALPHABET are passed over.
    """
    at = F.sequence(F.lit(1), F.length(token_col) - 1)
    steps = labelled.where(F.length(token_col) > 1).select(F.col(label_col).cast("int").alias("label"), F.explode(F.transform(at, lambda i: F.substring(F.col(token_col), i, F.lit(2)))).alias("pair"))
    counts = steps.where("label in (0, 1)").groupBy("label", F.expr(f"instr('{ALPHABET}', substring(pair, 1, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substring(pair, 2, 1))").alias("b")).count()
    table = [[[SMOOTH] * N for _ in range(N)] for _ in range(2)]
    for label, a, b, n in counts.where("a > 0 and b > 0").collect():
        table[label][a - 1][b - 1] += n
    return [math.log(table[1][a][b] / sum(table[1][a])) - math.log(table[0][a][b] / sum(table[0][a])) for a in range(N) for b in range(N)]


def _ratio(token: Column, model: Column) -> Column:
    """The sum of the log-likelihood ratios of a token's transitions."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, zero, lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.when(acc["before"] > 0, F.get(model, (acc["before"] - 1) * N + c - 1)).otherwise(0.0)).alias("sum")), lambda acc: acc["sum"])


def find_secrets(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, found.

    Offsets are code points, end exclusive. Spans are ordered by start, then kind; `found` has (start, end, kind, value).
    The added spans never touch a base span. Null and empty texts have none. `model` is train()'s result, by default of
    samples(docs). Repeated rows are each searched; null ids are passed through; other columns are left aside; an empty
    table gives an empty result.
    """
    model = train(samples(docs, id_col, text_col)) if model is None else model
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    text = F.col("__text")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    rows = rows.select("__id", assign.alias("assign"), F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(F.array()).alias("access"), _spans(text, HEX, "hex").alias("hex"), _spans(text, CANDIDATE, "random").alias("candidates"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumn("base", base)

    def added(c: Column) -> Column:
        apart = ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        ratio = _ratio(c["value"], table)
        return apart & (ratio >= IN_ALL) & (ratio >= PER_STEP * (c["end"] - c["start"] - 1))

    rows = rows.withColumn("every", F.when(F.size("candidates") > 0, F.array_sort(F.concat(F.col("base"), F.filter("candidates", added)))).otherwise(F.col("base")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select(
        F.col("__id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("every").alias("spans"),
        F.transform("every", lambda s: F.struct(s["start"], s["end"], F.get(names, s["kind"]).alias("kind"), s["value"])).alias("found"),
    )
