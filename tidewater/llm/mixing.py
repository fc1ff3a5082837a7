"""Problem 9: mixing sources to target weights with capped repetition."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.encode import VOCABULARY, encoding
from tidewater.llm.text import per_distinct
from tidewater.tables import cut_lineage, load

SEED = 17
#: Rates tried at once and rounds of refining them: a rate is found to a part of GRID ** ROUNDS.
GRID, ROUNDS = 16, 4


def _token_counts(path: str):
    @F.arrow_udf(T.LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return per_distinct(texts, lambda t: len(enc.encode_ordinary(t)), pa.int64())

    return tokens


def poisson_thresholds(rate: float, most: int) -> list[float]:
    """P(X < j) for j = 1 .. ``most``, as far as they differ from 1: a uniform number at or beyond the j-th makes the count
    at least j."""
    out, total = [], 0.0
    for j in range(most):
        if j > rate and total >= 1 - 1e-15:
            break
        total += math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) if rate > 0 else float(j == 0)
        out.append(min(1.0, total))
    return out


def capped_mean(rate: float, most: int) -> float:
    return sum(1 - x for x in poisson_thresholds(rate, most))


def highest_rate(mean: float, most: int) -> float:
    """A rate whose capped mean lies half-way between the wanted one and the cap, or beyond."""
    rate = 1.0
    while capped_mean(rate, most) < (mean + most) / 2 and rate < 64.0 * most:
        rate *= 2
    return rate


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[int, dict[str, float]]:
    """The total size and the tokens wanted of each source.

    Without a ``total`` it is the largest one, up to the size of all documents, of which every source that has documents
    can give its share within its cap; with one, a source that can't give its share gives all it can. Shares of sources
    without documents can't be reached; the others keep their proportions among each other.
    """
    there = [(s, share, most) for s, share, most in targets if sizes.get(s) and share > 0 and most > 0]
    weight = sum(share for _, share, _ in there)
    if not there:
        return 0, {}
    if total is None:
        total = int(min([sum(sizes.values()), *(sizes[s] * most * weight / share for s, share, most in there)]))
    return total, {s: min(total * share / weight, float(sizes[s] * most)) for s, share, most in there}


def _counts(grid: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the number of copies by each rate of ``grid``, which holds a few rows per source."""
    return rows.join(F.broadcast(grid), "source").withColumn("n", F.size(F.filter("thresholds", lambda x: F.col("u") >= x)))


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, key: str, text: str, source: str, total: int | None = None, seed: int = SEED,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(key, source, n_tokens, repeats) of every chosen document and (source, ..., actual_share) of every source.

    Sizes are in tokens of a public tokenizer. Each document's number of copies comes from inverting a Poisson
    distribution at a number hashed from seed and key, cut at the source's cap. The rate of each source is then
    calibrated against the documents themselves, in a few passes that add up the tokens per source and rate, so the
    actual share meets its target to within about a document. The target table is configuration and is read to the
    driver: one row per source.

    Defined results: a source of only one of the tables appears in the report, with nothing chosen; targets that can't
    be reached are reported as such and the others keep their proportions; NULL and empty texts have 0 tokens and are
    chosen like any other; repeated rows of a key count once; empty tables give an empty choice; other columns are not
    read.
    """
    spark = documents.sparkSession
    # Uniform numbers in [0, 1) from 53 bits of the hash.
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    rows = documents.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), F.coalesce(_token_counts(vocabulary)(F.col(text)), F.lit(0)).alias("n_tokens"), uniform.alias("u")
    )
    rows = cut_lineage(rows.dropDuplicates(["_key"]))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if r.source is not None}
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r[0] is not None]
    total, goals = plan(sizes, wanted, total)
    most = {s: m for s, _, m in wanted}
    shape = "source string, k int, thresholds array<double>"
    span = {s: (0.0, highest_rate(goals[s] / sizes[s], most[s])) for s in goals if goals[s] < sizes[s] * most[s]}
    rates: dict[str, list[float]] = {s: [0.0] * most[s] for s in goals if s not in span}  # all copies there may be
    for _ in range(ROUNDS if span else 0):
        tried = {(s, k): lo + (hi - lo) * k / GRID for s, (lo, hi) in span.items() for k in range(GRID + 1)}
        grid = spark.createDataFrame([(s, k, poisson_thresholds(x, most[s])) for (s, k), x in tried.items()], shape)
        given = {(r.source, r.k): r.n for r in _counts(grid, rows).groupBy("source", "k").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n")).collect()}
        for s in span:
            k = max((k for k in range(GRID + 1) if given.get((s, k), 0) <= goals[s]), default=0)
            span[s] = (tried[s, k], tried[s, min(GRID, k + 1)])
            near = min((kk for kk in (k, min(GRID, k + 1))), key=lambda kk: abs(given.get((s, kk), 0) - goals[s]))  # noqa: B023
            rates[s] = poisson_thresholds(tried[s, near], most[s])
    final = spark.createDataFrame([(s, 0, x) for s, x in rates.items()], shape)
    chosen = _counts(final, rows).filter("n > 0").select(F.col("_key").alias(key), "source", "n_tokens", F.col("n").alias("repeats"))

    given = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.max("repeats").alias("most"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    asked = spark.createDataFrame([(s, share, m, float(goals.get(s, 0.0))) for s, share, m in wanted], "source string, target_share double, max_repeats int, goal double")
    held = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, available_tokens bigint")
    report = asked.join(held, "source", "full").join(given, "source", "left").na.fill(0, ["documents", "copies", "most", "tokens", "available_tokens"])
    report = report.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # a row per source
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    report = report.select(
        "source", "target_share", "max_repeats", "available_tokens", "documents", "copies", F.col("most").alias("most_repeats"), "tokens", F.round(share, 6).alias("actual_share"),
        (F.col("target_share") <= share + 0.005).alias("reached"),
    )
    return chosen, report


def _mix(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(documents, load(spark, sf_dir, "mix_targets"), key="doc_id", text="text", source="source")


def p9_mix(spark, sf_dir: str) -> DataFrame:
    """The chosen documents with their size and number of repeats, and the actual share of their source."""
    chosen, report = _mix(spark, sf_dir)
    shares = report.select("source", "target_share", "actual_share", "reached")
    return chosen.join(F.broadcast(shares), "source").select("doc_id", "source", "n_tokens", "repeats", "target_share", "actual_share", "reached")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, sf_dir)[1]


def p9_sequence(spark, sf_dir: str) -> DataFrame:
    """The mixed corpus as copies of documents in a global random order."""
    chosen, _ = _mix(spark, sf_dir)
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats")))
    return copies.withColumn("position", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy")).orderBy("position", "doc_id", "copy").select("position", "doc_id", "copy", "source", "n_tokens")
