"""Randomisation tests whose cost does not grow with the number of rows.

Both tests only need counts of distinct values: the permutation of ratings against
animal counts is a random table with fixed margins, and drawing from a pool with
replacement is a multinomial over its distinct hours. Spark reduces the rows to those
counts, spreads the iterations over tasks, and numpy draws inside each task from a
generator seeded by (seed, block), so a retried task repeats its draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import ITERATIONS, MIN_SIGHTINGS
from fieldlens.operators.journal import contingency, spearman
from fieldlens.session import cut_lineage

BLOCK = 250


def _iteration_blocks(one_row: DataFrame, iterations: int) -> DataFrame:
    """One row per block of iterations, spread over tasks."""
    starts = F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(BLOCK))
    out = one_row.withColumn("start", F.explode(starts)).withColumn(
        "stop", F.least(F.col("start") + BLOCK, F.lit(iterations)))
    return out.repartition(max(1, -(-iterations // BLOCK)), "start")


def _mid(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts + (counts + 1) / 2.0


def _log_gamma_step(a: float, d: float) -> float:
    """ln gamma(a + d) - ln gamma(a), without the loss of digits that two large values would bring."""
    if min(a, a + d) < 100:
        return math.lgamma(a + d) - math.lgamma(a)
    series = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return (a + d - 0.5) * math.log1p(d / a) + d * math.log(a) - d + series(a + d) - series(a)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from an urn are good, for urns of any size.

    The generator's own method stops at 10**9. Beyond it a value is drawn from under a hat around
    the mode (ratio of uniforms) and kept with the exact ratio of its chance to the mode's.
    """
    total = good + bad
    if total < 10 ** 9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    mean = draws * good / total
    spread = math.sqrt(max(mean * (bad / total) * ((total - draws) / (total - 1)), 0.0) + 0.5)
    centre, width = mean + 0.5, 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u = 1.0 - rng.random()
        x = math.floor(centre + width * (rng.random() - 0.5) / u)
        if low <= x <= high:
            d = x - mode
            chance = -(_log_gamma_step(mode + 1, d) + _log_gamma_step(good - mode + 1, -d) + _log_gamma_step(draws - mode + 1, -d)
                       + _log_gamma_step(bad - draws + mode + 1, d))
            if 2 * math.log(u) <= chance:
                return x


def multivariate(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """Draws without replacement from kinds of the given counts, kind by kind."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, here in enumerate(counts.tolist()):
        left -= here
        out[i] = hypergeometric(rng, here, left, int(draws))
        draws -= out[i]
    return out


def permutation_p(sits: DataFrame, iterations: int = ITERATIONS, seed: int = 1) -> DataFrame:
    """One row {rho, p}: chance of a rank correlation this strong when counts are shuffled.

    The distinct ratings (5) and distinct animal counts are the only arrays that travel.
    """
    table = contingency(sits)
    xs = table.groupBy("x").agg(F.sum("m").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x").cast("bigint").alias("v"), "k"))).alias("xs"))
    ys = table.groupBy("y").agg(F.sum("m").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("y").cast("bigint").alias("v"), "k"))).alias("ys"))
    rho = spearman(table)
    one = rho.join(F.broadcast(xs)).join(F.broadcast(ys)).where(F.col("rho").isNotNull()).select(
        "rho", F.transform("xs", lambda s: s["k"]).alias("rows"),
        F.transform("ys", lambda s: s["k"]).alias("cols"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows, cols = np.asarray(r.rows, dtype=np.int64), np.asarray(r.cols, dtype=np.int64)
                a, b = _mid(rows), _mid(cols)
                n = rows.sum()
                va = (rows * a * a).sum() - (rows * a).sum() ** 2 / n
                vb = (cols * b * b).sum() - (cols * b).sum() ** 2 / n
                hits = 0
                rng = np.random.default_rng([seed, r.start])
                for _ in range(r.start, r.stop):
                    left, cross = cols.copy(), 0.0
                    for i in range(len(rows) - 1):
                        took = multivariate(rng, left, rows[i])
                        cross += a[i] * (took * b).sum()
                        left = left - took
                    cross += a[-1] * (left * b).sum()
                    got = (cross - (rows * a).sum() * (cols * b).sum() / n) / np.sqrt(va * vb)
                    hits += abs(got) >= abs(r.rho) - 1e-12
                yield pd.DataFrame({"rho": [r.rho], "hits": [hits], "runs": [r.stop - r.start]})

    out = _iteration_blocks(one, iterations).mapInPandas(run, "rho double, hits bigint, runs bigint")
    return out.groupBy("rho").agg(((F.sum("hits") + 1) / (F.sum("runs") + 1)).alias("p"))


def strata(observed: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Per test and stratum: what was observed and the pool's distinct values with counts.

    A pool of hours has at most one distinct value per hour on record, however many cameras
    shared it, so the arrays are bounded by the calendar.
    """
    need = (observed.where(F.col("value").isNotNull()).groupBy(*keys, "stratum")
            .agg(F.count("*").alias("need"), F.sum("value").alias("observed_sum")))
    dist = (pool.where(F.col("value").isNotNull()).groupBy(*keys, "stratum", "value")
            .agg(F.count("*").alias("k")).groupBy(*keys, "stratum")
            .agg(F.sum("k").alias("have"), (F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("pool_mean"),
                 F.array_sort(F.collect_list(F.struct("value", "k"))).alias("d")))
    return need.join(dist, keys + ["stratum"], "left").na.fill(0, ["have"])


def _means(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(
        F.sum("need").alias("n"), (F.sum("observed_sum") / F.sum("need")).alias("observed"),
        (F.sum(F.col("need") * F.col("pool_mean")) / F.sum("need")).alias("expected"),
        (F.bool_and(F.col("have") >= 2 * F.col("need")) & (F.sum("need") >= 2)).alias("ok"))


def stratified_means(observed: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Observed and expected mean per test, refused when a stratum's pool is thin.

    observed(*keys, stratum, value), pool(*keys, stratum, value). Expected is the pool mean
    weighted by how often each stratum was observed. A stratum with fewer pool values than
    twice its observations makes the test unanswerable (`ok` false).
    """
    return _means(strata(observed, pool, keys), keys)


def stratified_test(observed: DataFrame, pool: DataFrame, keys: list[str],
                    iterations: int = ITERATIONS, seed: int = 1) -> DataFrame:
    """Adds p to `stratified_means`: how often a draw matched on stratum is as far out."""
    table = cut_lineage(strata(observed, pool, keys))
    means = _means(table, keys)
    work = (table.join(means.where("ok").select(*keys), keys)
            .select(*keys, "stratum", "need", F.transform("d", lambda s: s["value"]).alias("values"),
                    F.transform("d", lambda s: s["k"]).alias("counts"),
                    F.hash(*keys, "stratum").alias("salt")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                v, k = np.asarray(r["values"], float), np.asarray(r["counts"], float)
                its = np.arange(r["start"], r["stop"])
                rng = np.random.default_rng([seed, int(r["start"]), r["salt"] & 0xFFFFFFFF])
                sums = np.concatenate([rng.multinomial(r["need"], k / k.sum(), size=len(part)) @ v
                                       for part in np.array_split(its, len(its) * len(v) // 2_000_000 + 1)])
                yield pd.DataFrame({**{c: r[c] for c in keys}, "iteration": its, "drawn": sums})

    draws = _iteration_blocks(work, iterations).mapInPandas(run, f"{schema}, iteration int, drawn double")
    per = draws.groupBy(*keys, "iteration").agg(F.sum("drawn").alias("drawn")).join(means, keys)
    far = (F.abs(F.col("drawn") / F.col("n") - F.col("expected"))
           >= F.abs(F.col("observed") - F.col("expected")))
    p = per.groupBy(*keys).agg(((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p"))
    return means.join(p, keys, "left")


def judge(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni over the tests that ran: results(p, observed, expected, high, low)."""
    ran = results.agg(F.count("p").alias("tests"))
    bar = F.when(F.col("tests") > 0, alpha / F.col("tests")).otherwise(alpha)
    follows = F.concat(F.lit("follows "), F.when(F.col("observed") > F.col("expected"), F.col("high"))
                       .otherwise(F.col("low")))
    return (results.join(F.broadcast(ran)).withColumn("threshold", bar)
            .withColumn("verdict", F.when(F.col("n") < MIN_SIGHTINGS, "not enough sightings")
                        .when(F.col("p").isNull(), "cannot be answered")
                        .when(F.col("p") <= F.col("threshold"), follows)
                        .otherwise("no relationship")))
