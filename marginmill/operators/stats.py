"""Scores and their uncertainty: conditional means, bootstraps, gates, advantages and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import curate


def conditional_means(rows: DataFrame, *by: str) -> DataFrame:
    """rows (n_defects, recall, precision, fp_rate): counts, and means over the rows that each is defined for."""
    r6 = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count_if(F.col("n_defects") > 0).alias("n_labeled"), F.count_if(F.col("n_defects") == 0).alias("n_clean"),
        r6("recall").alias("recall"), r6("precision").alias("precision"), r6("fp_rate").alias("fp_rate"),
    )


def with_default(rows: DataFrame, *columns: str, count: str | None = None) -> DataFrame:
    """Means over all rows, 0.0 for none; count names a column of their number before them."""
    n = [F.count("*").alias(count)] if count else []
    return rows.agg(*n, *(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in columns))


def paired_deltas(a: DataFrame, b: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows that both predictions have, with both sides' recall, fp_rate and halluc and the differences b - a.

    order, a column: of rows with the same key the last counts.
    """
    if order:
        a, b = (curate.last_wins(x, key, order) for x in (a, b))
    metrics = ("recall", "precision", "fp_rate", "halluc")
    x, y = (df.select(key, *(F.col(c).alias(f"{c}_{s}") if c in df.columns else F.lit(None).cast("double").alias(f"{c}_{s}") for c in ("n_defects", *metrics))) for df, s in ((a, "a"), (b, "b")))
    both = x.join(y, key)
    sides = [f"{c}_{s}" for c in metrics for s in "ab"]
    return both.select(key, F.col("n_defects_a").alias("n_defects"), *sides, *((F.col(f"{c}_b") - F.col(f"{c}_a")).alias(c) for c in metrics))


def _interval(values: np.ndarray, rng, rounds: int) -> tuple:
    """Mean and percentile interval; nothing, and no draws, for no values."""
    if not len(values):
        return None, None, None
    draws = [values[rng.randint(0, len(values), len(values))].mean() for _ in range(rounds)]
    low, high = np.percentile(draws, [2.5, 97.5])
    return float(values.mean()), float(low), float(high)


#: Rows of one evaluation set that are resampled in one task, as the seeded draws follow each other.
EXACT_ROWS = 1_000_000


def _bounded(rows: DataFrame) -> DataFrame:
    n = rows.limit(EXACT_ROWS + 1).count()
    if n > EXACT_ROWS:
        raise ValueError(f"more than {EXACT_ROWS} rows: seeded draws are sequential; use poisson_bootstrap")
    return rows


def paired_bootstrap(deltas: DataFrame, key: str, seed: int = 0, rounds: int = 2000, metrics: tuple[str, ...] = ("recall", "fp_rate", "halluc")) -> DataFrame:
    """Means of the paired differences with percentile intervals, from one stream of draws through the metrics in order.

    A metric without values has nulls and takes no draws. At most EXACT_ROWS rows, which is checked.
    """
    metrics = tuple(m for m in metrics if m in deltas.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = pdf.sort_values(key), np.random.RandomState(seed)
        out = [(m, *_interval(pdf[m].dropna().to_numpy(float), rng, rounds)) for m in metrics]
        return pd.DataFrame(out, columns=["metric", "mean", "low", "high"])

    return _bounded(deltas.select(key, *metrics)).groupBy(F.lit("all").alias("_g")).applyInPandas(run, "metric string, mean double, low double, high double")


def paired_report(deltas: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row: sizes, means of both sides, deltas with their intervals, and whether an interval shows a gain."""
    point = deltas.agg(
        F.count("*").alias("n_compared"), F.count_if(F.col("n_defects") > 0).alias("n_labeled"), F.count_if(F.col("n_defects") == 0).alias("n_clean"),
        *(F.avg(f"{m}_{s}").alias(f"{m}_{s}") for m in ("recall", "fp_rate", "halluc") for s in "ab"),
    )
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = intervals.agg(*(pick(m, c).alias(f"{m}_{n}") for m in ("recall", "fp_rate", "halluc") for c, n in (("mean", "delta"), ("low", "lo"), ("high", "hi"))))
    out = point.withColumn("_", F.lit(1)).join(wide.withColumn("_", F.lit(1)), "_").drop("_")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"recall_significant": yes(F.col("recall_lo") > 0), "fp_significant": yes(F.col("fp_rate_hi") < 0), "halluc_significant": yes(F.col("halluc_hi") < 0)})


def ships(report: DataFrame) -> DataFrame:
    """A significant gain in recall, and neither of the others significantly worse."""
    return report.withColumn("ship", F.col("recall_significant") & (F.col("fp_rate_lo") <= 0) & (F.col("halluc_lo") <= 0))


def poisson_bootstrap(rows: DataFrame, key: str, value: str, rounds: int = 200) -> DataFrame:
    """(mean, low, high) of a column over any number of rows: hashed Poisson(1) weights for each round, summed map-side."""
    # cumulative Poisson(1) probabilities
    steps = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(8)]).tolist()
    weight = lambda u: sum((F.when(u > s, 1).otherwise(0) for s in steps[1:]), F.when(u > steps[0], 1).otherwise(0))
    unit = F.pmod(F.xxhash64(F.col(key), F.col("round")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.where(F.col(value).isNotNull()).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight(unit))
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def win_rate(verdicts: DataFrame, order: str, which: str = "A", seed: int = 42, rounds: int = 2000) -> DataFrame:
    """Share of a verdict with its percentile interval, by seeded draws of places in the given order; zeros for no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit, rng = (pdf.sort_values(order)["verdict"] == which).to_numpy(float), np.random.default_rng(seed)
        draws = np.array([hit[rng.integers(0, len(hit), len(hit))].mean() for _ in range(rounds)])
        return pd.DataFrame([(float(hit.mean()), *np.percentile(draws, [2.5, 97.5]).tolist())], columns=["rate", "low", "high"])

    got = _bounded(verdicts.select(order, "verdict")).groupBy(F.lit("all").alias("_g")).applyInPandas(run, "rate double, low double, high double")
    return got.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("rate", "low", "high")))


def wins(verdicts: DataFrame) -> DataFrame:
    """Counts and rates of the verdicts; the counts are the rates times the total, cut to whole numbers."""
    v, rate = F.col("verdict"), lambda x: F.avg((F.col("verdict") == x).cast("double"))
    out = verdicts.agg(F.count("*").alias("total"), *(F.coalesce(rate(x), F.lit(0.0)).alias(f"rate_{x}") for x in ("A", "B", "TIE")), F.count(v).alias("_n")).drop("_n")
    return out.select("total", *((F.col(f"rate_{x}") * F.col("total")).cast("int").alias(n) for x, n in (("A", "wins"), ("B", "losses"), ("TIE", "ties"))), *(F.round(f"rate_{x}", 6).alias(n) for x, n in (("A", "win_rate"), ("TIE", "tie_rate"))))


def nan_sum(values: Column, weights: list[float]) -> Column:
    """Weighted sum of an array of rewards; NaN and null count nothing."""
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x)


def process_slice(rows: DataFrame, index: str, rank: int, size: int) -> DataFrame:
    """The contiguous part of a process: indices from rank * size."""
    return rows.where((F.col(index) >= rank * size) & (F.col(index) < (rank + 1) * size))


def advantages(rewards: DataFrame, group: str, least: float) -> DataFrame:
    """reward minus the group's mean, which is at least ``least``. The mean is an aggregate, so a hot group is combined first."""
    means = rewards.groupBy(group).agg(F.avg("reward").alias("_m"))
    return rewards.join(means, group).withColumn("advantage", F.col("reward") - F.greatest("_m", F.lit(least))).drop("_m")


def spread_gate(rewards: DataFrame, group: str, threshold: float = 0.10) -> DataFrame:
    """Mean within-group population deviation, and whether it reaches the threshold."""
    per = rewards.groupBy(group).agg(F.stddev_pop("reward").alias("s"))
    return per.agg(F.round(F.avg("s"), 6).alias("mean_std")).withColumn("passed", F.col("mean_std") >= threshold)


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts over equal bins of [0, 1] with floating edges as linspace gives them; the last is closed, empty ones are listed."""
    edges = F.array(*(F.lit(float(x)) for x in np.linspace(0, 1, bins + 1)))
    x = F.col(column)
    found = values.where(x.between(0, 1)).select(F.least(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.lit(bins - 1)).alias("bin")).groupBy("bin").count()
    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def majority(votes: Column) -> Column:
    """A or B with two votes or more of an array of three, else TIE."""
    n = lambda v: F.size(F.filter(votes, lambda x: x == v))
    return F.when(n("A") >= 2, "A").when(n("B") >= 2, "B").otherwise("TIE")


def decide(r: dict[str, Column]) -> Column:
    """Ship or not: the first rule that holds, on percentages; a rise of exactly one point still passes."""
    lift = r["wins_pct"] - 50.0
    rules = [
        (~r["variance_gate_passed"], "ABORTED"),
        (r["training_diverged"], "FAILED"),
        (r["cross_check_lift"] < 0, "DO_NOT_SHIP"),
        (r["halluc_b"] - r["halluc_a"] > 1.0, "FAILED"),
        (r["per_domain_spread"] > 10.0, "SUSPICIOUS"),
        ((lift >= 1.0) & (r["ci_lo"] > 50.0), "SHIP"),
        (lift >= 1.0, "INCONCLUSIVE"),
    ]
    return F.coalesce(*(F.when(rule, verdict) for rule, verdict in rules), F.lit("FAILED"))
