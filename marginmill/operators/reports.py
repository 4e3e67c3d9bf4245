"""Reports: status and value counts, rates, breakdowns, comparisons, gates and preflights, as aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import stats

PASS, PASS_STRICT = 7, 8


def r6(c: Column) -> Column:
    return F.round(c, 6)


def share(flag: Column) -> Column:
    """Share of rows that a flag holds for; unknown counts as no."""
    return r6(F.avg(F.coalesce(flag, F.lit(False)).cast("double")))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """family, n, pct: by the part of the status before a colon, most frequent first."""
    counts = rows.groupBy(text.status_family(F.col(status)).alias("family")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    out = counts.withColumn("_", F.lit(1)).join(F.broadcast(total.withColumn("_", F.lit(1))), "_")  # one row
    return out.select("family", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct")).orderBy(F.desc("n"), "family")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def score_distribution(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Counts of the scores 0 to top, zeros listed."""
    found = rows.groupBy(F.col(column).cast("int").alias("score")).agg(F.count("*").alias("_n"))
    return rows.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("score")).join(found, "score", "left").select("score", F.coalesce("_n", F.lit(0)).alias("n"))


def label_census(labels: DataFrame, by: str | None = None) -> DataFrame:
    """Defects, records with one, verified clean and ambiguous records of label rows (defects, n_ungrounded)."""
    size, lost = F.size("defects"), F.coalesce("n_ungrounded", F.lit(0))
    return labels.groupBy(*([by] if by else [])).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tuples"), F.count_if(size > 0).alias("labeled"), F.count_if((size == 0) & (lost == 0)).alias("clean"),
        F.count_if((size == 0) & (lost > 0)).alias("ambiguous"), F.coalesce(F.sum(F.size(F.filter("defects", lambda d: d["issue_type"] == "style"))), F.lit(0)).cast("long").alias("style"),
    )


def issue_types(labels: DataFrame) -> DataFrame:
    return value_counts(labels.select(F.explode("defects").alias("d")).select("d.issue_type"), "issue_type")


def contenders(views: dict[str, DataFrame], models: dict[str, DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Conditional means by label view and model; score joins predictions with labels to scored rows."""
    parts = [score(preds, labels).withColumns({"view": F.lit(v), "model": F.lit(m)}) for v, labels in views.items() for m, preds in models.items()]
    return stats.conditional_means(reduce(DataFrame.unionByName, parts), "view", "model")


def unpivoted(rows: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """One row a prediction field: ids, field, pred; null predictions are empty."""
    return rows.select(*ids, *fields).unpivot(ids, fields, "field", "pred").withColumn("pred", F.coalesce("pred", F.lit("")))


def regression(rows: DataFrame, delta: str) -> DataFrame:
    """improved, regressed, tied, net, net_rate and mean_delta."""
    d = F.col(delta)
    out = rows.agg(F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"), F.count_if(d == 0).alias("tied"), F.count(d).alias("_n"), r6(F.avg(d)).alias("mean_delta"))
    net = F.col("improved") - F.col("regressed")
    return out.select("improved", "regressed", "tied", net.alias("net"), r6(net / F.nullif("_n", F.lit(0))).alias("net_rate"), "mean_delta")


def worst(rows: DataFrame, delta: str, key: str, n: int = 10) -> DataFrame:
    """The n rows that fell most, ranked; rows that didn't fall aren't listed."""
    return ranked(rows.where(F.col(delta) < 0), F.col(delta).asc(), key, n)


def ranked(rows: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The first n rows with their rank; a top-k, so only n rows meet in the last task."""
    from pyspark.sql import Window

    return rows.orderBy(order, key).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def best_wins(rows: DataFrame, n: int = 5) -> DataFrame:
    """Wins by the largest jump of the score (key, verdict, score_a, score_b)."""
    return ranked(rows.where("verdict = 'A'").withColumn("jump", F.col("score_a") - F.col("score_b")), F.desc("jump"), "key", n)


def best_checkpoint(rows: DataFrame, fp_bar: float, halluc_bar: float) -> DataFrame:
    """Of checkpoints (step, recall, fp_rate, halluc) within both bars the one with most recall, the earliest on ties."""
    df = rows.withColumns({"recall": F.coalesce("recall", F.lit(0.0)), "fp_rate": F.coalesce("fp_rate", F.lit(1.0))})
    return df.where((F.col("fp_rate") <= fp_bar + 1e-9) & (F.col("halluc") <= halluc_bar + 1e-9)).orderBy(F.desc("recall"), "step").limit(1)


def beats(rows: DataFrame, recall_bar: float, fp_bar: float, halluc_bar: float) -> DataFrame:
    """rows with beats: more recall than the bar, the others no worse."""
    ok = (F.coalesce("fp_rate", F.lit(1.0)) <= fp_bar + 1e-9) & (F.col("halluc") <= halluc_bar + 1e-9)
    return rows.withColumn("beats", ok & (F.coalesce("recall", F.lit(0.0)) > recall_bar))


def spread(rows: DataFrame, bucket: str, value: str) -> DataFrame:
    """Points between the best and the worst bucket mean, and the weakest bucket."""
    means = rows.groupBy(F.coalesce(bucket, F.lit("unknown")).alias("bucket")).agg(F.avg(value).alias("mean"))
    return means.agg(F.round(F.coalesce((F.max("mean") - F.min("mean")) * 100, F.lit(0.0)), 4).alias("spread"), F.min_by("bucket", F.struct("mean", "bucket")).alias("weakest"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of shared keys with the same verdict."""
    both = a.select(key, F.col("verdict").alias("_a")).join(b.select(key, F.col("verdict").alias("_b")), key)
    return both.agg(F.count("*").alias("n"), share(F.col("_a") == F.col("_b")).alias("agreement"))


def win_matrix(verdicts: DataFrame, models: list[str]) -> DataFrame:
    """Rows model, a column a model: the row's rate of wins against it, 0.5 against itself (model_a, model_b, verdict)."""
    rate = verdicts.groupBy("model_a", "model_b").agg(share(F.col("verdict") == "A").alias("a"), share(F.col("verdict") == "B").alias("b"))
    cells = rate.select(F.col("model_a").alias("model"), F.col("model_b").alias("other"), F.col("a").alias("rate"))
    cells = cells.unionByName(rate.select(F.col("model_b").alias("model"), F.col("model_a").alias("other"), F.col("b").alias("rate")))
    same = verdicts.sparkSession.createDataFrame([(m, m, 0.5) for m in models], "model string, other string, rate double")
    return cells.unionByName(same).groupBy("model").pivot("other", models).agg(F.max("rate"))


def shape(rows: DataFrame, review: str, *by: str) -> DataFrame:
    """Lengths, names, clean verdicts and loops of reviews."""
    body = F.coalesce(F.col(review), F.lit(""))
    names = F.size(F.regexp_extract_all(body, F.lit(text.TICKED_NAME), F.lit(1)))
    return rows.groupBy(*by).agg(
        F.round(F.avg(F.length(body)), 4).alias("mean_length"), F.round(F.percentile(F.length(body), F.lit(0.5)), 4).alias("median_length"),
        F.round(F.avg(names), 4).alias("names"), share(text.says_clean(body)).alias("clean_rate"), F.count_if(text.loops(body)).alias("loops"),
    )


def pass_rates(rows: DataFrame, score: str, *by: str) -> DataFrame:
    s = F.col(score)
    return rows.groupBy(*by).agg(r6(F.avg(s)).alias("mean_score"), share(s >= PASS).alias("pass_at_1"), share(s >= PASS_STRICT).alias("pass_at_1_strict"))


def mention_rates(rows: DataFrame, review: str, diff: str, stop: list[str], *by: str) -> DataFrame:
    """Reviews that mention a changed name, one of four letters or more, or tick a name that the diff lacks."""
    names = text.names_changed(F.col(diff), stop)
    long = text.names_changed(F.col(diff), stop, least=4)
    body = F.coalesce(F.col(review), F.lit(""))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), share(text.known_names(body, names) > 0).alias("mention_rate"), share(text.known_names(body, long) > 0).alias("specificity_rate"),
        share(text.unknown_name_flag(body, F.col(diff), stop)).alias("halluc_rate"),
    )


def misses(rows: DataFrame) -> DataFrame:
    """Of rows (a_mentions, b_mentions, a_score, b_score, a_review) that a doesn't mention: how b did, and the scores."""
    r = rows.where(~F.coalesce("a_mentions", F.lit(False)))
    return r.agg(
        F.count("*").alias("n"), F.count_if(~F.col("b_mentions")).alias("both_missed"), F.count_if(F.col("b_mentions")).alias("only_a_missed"),
        F.count_if(F.col("a_score") >= F.col("b_score")).alias("a_not_lower"), F.count_if(F.col("a_score") < F.col("b_score")).alias("a_lower"),
        r6(F.avg("a_score")).alias("a_mean"), r6(F.avg("b_score")).alias("b_mean"), F.round(F.avg(F.length("a_review")), 4).alias("mean_length"),
    )


def invented_rate(rows: DataFrame, verdict: str, *by: str) -> DataFrame:
    """Share of YES on diffs without an issue; EMPTY and UNKNOWN count among all."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col(verdict) == "YES").alias("fp_rate"))


def no_worse(a: Column, b: Column) -> Column:
    """The gate on invented defects: a's rate isn't above b's."""
    return a <= b


def level_counts(rows: DataFrame, raw: str) -> DataFrame:
    """How reviews were extracted, and how many are empty all the same."""
    level, review = text.extraction_level(F.col(raw)), text.salvaged(F.col(raw))["review"]
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_if(F.length(text.strip(review)) < text.SHORT_REVIEW).alias("still_empty"))


def table(rows: DataFrame, models: list[str]) -> DataFrame:
    """metric, a column a model, and each model's delta to the first (metric, model, value)."""
    wide = rows.groupBy("metric").pivot("model", models).agg(F.first("value"))
    return wide.select("metric", *models, *(r6(F.col(m) - F.col(models[0])).alias(f"{m}_delta") for m in models[1:]))


def zero_rewards(rows: DataFrame, reward: str, raw: str) -> DataFrame:
    """Rewards of zero: all, by unclosed thoughts, others."""
    zero, cut = F.count_if(F.col(reward) < 1e-9), F.count_if(F.contains(raw, F.lit("<think>")) & ~F.contains(raw, F.lit("</think>")))
    return rows.agg(F.count("*").alias("n"), zero.alias("n_zero"), cut.alias("n_trunc"), F.greatest(F.lit(0), zero - cut).cast("long").alias("n_other"))


def reward_gate(rewards: DataFrame, group: str, threshold: float = 0.10) -> DataFrame:
    """mean_std, percentiles of the rewards that aren't zero, verdict, and r_min: the 33rd percentile, withheld unless the gate passes."""
    some = F.when(F.col("reward") >= 1e-9, F.col("reward"))
    points = rewards.agg(*(F.percentile(some, F.lit(q / 100)).alias(f"p{q}") for q in (25, 33, 40, 50)), F.count(some).alias("n_nonzero"), F.lit(1).alias("_"))
    out = stats.spread_gate(rewards, group, threshold).withColumn("_", F.lit(1)).join(points, "_").drop("_")
    passed = F.col("passed") & (F.col("n_nonzero") > 0)
    return out.select("mean_std", *(F.round(f"p{q}", 6).alias(f"p{q}") for q in (25, 33, 40, 50)), F.when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.when(passed, F.round("p33", 6)).alias("r_min"))


def phase(ci_lo: Column, domain_spread: Column, difficulty_spread: Column, halluc: Column, base_halluc: Column, weakest: Column) -> Column:
    """The next phase, on percentages: the first rule that holds. Without a base rate 14.5 counts."""
    worse = halluc > F.coalesce(base_halluc, F.lit(14.5))
    uneven = (domain_spread >= 30) | (difficulty_spread >= 30)
    return (
        F.when((ci_lo >= 65) & ~uneven & ~worse, "2C").when((ci_lo >= 65) & uneven, F.concat(F.lit("2B:"), F.coalesce(weakest, F.lit("none"))))
        .when((ci_lo >= 50) & ~worse, "2A optional").when(worse, "2A").otherwise("review")
    )


def preflight(reviews: DataFrame, review: str) -> DataFrame:
    """How many reviews give locations and names; fails for none, warns below 30 %."""
    locs = text.locations(F.col(review))
    names = F.exists(locs, lambda x: F.coalesce(x["identifier"], F.lit("")) != "")
    out = reviews.agg(F.count("*").alias("n"), F.count_if(F.exists(locs, lambda x: (F.coalesce(x["file"], F.lit("")) != "") & (F.coalesce(x["line"], F.lit(0)) != 0))).alias("file_line"), F.count_if(names).alias("identifier"), F.count_if(F.size(locs) == 0).alias("empty"))
    return out.withColumn("verdict", F.when(F.col("identifier") == 0, "FAIL").when(F.col("identifier") < 0.3 * F.col("n"), "WARN").otherwise("OK"))


def missing_fields(schema, required: dict[str, str]) -> list[str]:
    """Required fields (dotted path: type) that a schema lacks or has with another type."""
    out = []
    for path, kind in required.items():
        now = schema
        for part in path.split("."):
            now = getattr(now, "elementType", now)
            now = next((f.dataType for f in getattr(now, "fields", []) if f.name == part), None)
        if now is None or now.simpleString() != kind:
            out.append(path)
    return out


def require(rows: DataFrame, least: int, what: str) -> DataFrame:
    """Fails for fewer than least rows."""
    if (n := rows.limit(least).count()) < least:
        raise ValueError(f"{what}: {n} rows, {least} are needed")
    return rows
