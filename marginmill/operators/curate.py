"""Curation: mapping, leakage and style filters, tiers, safety filters, routing, merges and samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import rouge

GENERIC = ("please confirm", "please provide more context", "no issues found", "lgtm", "looks good to me")


def flatten_rows(raw: DataFrame) -> DataFrame:
    """Nested source rows to one flat row each; a missing line falls back to the original one."""
    kind = "array<struct<path: string, line: int, text: string>>"
    notes = F.transform("reference_review_comments", lambda c: F.struct(c["path"].alias("path"), F.coalesce(c["line"], c["original_line"]).alias("line"), F.coalesce(c["text"], F.lit("")).alias("text")))
    notes = F.coalesce(notes, F.array().cast(kind))
    return raw.select(
        "instance_id", "repo", F.col("commit_to_review.patch_to_review").alias("diff"), notes.alias("reference_comments"),
        F.array_join(F.filter(F.transform(notes, lambda x: x["text"]), lambda t: t != ""), "\n\n").alias("reference_text"),
        F.coalesce("metadata.difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("metadata.problem_domain", F.lit("unknown")).alias("problem_domain"),
    )


def repo_name(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, "/", 2), -1))


def without_repos(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Rows whose repository's bare name isn't one of trained (repo)."""
    names = trained.select(repo_name(F.col("repo")).alias("_n")).distinct()
    return rows.join(names, repo_name(rows["repo"]) == F.col("_n"), "left_anti")


#: Repositories that count as trained on where no list is at hand.
DEFAULT_REPOS = ("transformers", "sklearn", "scikit-learn", "pydantic", "fastapi")


def trained_repos(rows: DataFrame | None, spark) -> DataFrame:
    """Bare repository names of training rows (repo); the default ones for no rows or none with a name."""
    default = spark.createDataFrame([(r,) for r in DEFAULT_REPOS], "repo string")
    if rows is None:
        return default
    names = rows.where(F.coalesce("repo", F.lit("")) != "").select(repo_name(F.col("repo")).alias("repo")).distinct()
    return names if names.limit(1).count() else default


def load_and_filter(raw: DataFrame, trained: DataFrame, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Flat rows of repositories that weren't trained on; a limit, for smoke runs, comes before the filter."""
    if limit is not None:
        raw = raw.orderBy(order).limit(limit)
    return without_repos(flatten_rows(raw), trained)


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids: prompts with labels, or a subset to score."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def must_match(rows: DataFrame, other: DataFrame, key: str, what: str) -> DataFrame:
    """rows with other's columns; a row without a partner fails the query."""
    found = other.withColumn("_found", F.lit(True))
    out = rows.join(found, key, "left")
    return out.where(F.coalesce("_found", F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(key).cast("string"))).cast("boolean"))).drop("_found")


def backfilled(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """rows whose column, where null or empty, is source's; '' without one."""
    other = source.select(key, F.col(column).alias("_other"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(F.nullif(column, F.lit("")), F.col("_other"), F.lit(""))).drop("_other")


def with_predictions(rows: DataFrame, **preds: Column) -> DataFrame:
    """rows with prediction columns; null ones are empty."""
    return rows.withColumns({name: F.coalesce(c, F.lit("")) for name, c in preds.items()})


def subject(rows: DataFrame, field: str) -> DataFrame:
    """rows with the field to be scored as pred."""
    return rows.withColumn("pred", F.coalesce(field, F.lit("")))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last: an aggregate, so hot keys are combined before the shuffle."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), F.col(order)).alias("_s")).select(key, "_s.*").select(rows.columns)


def without_style(labels: DataFrame) -> DataFrame:
    return labels.withColumn("defects", F.filter("defects", lambda d: ~d["issue_type"].eqNullSafe(F.lit("style"))))


def without_ambiguous(labels: DataFrame) -> DataFrame:
    return labels.where(~((F.size("defects") == 0) & (F.coalesce("n_ungrounded", F.lit(0)) > 0)))


def grounded(rows: DataFrame) -> DataFrame:
    """Comments split by whether their path is one of the diff's: grounded, n_ungrounded."""
    df = rows.withColumn("_p", text.diff_paths(F.col("diff")))
    ok = F.filter("reference_comments", lambda c: (F.coalesce(c["path"], F.lit("")) != "") & F.array_contains(F.col("_p"), F.coalesce(c["path"], F.lit(""))))
    # two uses of the paths keep them from being worked out again for each comment
    df = df.withColumn("grounded", F.when(F.size("_p") > 0, ok).otherwise(F.slice("reference_comments", 1, 0)))
    return df.withColumn("n_ungrounded", F.size("reference_comments") - F.size("grounded")).drop("_p")


def tier(output: Column, matches: Column) -> Column:
    n, low = F.length(output), F.lower(output)
    generic = F.exists(F.array(*map(F.lit, GENERIC)), lambda g: F.contains(low, g))
    return F.when((n < 40) | (generic & (n < 120)), "drop").when((n < 300) & (matches <= 1), "weak").otherwise("keep")


def rewrite_route(output: Column, matches: Column) -> Column:
    t = tier(output, matches)
    return F.when(t == "drop", "dropped").when((t == "keep") & (matches >= 3), "kept_short_circuit").otherwise("rewrite")


def rewrite_reason(rewrite: Column, original: Column, diff: Column, names: Column) -> Column:
    """First reason against a rewrite: no identifier of the diff, length, false reference; null: it passes."""
    n, o = F.length(rewrite), F.length(original)
    low = F.greatest(F.lit(20), F.floor(0.3 * o))
    high = F.least(F.lit(1500), F.greatest(F.lit(600), F.floor(3.0 * o)))
    return (
        F.when(text.known_names(rewrite, names) < 1, "no_diff_identifier").when((n < low) | (n > high), "length")
        .when(F.size(F.array_except(text.false_references(rewrite, diff), F.array(*map(F.lit, text.SMALL_STOP)))) > 0, "false_reference")
    )


def trace_reason(think: Column, review: Column, anchor: Column, diff: Column, names: Column, stop: list[str]) -> Column:
    """First reason against a trace: no mention though the anchor had one, an invented name, length."""
    n, o = F.length(review), F.greatest(F.lit(1), F.length(anchor))
    pure = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(review, F.lit("`([^`]+)`"), F.lit(1)), text.strip)), lambda x: F.rlike(x, F.lit("^[a-zA-Z_][a-zA-Z0-9_]{2,}$")))
    source = F.concat(diff, F.lit("\n"), anchor)
    invented = F.filter(F.array_except(pure, F.array(*map(F.lit, stop))), lambda x: ~F.contains(source, x))
    low = F.greatest(F.lit(5), F.least(F.lit(20), F.floor(0.3 * o)))
    high = F.least(F.lit(1500), F.greatest(F.lit(400), F.floor(2.5 * o)))
    return (
        F.when((text.known_names(anchor, names) > 0) & (text.known_names(review, names) == 0), "review_no_diff_identifier").when(F.size(invented) > 0, "false_ref_review")
        .when(F.length(think) > 10000, "think_too_long").when((n < low) | (n > high), "review_length")
    )


def trace_status(dropped: Column, anchor: Column, error: Column, finish: Column, missing: Column, reason: Column) -> Column:
    """junk, error, incomplete, schema, filtered, generated: the first that holds."""
    return (
        F.when(dropped | (F.length(text.strip(anchor)) < 20), "skipped_junk").when(error.isNotNull(), "gemini_error")
        .when(finish != "STOP", F.concat(F.lit("gemini_incomplete:"), finish)).when(F.size(missing) > 0, F.concat(F.lit("schema_invalid:"), F.array_join(missing, ",")))
        .when(reason.isNotNull(), F.concat(F.lit("filtered:"), reason)).otherwise("trace_generated")
    )


def transient(status: Column) -> Column:
    return F.coalesce((status == "gemini_error") | status.startswith("gemini_incomplete"), F.lit(False))


def rewrite_status(output: Column, matches: Column, error: Column, finish: Column, rewrite: Column, reason: Column) -> Column:
    """The first that holds: dropped, kept_short_circuit, gemini_error, gemini_incomplete, kept_by_gemini, filtered, rewritten."""
    route = rewrite_route(output, matches)
    return (
        F.when(route != "rewrite", route).when(error.isNotNull(), "gemini_error").when(finish != "STOP", F.concat(F.lit("gemini_incomplete:"), finish))
        .when(text.strip(rewrite) == text.strip(output), "kept_by_gemini").when(reason.isNotNull(), F.concat(F.lit("filtered:"), reason)).otherwise("rewritten")
    )


def rewritten_rows(rows: DataFrame) -> DataFrame:
    """Rows (input, output, rewrite, rewrite_status, error) as they are kept: the original unless rewritten, and errors cut to 200 characters."""
    done = F.col("rewrite_status") == "rewritten"
    return rows.withColumns({"original_output": F.col("output"), "output": F.when(done, F.col("rewrite")).otherwise(F.col("output")), "_error": F.when(F.col("rewrite_status") == "gemini_error", F.substring("error", 1, 200))}).drop("error", "rewrite")


def traced_rows(rows: DataFrame) -> DataFrame:
    """Rows (output, think, draft, final, error, trace_status) as they are kept, with the audit columns of their status."""
    ok, status = F.col("trace_status") == "trace_generated", F.col("trace_status")
    audit = status.startswith("schema_invalid") | status.startswith("filtered")
    called = ~status.isin("skipped_junk", "gemini_error")
    return rows.withColumns({
        "v3_output": F.col("output"), "output": F.when(ok, text.trace_target(F.col("think"), F.col("final"))).otherwise(F.col("output")), "review_only": F.when(ok, F.col("final")).otherwise(F.col("output")),
        "think_only": F.when(ok, F.col("think")).otherwise(""), "draft_review": F.when(called, F.col("draft")).otherwise(""), "_filtered_think": F.when(audit, F.col("think")), "_filtered_review": F.when(audit, F.col("final")),
        "_error": F.when(status == "gemini_error", F.substring("error", 1, 200)),
    }).drop("think", "draft", "final", "error")


def resumed(prior: DataFrame, key: str, done: Column) -> tuple[DataFrame, DataFrame, bool]:
    """(rows to keep, keys that are done, whether any row is to be dropped) of earlier results; done: rows that need no other try."""
    kept = prior.where(F.coalesce(done, F.lit(False)))
    lost = prior.where(~F.coalesce(done, F.lit(False))).limit(1).count() > 0
    return kept, kept.where(F.col(key).isNotNull()).select(key).distinct(), lost


def answered(prediction: Column) -> Column:
    """An empty answer isn't done."""
    return text.strip(F.coalesce(prediction, F.lit(""))) != ""


def reference_tail(rows: DataFrame, order: str, body: str = "input", n: int = 500) -> DataFrame:
    """The texts that the last n rows hold, empty ones dropped after the cut (a top-k)."""
    return rows.orderBy(F.desc(order)).limit(n).where(F.coalesce(body, F.lit("")) != "").select(F.col(body).alias("text"))


def sft_ready(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("trace_status") == "trace_generated")


def pattern_tasks(patterns: DataFrame, n_per_pattern: int, factor: float = 1.4) -> DataFrame:
    """patterns with the seeds to try for each: more than needed, as some answers are copies or fail."""
    return patterns.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(int(n_per_pattern * factor) + 1))))


def generated_rows(answers: DataFrame, references: DataFrame, n_per_pattern: int) -> DataFrame:
    """Training rows of answers (pattern, seed, diff, review), n a pattern by seed, without near copies of the references."""
    fresh = rouge.without_near(answers.where("diff is not null and review is not null"), "diff", references)
    kept = cap_per_group(fresh, "pattern", "seed", n_per_pattern)
    return kept.select(F.lit("Review this code change.").alias("instruction"), F.col("diff").alias("input"), F.col("review").alias("output"), F.concat(F.lit("synthetic/"), "pattern").alias("repo"))


def merge_kept(rewritten: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Rows that weren't dropped (a missing status is kept) with defaults for what they lack, and all synthetic ones."""
    core = ["instruction", "input", "output", "repo"]
    kept = rewritten.where(~F.col("rewrite_status").eqNullSafe("dropped"))
    kept = kept.withColumns({"instruction": F.coalesce("instruction", F.lit("Review this code change.")), "repo": F.coalesce("repo", F.lit(""))})
    return kept.select(core).unionByName(synthetic.select(core))


#: Indices that the driver may shuffle or draw from; a larger table has hash_split.
SEEDED_ROWS = 10_000_000


def _indices(n: int) -> list[int]:
    if n > SEEDED_ROWS:
        raise ValueError(f"more than {SEEDED_ROWS} indices: seeded draws are sequential; use hash_split")
    return list(range(n))


def sample_indices(n: int, k: int, seed: int) -> list[int]:
    """k of 0..n-1 as Python's seeded sample draws them; all in drawn order for k of n or more."""
    return random.Random(seed).sample(_indices(n), min(k, n))


def head_of_shuffle(n: int, k: int, seed: int = 42) -> list[int]:
    """The first k of the shuffled indices, sorted: an evaluation set, and what training must leave out."""
    order = _indices(n)
    random.Random(seed).shuffle(order)
    return sorted(order[:k])


def at_indices(rows: DataFrame, index: str, chosen: list[int], how: str = "left_semi") -> DataFrame:
    """Rows at the chosen indices, or with left_anti all others."""
    ids = rows.sparkSession.createDataFrame([(i,) for i in chosen], "_i long")
    return rows.join(F.broadcast(ids) if len(chosen) <= 1_000_000 else ids, rows[index] == F.col("_i"), how)


def quick_sample(rows: DataFrame, index: str, seed: int = 42, synthetic: int = 10, regular: int = 40) -> DataFrame:
    """The first synthetic rows by index and the head of the shuffled others, in the shuffled order of both (place)."""
    own = F.coalesce("repo", F.lit("")).startswith("synthetic/")
    first = [r[0] for r in rows.where(own).select(index).orderBy(index).limit(synthetic).collect()]
    others = [r[0] for r in rows.where(~own).select(index).orderBy(index).limit(SEEDED_ROWS).collect()]
    rng = random.Random(seed)
    rng.shuffle(others)
    chosen = (first + others[:regular])[: synthetic + regular]
    rng.shuffle(chosen)
    places = rows.sparkSession.createDataFrame(list(enumerate(chosen)), f"place int, {index} long")
    return rows.join(F.broadcast(places), index)


def two_samples(a: list, b: list, k: tuple[int, int] = (8, 6), seed: int = 0) -> tuple[list, list]:
    """Samples of two lists from one seeded stream, the first list first."""
    rng = random.Random(seed)
    return rng.sample(a, min(k[0], len(a))), rng.sample(b, min(k[1], len(b)))


def cap_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def seeded_split(rows: DataFrame, index: str, n: int, seed: int = 42, share: float = 0.2) -> DataFrame:
    """split = eval for the first floor(n * share) of the shuffled indices 0..n-1; at most SEEDED_ROWS, hash_split has no bound."""
    order = _indices(n)
    random.Random(seed).shuffle(order)
    chosen = rows.sparkSession.createDataFrame([(i,) for i in order[: int(n * share)]] or [(-1,)], "_i long")
    few = n * share <= 1_000_000
    return rows.join(F.broadcast(chosen) if few else chosen, rows[index] == chosen["_i"], "left").withColumn("split", F.when(F.col("_i").isNull(), "train").otherwise("eval")).drop("_i")


def swapped(key: Column, seed: int = 0) -> Column:
    """Whether a judge sees the sides swapped: half the keys, by hash, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 1


def hash_split(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """A split by a hash of the key: stable for any number of rows and partitions."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return rows.withColumn("split", F.when(bucket < int(1000 * share), "eval").otherwise("train"))


def prompt_caps(first: int = 12000, factor: float = 0.7, least: int = 200) -> list[int]:
    """Falling lengths to try for a prompt that must fit a budget."""
    out, n = [], first
    while n >= least:
        out.append(n)
        n = int(n * factor)
    return out


SYSTEM = "You are a Senior Software Engineer reviewing code changes. Provide clear, actionable feedback."
REQUESTS = {"review": "Review the following code diff and provide feedback:\n```diff\n", "short": "Review this code diff:\n```diff\n"}


def chat_text(diff: Column, answer: Column | None = None, shots: tuple[tuple[str, str], ...] = (), request: str = "review", cut: int = 3000) -> Column:
    """System, shots, the fenced diff cut to its first characters, and the answer or the start of one, as marked turns."""
    turn = lambda role, body: [F.lit(f"<|im_start|>{role}\n"), body, F.lit("<|im_end|>\n")]
    ask = lambda d: F.concat(F.lit(REQUESTS[request]), d, F.lit("\n```"))
    parts = turn("system", F.lit(SYSTEM))
    for shown, said in shots:
        parts += turn("user", ask(F.lit(shown))) + turn("assistant", F.lit(said))
    parts += turn("user", ask(F.substring(diff, 1, cut)))
    parts += turn("assistant", answer)[:2] + [F.lit("<|im_end|>")] if answer is not None else [F.lit("<|im_start|>assistant\n")]
    return F.concat(*parts)


def budgeted(diff: Column, tokens_of, budget: int) -> Column:
    """The longest prefix, of the falling lengths, whose prompt fits the budget; else the shortest."""
    caps = F.array(*map(F.lit, prompt_caps()))
    fit = F.filter(caps, lambda n: tokens_of(F.substr(diff, F.lit(1), n)) <= budget)
    return F.substr(diff, F.lit(1), F.when(F.size(fit) > 0, F.try_element_at(fit, F.lit(1))).otherwise(F.element_at(caps, -1)))
