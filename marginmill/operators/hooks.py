"""Injection points for external functions: matchers, counters, classifiers, judges, generators, tokenizers.

Each takes a plain Python function and runs it in Arrow batches on the executors. Rows that need no
call are filtered away before the function and joined by a union after it, or come as nulls that are
passed over: a condition around the call would not keep Spark from making it. A failing call fails its task, after retries; no default is
put in its place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reward, text
from . import curate, overlap, stats


def with_retries(call: Callable, attempts: int = 5, base_delay: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after 2, 4, 8, 16 seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base_delay * 2**k)


def says(review: str, defect: dict) -> bool:
    """A deterministic matcher: the review names the defect's path or its type."""
    low = review.lower()
    return bool(defect.get("path")) and defect["path"].lower() in low or bool(defect.get("issue_type")) and defect["issue_type"].lower() in low


def counts(review: str) -> int:
    """A deterministic counter: ticked names."""
    return review.count("`") // 2


def _blank(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))) == ""


def caught(rows: DataFrame, key: str, review: str, match_fn: Callable[[str, dict], bool] = says) -> DataFrame:
    """rows (defects) with caught: how many of the defects the review names. Blank reviews and rows without defects make no call."""

    @F.arrow_udf("long")
    def run(reviews: pa.Array, defects: pa.Array) -> pa.Array:
        return pa.array([sum(bool(match_fn(r, d)) for d in found) if found and r is not None else 0 for r, found in zip(reviews.to_pylist(), defects.to_pylist(), strict=True)], pa.int64())

    asked = ~_blank(F.col(review)) & (F.size("defects") > 0)
    return rows.withColumn("caught", run(F.when(asked, F.col(review)), F.when(asked, F.col("defects"))))


def claims(rows: DataFrame, review: str, count_fn: Callable[[str], int] = counts) -> DataFrame:
    """rows with claims: what the counter says of the review; 0 and no call for blank ones."""
    run = F.arrow_udf(lambda r: pa.array([0 if x is None else int(count_fn(x)) for x in r.to_pylist()], pa.int64()), "long")
    return rows.withColumn("claims", run(F.when(~_blank(F.col(review)), F.col(review))))


def recall(caught_: Column, n_defects: Column) -> Column:
    """Undefined, and an error, without defects."""
    return F.when(n_defects > 0, caught_ / F.nullif(n_defects, F.lit(0))).otherwise(F.raise_error(F.lit("recall over no defects is undefined")).cast("double"))


def scored(preds: DataFrame, labels: DataFrame, key: str, review: str, match_fn=says, count_fn=counts, stop: list[str] | None = None) -> DataFrame:
    """Predictions (key, review, diff) with labels' defects (none: clean) as n_defects, caught, claims, recall, precision, fp_rate, halluc, reward."""
    stop = list(text.SMALL_STOP) if stop is None else stop
    df = preds.join(labels.select(key, "defects"), key, "left").withColumn("defects", F.coalesce("defects", F.array().cast(labels.schema["defects"].dataType)))
    df = claims(caught(df, key, review, match_fn), review, count_fn).withColumn("n_defects", F.size("defects"))
    grounding = reward.grounding(F.coalesce(review, F.lit("")), F.coalesce("diff", F.lit("")), stop)
    parts = reward.components(F.col("n_defects"), F.col("caught"), F.col("claims"), grounding, F.coalesce(review, F.lit("")))
    return df.withColumn("halluc", 1 - grounding).withColumns(parts)


def rewards(completions: DataFrame, labels: DataFrame, key: str, raw: str, match_fn=says, count_fn=counts, stop: list[str] | None = None) -> DataFrame:
    """Completions (key and rollout unique together, raw, diff) with their reward: the review is extracted, and failures of format have none."""
    df = completions.withColumn("_id", F.concat_ws("\x00", F.col(key).cast("string"), F.col("rollout").cast("string"))).withColumn("_review", reward.extracted(F.coalesce(raw, F.lit(""))))
    own = df.select("_id", key).join(labels.select(key, "defects"), key).select("_id", "defects")
    out = scored(df, own, "_id", "_review", match_fn, count_fn, stop)
    return out.withColumn("reward", F.when(F.col("_review") == "", 0.0).otherwise(F.col("reward"))).drop("_id", "_review")


def labelled(rows: DataFrame, classify: Callable[[str, dict], dict | None], key: str = "instance_id") -> DataFrame:
    """Defect labels of rows (key, diff, reference_comments): comments that don't stand in the diff are counted, others classified.

    A diff goes to the workers once, with all its comments.
    """
    kind = pa.list_(pa.struct([("path", pa.string()), ("line", pa.int32()), ("issue_type", pa.string()), ("canonical_desc", pa.string())]))

    @F.arrow_udf("array<struct<path: string, line: int, issue_type: string, canonical_desc: string>>")
    def run(diffs: pa.Array, notes: pa.Array) -> pa.Array:
        out = []
        for d, own in zip(diffs.to_pylist(), notes.to_pylist(), strict=True):
            found = ((n, classify(d, n) or {}) for n in own or ())
            out.append([{"path": n["path"], "line": n["line"], "issue_type": f["issue_type"], "canonical_desc": f["canonical_desc"]} for n, f in found if f.get("issue_type") and f.get("canonical_desc")])
        return pa.array(out, kind)

    split = curate.grounded(rows)
    return split.select(key, run(F.when(F.size("grounded") > 0, F.col("diff")), "grounded").alias("defects"), "n_ungrounded")


def generated(rows: DataFrame, review_fn: Callable[[str, int], str], column: str, budget: int = 6000) -> DataFrame:
    """rows (diff) with a column of reviews; an empty answer is asked for once more with twice the budget."""

    def one(diff):
        out = review_fn(diff or "", budget)
        return out if (out or "").strip() else review_fn(diff or "", 2 * budget)

    return rows.withColumn(column, F.pandas_udf(lambda d: d.map(one), "string")("diff"))


def traced(rows: DataFrame, first: Callable[[str], dict], second: Callable[[str, str, str], dict], stop: list[str] | None = None, cut: int = 3000) -> DataFrame:
    """Rows (input, output, rewrite_status) through two calls, filters and routing.

    first(diff) and second(diff, draft, review) answer with text, thought and finish, or error. Junk makes no
    call, and a first answer that is cut off or empty no second one.
    """
    stop = list(text.SMALL_STOP) if stop is None else stop
    names = text.names_changed(F.col("input"), stop)
    junk = F.coalesce(F.col("rewrite_status") == "dropped", F.lit(False)) | (F.length(text.strip(F.coalesce("output", F.lit("")))) < 20)
    answer = "text string, thought string, finish string, error string"

    def ask(call):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                got = []
                for args in df.itertuples(index=False, name=None):
                    try:
                        got.append(call(*args))
                    except Exception as e:
                        got.append({"error": str(e)})
                yield pd.DataFrame([{k: g.get(k) for k in ("text", "thought", "finish", "error")} for g in got])

        return F.pandas_udf(lambda *cols: next(run(iter([pd.concat(cols, axis=1)]))), answer)

    rows = rows.withColumn("_id", F.xxhash64(*rows.columns)).withColumn("_cut", F.substring("input", 1, cut))
    one = rows.where(~junk).withColumn("_one", ask(first)("_cut"))
    parts = text.thought_and_draft(F.col("_one.thought"), F.col("_one.text"))
    one = one.withColumns({"think": parts["think"], "draft": parts["draft"], "_stop": F.when(F.col("_one.error").isNull(), F.coalesce(F.nullif(text.finish_reason(F.col("_one.finish")), F.lit("")), F.lit("UNKNOWN")))})
    go = F.col("_one.error").isNull() & (F.col("_stop") == "STOP") & (F.col("draft") != "")
    none = F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ': ') for x in answer.split(', '))}>")
    two = one.where(go).withColumn("_two", ask(second)("_cut", "draft", "output")).unionByName(one.where(~go).withColumn("_two", none))
    blank = {c: F.lit("") for c in ("think", "draft")} | {"_stop": F.lit("STOP"), "_one": none, "_two": none}
    df = two.unionByName(rows.where(junk).withColumns(blank).select(two.columns))
    body = F.coalesce("_two.text", F.lit(""))
    last = F.coalesce(F.nullif(text.finish_reason(F.col("_two.finish")), F.lit("")), F.when(F.col("_two").isNull(), "STOP").otherwise("UNKNOWN"))
    recon = text.reconciliation(body)
    df = df.withColumns({"final": text.strip(F.regexp_extract(body, "(?is)<review>(.*?)</review>", 1)), "recon_label": recon["label"], "recon_text": recon["text"], "error": F.coalesce("_one.error", "_two.error"), "_stop": F.when(last != "STOP", last).otherwise(F.col("_stop"))})
    missing = F.array_compact(F.array(*(F.when(F.col(c) == "", m) for c, m in (("think", "no_think"), ("draft", "no_draft"), ("final", "no_final_review")))))
    reason = curate.trace_reason(F.col("think"), F.col("final"), F.col("output"), F.col("input"), names, stop)
    df = df.withColumn("trace_status", curate.trace_status(F.coalesce(F.col("rewrite_status") == "dropped", F.lit(False)), F.coalesce("output", F.lit("")), F.col("error"), F.col("_stop"), missing, reason))
    return curate.traced_rows(df.drop("_id", "_cut", "_one", "_two", "_stop"))


JUDGES: dict[str, tuple[Callable[[str, str, str, str], str], int]] = {}


def register_judge(name: str, fn: Callable[[str, str, str, str], str], votes: int = 1) -> None:
    """A judge by name: fn(first, second, diff, reference) answers in text; votes: 1, or the majority of 3."""
    JUDGES[name] = (fn, votes)


def judged(rows: DataFrame, name: str, key: str, a: str = "v4_pred", b: str = "base_pred") -> DataFrame:
    """rows with verdict A, B or TIE; the sides are swapped for half of the keys and votes, and swapped back."""
    if name not in JUDGES:
        raise ValueError(f"unknown judge: {name!r} (expected: {', '.join(sorted(JUDGES))})")
    fn, votes = JUDGES[name]
    call = F.pandas_udf(lambda x, y, d, r: pd.Series([fn(*v) for v in zip(x, y, d, r, strict=True)], dtype=object), "string")
    reference = F.coalesce("reference_text", F.lit("")) if "reference_text" in rows.columns else F.lit("")
    diff = F.coalesce("diff", F.lit("")) if "diff" in rows.columns else F.lit("")
    df = rows
    for k in range(votes):
        flip = curate.swapped(F.col(key), k)
        df = df.withColumn(f"_x{k}", F.when(flip, F.col(b)).otherwise(F.col(a))).withColumn(f"_y{k}", F.when(flip, F.col(a)).otherwise(F.col(b)))
        df = df.withColumn(f"_v{k}", text.pairwise_verdict(call(f"_x{k}", f"_y{k}", diff, reference), flip))
    verdict = stats.majority(F.array(*(F.col(f"_v{k}") for k in range(votes)))) if votes > 1 else F.col("_v0")
    return df.withColumn("verdict", verdict).drop(*(f"_{c}{k}" for c in "xyv" for k in range(votes)))


def rated(rows: DataFrame, review: str, score_fn: Callable[[str, str], str]) -> DataFrame:
    """rows (diff) with a score from 0 to 10: 0 and no call for reviews under 20 characters, 5 for answers without a number."""
    call = F.pandas_udf(lambda r, d: pd.Series([score_fn(x, y) for x, y in zip(r, d, strict=True)], dtype=object), "string")
    short = F.length(text.strip(F.coalesce(review, F.lit("")))) < text.SHORT_REVIEW
    asked = rows.where(~short).withColumn("score", text.judge_score(call(review, "diff")))
    return asked.unionByName(rows.where(short).withColumn("score", F.lit(0)))


def claims_bug(rows: DataFrame, review: str, ask_fn: Callable[[str, str], str]) -> DataFrame:
    """rows (diff) with claims_bug: YES, NO or UNKNOWN, and EMPTY without a call for short reviews."""
    call = F.pandas_udf(lambda r, d: pd.Series([ask_fn(x, y) for x, y in zip(r, d, strict=True)], dtype=object), "string")
    short = F.length(text.strip(F.coalesce(review, F.lit("")))) < text.SHORT_REVIEW
    up = lambda c: F.when(F.contains(F.upper(c), F.lit("YES")), "YES").when(F.contains(F.upper(c), F.lit("NO")), "NO").otherwise("UNKNOWN")
    return rows.where(~short).withColumn("claims_bug", up(call(F.substring(review, 1, 600), F.col("diff")))).unionByName(rows.where(short).withColumn("claims_bug", F.lit("EMPTY")))


def by_bucket(rows: DataFrame, bucket: str, metric: Callable[[Column, Column], Column] = overlap.iou_lenient) -> DataFrame:
    """Mean of a metric over (locs, labels) by bucket; a missing one is unknown."""
    return rows.groupBy(F.coalesce(bucket, F.lit("unknown")).alias("bucket")).agg(F.round(F.avg(metric(F.col("locs"), F.col("labels"))), 6).alias("mean"))


def token_counts(body: Column, encode: Callable[[str], list]) -> Column:
    """Numbers of tokens by an injected tokenizer."""
    return F.pandas_udf(lambda s: s.map(lambda x: len(encode(x or ""))), "long")(body)


def within_tokens(rows: DataFrame, body: Column, encode: Callable[[str], list], most: int = 6000) -> DataFrame:
    return rows.withColumn("_n", token_counts(body, encode)).where(F.col("_n") <= most).drop("_n")


def fitting_prompts(rows: DataFrame, diff: str, encode: Callable[[str], list], budget: int = 3996) -> DataFrame:
    """rows with prompt: the longest of the falling cuts of the diff whose whole prompt fits the budget, else the shortest."""
    caps = curate.prompt_caps()

    def fit(s: pd.Series) -> pd.Series:
        def one(x):
            for n in caps:
                out = f"<|im_start|>system\n{curate.SYSTEM}<|im_end|>\n<|im_start|>user\n{curate.REQUESTS['review']}{(x or '')[:n]}\n```<|im_end|>\n<|im_start|>assistant\n"
                if len(encode(out)) <= budget:
                    break
            return out

        return s.map(one)

    return rows.withColumn("prompt", F.pandas_udf(fit, "string")(diff))
