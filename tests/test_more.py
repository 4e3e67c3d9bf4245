"""Seeded draws, injected functions, sources and guards, against their definitions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginmill.functions import reward, text
from marginmill.operators import curate, hooks, reports, rouge, stats, stemmer
from marginmill.sources import jsonl


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_paired_bootstrap_is_one_stream(spark):
    """recall, then fp_rate, then halluc from one seeded stream; an empty vector has nulls and takes no draws."""
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.random()) if i % 2 else None, None, float(rng.random())) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, recall double, fp_rate double, halluc double")
    got = {r.metric: r for r in stats.paired_bootstrap(df.repartition(5), "k", seed=3, rounds=60).collect()}
    state = np.random.RandomState(3)
    for m, at in (("recall", 1), ("halluc", 3)):
        v = np.array([r[at] for r in rows if r[at] is not None])
        means = [v[state.randint(0, len(v), len(v))].mean() for _ in range(60)]
        assert (got[m].mean, got[m].low, got[m].high) == pytest.approx((v.mean(), *np.percentile(means, [2.5, 97.5])))
    assert got["fp_rate"].mean is None and got["fp_rate"].low is None


def test_paired_report(spark):
    a = [(i, 1 if i % 2 else 0, 0.25 if i % 2 else None, None, None if i % 2 else 1.0, 0.5) for i in range(60)]
    b = [(i, 1 if i % 2 else 0, 1.0 if i % 2 else None, None, None if i % 2 else 0.0, 0.5) for i in range(5, 70)]
    kind = "id int, n_defects int, recall double, precision double, fp_rate double, halluc double"
    d = stats.paired_deltas(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "id")
    r = stats.ships(stats.paired_report(d, stats.paired_bootstrap(d, "id", rounds=50))).first()
    assert (r.n_compared, r.recall_delta, r.recall_significant, r.fp_significant, r.halluc_significant, r.ship) == (55, 0.75, True, True, False, True)
    empty = d.where("n_defects > 5")
    r = stats.ships(stats.paired_report(empty, stats.paired_bootstrap(empty, "id", rounds=5))).first()
    assert r.n_compared == 0 and r.recall_delta is None and not r.recall_significant


def test_win_rate(spark):
    v = ["A"] * 30 + ["B"] * 50 + ["TIE"] * 20
    random.Random(2).shuffle(v)
    got = stats.win_rate(spark.createDataFrame(list(enumerate(v)), "k int, verdict string").repartition(4), "k", rounds=80).first()
    hit, rng = np.array([x == "A" for x in v], float), np.random.default_rng(42)
    draws = [hit[rng.integers(0, 100, 100)].mean() for _ in range(80)]
    assert tuple(got) == pytest.approx((0.3, *np.percentile(draws, [2.5, 97.5])))
    assert tuple(stats.win_rate(spark.createDataFrame([], "k int, verdict string"), "k").first()) == (0, 0, 0)


def test_seeded_samples(spark):
    assert curate.sample_indices(1000, 50, 42) == random.Random(42).sample(range(1000), 50)
    order = list(range(300))
    random.Random(42).shuffle(order)
    assert curate.head_of_shuffle(300, 20) == sorted(order[:20])
    rows = spark.range(300).withColumnRenamed("id", "i")
    assert sorted(r.i for r in curate.at_indices(rows, "i", order[:20], "left_anti").collect()) == sorted(order[20:])
    rng = random.Random(0)
    assert curate.two_samples(list(range(40)), list(range(9))) == (rng.sample(list(range(40)), 8), rng.sample(list(range(9)), 6))
    mixed = spark.range(120).select(F.col("id").alias("i"), F.when(F.col("id") % 6 == 0, "synthetic/x").otherwise("a/b").alias("repo"))
    got = [r.i for r in curate.quick_sample(mixed, "i").orderBy("place").collect()]
    rng = random.Random(42)
    regular = [i for i in range(120) if i % 6]
    rng.shuffle(regular)
    want = [i for i in range(120) if not i % 6][:10] + regular[:40]
    rng.shuffle(want)
    assert got == want
    with pytest.raises(ValueError):
        curate.sample_indices(curate.SEEDED_ROWS + 1, 1, 1)
    half = rows.select(F.avg(curate.swapped(F.col("i")).cast("int"))).first()[0]
    assert 0.35 < half < 0.65


def test_retries():
    calls, waits = [], []

    def fails(n):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise OSError("again")
            return len(calls)

        return call

    assert hooks.with_retries(fails(3), sleep=waits.append) == 4 and waits == [2, 4, 8]
    calls.clear()
    with pytest.raises(OSError):
        hooks.with_retries(fails(9), attempts=2, sleep=waits.append)


def test_no_needless_calls(spark):
    """Blank reviews, rows without defects and junk make no call: a call on one would fail the task."""

    def match(review, defect):
        assert review.strip()
        return True

    rows = spark.createDataFrame([(1, " \n", [("a.py",)]), (2, "text", []), (3, "text", [("a.py",), ("b.py",)])], "id int, review string, defects array<struct<path: string>>")
    assert {r.id: r.caught for r in hooks.caught(rows, "id", "review", match).collect()} == {1: 0, 2: 0, 3: 2}
    assert one(spark, hooks.recall(F.lit(1), F.lit(2))) == 0.5
    with pytest.raises(Exception, match="undefined"):
        one(spark, hooks.recall(F.lit(0), F.lit(0)))
    with pytest.raises(ValueError, match="unknown judge"):
        hooks.judged(rows, "nobody", "id")


def test_must_match(spark):
    rows, cache = spark.createDataFrame([("a",), ("b",)], "instance_id string"), spark.createDataFrame([("a", "x")], "instance_id string, base_output string")
    assert jsonl.base_samples(rows.limit(1), cache).first().base_output == "x"
    with pytest.raises(Exception, match="no cached base sample for b"):
        jsonl.base_samples(rows, cache).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"instance_id": "1", "base_output": "x"}\n{"instance')
    with pytest.raises(Exception):
        jsonl.strict(spark, str(tmp_path / "bad.jsonl"), "base_samples").collect()
    for step in (9, 100, 20):
        (tmp_path / "run" / f"checkpoint-{step}").mkdir(parents=True)
    (tmp_path / "run" / "other").mkdir()
    assert [s for s, _ in jsonl.checkpoints(spark, str(tmp_path / "run"))] == [9, 20, 100]
    model = tmp_path / "model"
    model.mkdir()
    assert not jsonl.shards_whole(spark, str(model))
    (model / "model.safetensors.index.json").write_text(json.dumps({"metadata": {"total_size": 30}}))
    for k, n in enumerate((10, 19)):
        (model / f"m-{k}.safetensors").write_bytes(b"x" * n)
    assert not jsonl.shards_whole(spark, str(model))
    (model / "m-2.safetensors").write_bytes(b"x")
    assert jsonl.shards_whole(spark, str(model))
    (tmp_path / "out.jsonl").write_text("".join(json.dumps({"output": f"<review> r{i} </review>", "other": i}) + "\n" for i in range(40)))
    got = jsonl.probed(spark, [str(tmp_path / "none.jsonl"), str(tmp_path / "out.jsonl")]).collect()
    assert len(got) == 20 and all(r.review.startswith("r") for r in got) and jsonl.probed(spark, [str(tmp_path / "none.jsonl")]) is None
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") % 2 == 0, "trace_generated").otherwise("x").alias("s"))
    seen = [r.id for r in jsonl.viewed(rows, "s", "trace_generated", "id", 5).collect()]
    assert len(seen) == 5 and all(i % 2 == 0 for i in seen) and seen == [r.id for r in jsonl.viewed(rows.repartition(7), "s", "trace_generated", "id", 5).collect()]
    with pytest.raises(ValueError, match="unknown split"):
        jsonl.source_split(spark, str(tmp_path), "train")
    raw = {"instance_id": "1", "repo": "o/r", "commit_to_review": {"patch_to_review": "d"}, "reference_review_comments": [{"text": "t", "path": "p", "line": None, "original_line": 42}], "metadata": {"difficulty": "low"}}
    (tmp_path / "dev.jsonl").write_text(json.dumps(raw) + "\n")
    row = curate.load_and_filter(jsonl.source_split(spark, str(tmp_path), "dev"), curate.trained_repos(None, spark)).first()
    assert row.reference_comments[0].line == 42 and row.difficulty == "low" and row.problem_domain == "unknown"
    assert curate.load_and_filter(jsonl.source_split(spark, str(tmp_path), "dev"), spark.createDataFrame([("x/R",)], "repo string")).count() == 0


def test_compaction_leaves_clean_output_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    done = lambda: ~curate.transient(F.col("trace_status"))
    jsonl.overwrite(spark.createDataFrame([(1, "a", "trace_generated"), (2, "b", "gemini_error")], "_idx long, output string, trace_status string"), path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [r[0] for r in jsonl.compact(spark, path, "traces", "_idx", done).collect()] == [1]
    after = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert before != after and jsonl.tolerant(spark, path, "traces").count() == 1 and not (tmp_path / "out.new").exists()
    jsonl.compact(spark, path, "traces", "_idx", done)
    assert after == sorted(p.name for p in (tmp_path / "out").iterdir())
    assert jsonl.compact(spark, str(tmp_path / "none"), "traces", "_idx", done).count() == 0


def test_stemmer():
    # results that the algorithm's description gives
    want = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die"}
    assert {w: stemmer.stem(w) for w in want} == want


def test_guards(spark):
    assert one(spark, reward.guarded(F.lit("<think>a</think><review>...</review>"), F.lit(1.0))) == 0.0
    assert one(spark, reward.guarded(F.lit("<think>a</think><review>ok</review>"), F.lit(1.0))) == 1.0
    assert one(spark, reward.grounding(F.lit("`fake`"), F.lit("@@ -1 +1 @@\n+real"), text.SMALL_STOP)) == 0.0
    assert one(spark, text.says_clean(F.lit("Looks GOOD to me"))) and one(spark, text.is_quiet(F.lit("no major issues here"))) and not one(spark, text.is_quiet(F.lit("a bug")))
    assert one(spark, text.base_review(F.lit(" raw "))) == "raw" and one(spark, text.interval_text(F.lit(-0.5), F.lit(None).cast("double"))) == "[-0.5000, n/a]"
    rows = spark.createDataFrame([("no names",), ("nor here",)], "review string")
    assert reports.preflight(rows, "review").first().verdict == "FAIL"
    assert reports.missing_fields(curate.flatten_rows(spark.read.schema(jsonl.RAW).json(spark.sparkContext.parallelize([]))).schema, {"instance_id": "string", "reference_comments.path": "string", "nothing": "int"}) == ["nothing"]
    with pytest.raises(ValueError, match="2 rows, 3 are needed"):
        reports.require(rows, 3, "reviews")
    with pytest.raises(ValueError):
        rouge.without_near(rows, "review", spark.range(501).select(F.col("id").cast("string").alias("text")))
    steps = spark.createDataFrame([(1, 0.5, 0.2, 0.1), (2, 0.7, 0.9, 0.1), (3, 0.5, 0.1, 0.1), (4, None, None, 0.1)], "step int, recall double, fp_rate double, halluc double")
    assert reports.best_checkpoint(steps, 0.2, 0.1).first().step == 1 and [r.beats for r in reports.beats(steps, 0.4, 0.2, 0.1).orderBy("step").collect()] == [True, False, True, False]


def test_salvage(spark):
    got = lambda x: tuple(one(spark, text.salvaged(F.lit(x))))
    assert got("<think>x\nConclusion: this loop never ends at all\n</think>") == (2, "this loop never ends at all")
    assert got("short") == (4, "short") and got("y" * 400) == (3, "y" * 400) and got("<think>" + "z" * 400) == (4, "z" * 300)


def test_lines_and_hunks(spark):
    """Lines as Python splits them; names from the first hunk header on, with odd line ends."""
    bodies = ["", "a", "a\n", "\n", "a\n\n", "a\r\nb\rc\x0bd\u2028e\x85f", "\r\n", "x\n\r\ny\n"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", text.split_lines(F.col("b")).alias("l"))
    assert all(r.l == r.b.splitlines() for r in df.collect())
    names = lambda d: sorted(one(spark, text.names_in_hunks(F.lit(d))))
    assert names("--- a/x\n+++ b/y\nnot_in @@ here\n") == [] and names("@@ -1 @@ top\r\n+added\r\n--- gone\r\n context\nother") == ["added", "context", "top"]
    assert names("pre\n@@ one\n@@ two\n-minus_name") == ["minus_name", "one", "two"] and names(None) == []


def test_rewritten_rows(spark):
    rows = spark.createDataFrame([("o", "new", "rewritten", None), ("o", "new", "filtered:x", None), ("o", None, "gemini_error", "e" * 300)], "output string, rewrite string, rewrite_status string, error string")
    got = {r.rewrite_status: r for r in curate.rewritten_rows(rows).collect()}
    assert got["rewritten"].output == "new" and got["filtered:x"].output == "o" and all(r.original_output == "o" for r in got.values())
    assert len(got["gemini_error"]._error) == 200 and got["rewritten"]._error is None


def test_running_status_counts(spark, tmp_path):
    from marginmill.streaming import resume

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"status": s}) + "\n" for s in ("filtered:x", "filtered:y", "ok")))
    counts = resume.status_counts(spark, str(tmp_path / "in"), "status string", text.status_family)
    query = counts.writeStream.outputMode("complete").format("memory").queryName("family_counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["family"]: r["count"] for r in spark.table("family_counts").collect()} == {"filtered": 2, "ok": 1}
