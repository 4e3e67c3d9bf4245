"""Hand-computed cases of the review operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginmill.functions import reward, text
from marginmill.operators import curate, overlap, rouge, stats
from marginmill.sources import jsonl
from marginmill.streaming import resume


def one(spark, expr, **values):
    return spark.range(1).select(expr).first()[0]


def test_locations(spark):
    got = one(spark, text.locations(F.lit("see `src/api/auth.py:100` and `App.tsx` and `user` and `user` and `ab`")))
    assert [(x.file, x.line, x.identifier) for x in got] == [("src/api/auth.py", 100, None), ("App.tsx", None, None), (None, None, "user")]
    assert one(spark, text.locations(F.lit(None).cast("string"))) == []


LABEL = "array<struct<path: string, line: int, text: string>>"
LOC = "array<struct<file: string, line: int, identifier: string>>"


@pytest.mark.parametrize(
    "locs,labels,strict,lenient,hits",
    [
        ("array(named_struct('file','a.py','line',5,'identifier',null))", "array(named_struct('path','a.py','line',5,'text',''))", 1.0, 1.0, 1.0),
        ("array(named_struct('file','a.py','line',5,'identifier',null))", "array(named_struct('path','a.py','line',8,'text',''))", 0.0, 1.0, 1.0),
        ("array(named_struct('file','a.py','line',5,'identifier',null))", "array(named_struct('path','a.py','line',14,'text',''))", 0.0, 0.0, 0.0),
        ("array(named_struct('file',null,'line',null,'identifier','err'))", "array(named_struct('path','b.py','line',1,'text','an error'))", 0.0, 0.0, 0.0),
        ("array()", "array()", 1.0, 1.0, 1.0),
        ("array()", "array(named_struct('path','a.py','line',5,'text',''))", 0.0, 0.0, 0.0),
    ],
)
def test_overlap(spark, locs, labels, strict, lenient, hits):
    df = spark.sql(f"select cast({locs} as {LOC}) as p, cast({labels} as {LABEL}) as q")
    got = df.select(overlap.iou_strict(F.col("p"), F.col("q")), overlap.iou_lenient(F.col("p"), F.col("q")), overlap.hit_rate(F.col("p"), F.col("q"))).first()
    assert tuple(got) == (strict, lenient, hits)


def test_length_score(spark):
    for n, want in ((0, 0), (75, 0.5), (150, 1), (1000, 1), (1750, 0.5), (2500, 0), (5000, 0)):
        assert one(spark, reward.length_score(F.lit("x" * n))) == pytest.approx(want)


@pytest.mark.parametrize("defects,caught,claims,want", [(2, 2, 2, 1.0), (2, 2, 6, 0.7714), (2, 0, 2, 0.4), (0, 0, 0, 1.0), (0, 0, 2, 0.58)])
def test_verifiable_reward(spark, defects, caught, claims, want):
    parts = reward.components(F.lit(defects), F.lit(caught), F.lit(claims), F.lit(1.0), F.lit("x" * 300))
    assert one(spark, parts["reward"]) == pytest.approx(want, abs=1e-4)
    assert one(spark, reward.guarded(F.lit("<think>never closed"), F.lit(1.0))) == 0.0


def test_review_block(spark):
    for raw, want in (
        ("<think>a</think><review> b </review>", "b"), ("<review>a</review><review>...</review>", "a"), ("<think>x <review>in</review></think>", "in"), ("just text ", "just text"), ("", ""),
    ):
        assert one(spark, text.review_block(F.lit(raw))) == want


def test_names(spark):
    diff = "--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@ def outer\n-old_name = 1\n+new_name = self\n context_name"
    assert sorted(one(spark, text.names_changed(F.lit(diff), text.SMALL_STOP))) == ["new_name", "old_name"]
    assert {"outer", "old_name", "new_name", "context_name"} <= set(one(spark, text.names_in_hunks(F.lit(diff))))
    assert one(spark, text.diff_paths(F.lit(diff))) == ["f.py"]
    assert one(spark, text.unknown_name_ratio(F.lit("`outer` `fake` `self`"), F.lit(diff), text.SMALL_STOP)) == 0.5


def test_comment_verdict(spark):
    good = '```json\n{"is_defect": true, "issue_type": "bug", "canonical_desc": "d"}\n```'
    assert one(spark, text.comment_verdict(F.lit(good))).issue_type == "bug"
    assert one(spark, text.comment_verdict(F.lit('{"is_defect": false, "issue_type": "bug", "canonical_desc": "d"}'))) is None
    assert one(spark, text.comment_verdict(F.lit("nonsense"))) is None


def test_advantages_and_gates(spark):
    r = spark.createDataFrame([(1, 0.0), (1, 0.2), (1, 0.4), (2, 0.4), (2, 0.7), (2, 1.0)], "g int, reward double")
    got = [round(x.advantage, 6) for x in stats.advantages(r, "g", 0.5).orderBy("g", "reward").collect()]
    assert got == [-0.5, -0.3, -0.1, -0.3, 0.0, 0.3]
    flat = spark.createDataFrame([(i // 8, 0.5) for i in range(80)], "g int, reward double")
    assert stats.spread_gate(flat, "g").first().passed is False
    values = [0.3, 0.6, 0.7, 1.0, 0.05]
    h = [x.n for x in stats.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("bin").collect()]
    assert h == np.histogram(values, 10, (0, 1))[0].tolist()


def test_partition_invariance(spark):
    rows = spark.range(200).selectExpr("id as k", "cast(id % 3 as double) as recall", "cast(id % 2 as double) as fp_rate")
    got = {n: stats.paired_bootstrap(rows.repartition(n), "k", rounds=50).orderBy("metric").collect() for n in (1, 4, 16)}
    assert got[1] == got[4] == got[16]


def test_curation(spark):
    assert one(spark, curate.repo_name(F.lit("Owner/Name"))) == "name"
    rows = spark.createDataFrame([("x/a", 1), ("y/b", 2)], "repo string, i int")
    assert [r.i for r in curate.without_repos(rows, spark.createDataFrame([("z/A",)], "repo string")).collect()] == [2]
    dup = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "id string, at int, v string")
    assert curate.last_wins(dup, "id", "at").first().v == "new"
    split = curate.seeded_split(spark.range(100).withColumnRenamed("id", "i"), "i", 100)
    assert sorted(r["count"] for r in split.groupBy("split").count().collect()) == [20, 80]
    assert curate.prompt_caps() == [12000, 8400, 5880, 4116, 2881, 2016, 1411, 987, 690, 482, 337, 235]


def test_rouge():
    assert rouge.tokens("The Caresses, running-shoes of PONIES") == ["the", "caress", "run", "shoe", "of", "poni"]
    assert rouge.rouge_l("a b c d".split(), "a c d".split()) == pytest.approx(6 / 7)
    assert rouge.rouge_n("a b".split(), "a b".split(), 2) == 1.0
    assert rouge.bleu4("the cat sat on the mat".split(), "the cat sat on the mat".split()) == pytest.approx(1.0)


def test_near(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "x y z"), (3, None)], "id int, t string")
    refs = spark.createDataFrame([("a b c d f",)], "text string")
    assert sorted(r.id for r in rouge.without_near(rows, "t", refs, 0.7).collect()) == [2, 3]


def test_jsonl_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"instance_id": "1", "base_output": "x"}\n\nnot json\n{"instance_id": "2", "base_output": "y"}\n')
    assert jsonl.tolerant(spark, str(tmp_path / "in"), "base_samples").count() == 2
    done = spark.createDataFrame([("1", "ok"), ("2", "gemini_error")], "instance_id string, status string")
    rows = jsonl.tolerant(spark, str(tmp_path / "in"), "base_samples")
    assert [r.instance_id for r in jsonl.to_do(rows, done, "instance_id", curate.transient(F.col("status"))).collect()] == ["2"]
    q = resume.process_files(spark, str(tmp_path / "in"), "base_samples", lambda b: b.where("instance_id is not null"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
