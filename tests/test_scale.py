"""Queries against their SQL on odd rows that the given tables lack, and steps that were too slow or too large."""

import random
import re
import time

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginmill.functions import text
from marginmill.operators import hooks, overlap, rouge, stemmer
from marginmill.plans import base, catalog

from .test_queries import rows_of

TEXTS = ["", " ", " \n\t", "\u00a0", "\u3000\u2003", "...", " ... ", "\u00a0a plain text of words\u3000", " ends \n\n", "x", "a text with `some_name` in it, long enough to count"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of which every kind stands at all remainders of 8."""
    base = str(tmp_path_factory.mktemp("odd"))
    rows = [(k * 8 + q, body, "en", "src", len(body)) for k, body in enumerate(TEXTS) for q in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{base}/documents.parquet")
    return base


@pytest.mark.parametrize("name", ["oracle_resume", "review_extraction"])
def test_blank_texts(spark, odd, name):
    df = catalog.QUERIES[name](spark, odd)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), cols)


LABEL = "array<struct<path: string, line: int, text: string>>"
LOC = "array<struct<file: string, line: int, identifier: string>>"


def test_lookups_match_as_comparisons_do(spark):
    """Against all pairs compared: both kinds in one location, repeats, nulls, zeros, identifiers that are patterns, letters beyond ASCII."""
    rng = random.Random(3)
    names = [None, "", "err", "a_b", "b", "x.y", "a-b", "c+", "é", "err2"]
    words = ["err", "an error", "a_b and b", "x.y", "xzy", "a-b a_b", "éb b", "c+ c", "err2!", "", None]
    rows = []
    for k in range(300):
        locs = [(rng.choice([None, "", "a", "b"]), rng.choice([None, 0, 3, 9, 20]), rng.choice(names)) for _ in range(rng.randrange(7))]
        labels = [(rng.choice([None, "", "a", "b"]), rng.choice([None, 0, 3, 8, 12]), rng.choice(words)) for _ in range(rng.randrange(7))]
        rows.append((k, None if k == 7 else locs, None if k == 8 else labels))
    df = spark.createDataFrame(rows, f"k int, p {LOC}, q {LABEL}")
    p, q = F.col("p"), F.col("q")
    share = lambda hit: F.when(F.size(q) == 0, 1.0).otherwise(hit / F.nullif(F.size(q), F.lit(0)))
    full = F.filter(p, lambda x: (F.coalesce(x["file"], F.lit("")) != "") & (F.coalesce(x["line"], F.lit(0)) != 0))
    hits = share(F.size(F.filter(q, lambda y: F.exists(p, lambda x: overlap.matches(x, y)))))
    strict = share(F.size(F.filter(q, lambda y: F.exists(full, lambda x: (x["file"] == y["path"]) & (x["line"] == y["line"])))))
    numbered = F.transform(q, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    taken = F.aggregate(p, F.array().cast("array<int>"), lambda acc, loc: F.concat(acc, F.slice(F.transform(F.filter(numbered, lambda y: ~F.array_contains(acc, y["i"]) & overlap.matches(loc, y["x"])), lambda y: y["i"]), 1, 1)))
    both = F.size(taken)
    iou = F.when((F.size(p) == 0) & (F.size(q) == 0), 1.0).otherwise(F.coalesce(both / F.nullif(F.size(p) + F.size(q) - both, F.lit(0)), F.lit(0.0)))
    got = df.select("k", overlap.hit_rate(p, q), overlap.hit_rate_strict(p, q), overlap.iou_lenient(p, q)).orderBy("k").collect()
    want = df.select("k", hits, strict, iou).orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("metric", ["hit_rate", "hit_rate_strict", "iou_lenient"])
def test_overlap_of_long_rows(spark, metric):
    """20,000 locations and labels of one row are looked up, not compared with each other."""
    df = spark.range(1).selectExpr(
        "transform(sequence(1, 20000), i -> named_struct('file', concat('f', i % 50), 'line', 100 * i, 'identifier', concat('n', i))) as p",
        "transform(sequence(1, 20000), i -> named_struct('path', concat('f', i % 50), 'line', 100 * i + 50 * (i % 2), 'text', 'see it')) as q",
    )
    began = time.time()
    assert df.select(getattr(overlap, metric)(F.col("p"), F.col("q"))).first()[0] == (1 / 3 if metric == "iou_lenient" else 0.5)
    assert time.time() - began < 20


def test_loops_as_the_pattern_finds_them(spark):
    """Units of all lengths, in full and one short, behind any number of characters, beyond the first plane too."""
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    bodies = [None, ""] + [word(rng.randrange(400), letters) + word(n, letters) * times + word(rng.randrange(9), letters) for n in (*range(13, 84), 160) for times in (9, 10, 11) for letters in ("ab\n", "aé😀z ")]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = df.select(text.loops(F.col("b")).alias("x"), F.rlike("b", F.lit(text.LOOP)).alias("y")).collect()
    assert all(r.x == r.y for r in got) and len({r.x for r in got}) == 3


def test_loops_of_long_texts(spark):
    """No unit is tried at each of 16 million characters."""
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500000)), lambda i: F.md5(i.cast("string"))), "").alias("b"))
    began = time.time()
    assert df.select(text.loops(F.col("b"))).first()[0] is False
    assert time.time() - began < 10


def test_a_diff_goes_to_the_workers_once(spark):
    """3000 comments on a diff of 2 MB; the ones in order, null lines as None, none of those that fail."""
    diff = F.concat(F.lit("--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n+"), F.repeat(F.lit("x"), 2_000_000))
    note = "transform(sequence(1, 3000), i -> named_struct('path', if(i % 3 = 0, 'b.py', 'a.py'), 'line', nullif(cast(i as int), 1), 'text', concat('t', i)))"
    rows = spark.range(1).select(F.lit("k").alias("instance_id"), diff.alias("diff"), F.expr(note).alias("reference_comments"))
    seen = hooks.labelled(rows, lambda d, c: {"issue_type": "bug", "canonical_desc": f"{len(d)} {c['text']} {c['line']}"} if c["text"] != "t2" else {"issue_type": "bug"})
    began = time.time()
    got = seen.first()
    assert time.time() - began < 20
    n = 2_000_000 + len("--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n+")
    assert got.n_ungrounded == 1000
    assert [(x.line, x.canonical_desc) for x in got.defects] == [(None if i == 1 else i, f"{n} t{i} {None if i == 1 else i}") for i in range(1, 3001) if i % 3 and i != 2]


def test_python_batches_are_bounded(spark):
    """Rows of 1 MB come to a worker a few at a time."""
    base.table(spark, "/root/testdata/sf0.001", "documents")
    df = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("b"))
    count = F.arrow_udf(lambda b, i: pa.array([len(b)] * len(b), pa.int64()), "long")
    assert df.select(count("b", "id").alias("n")).agg(F.max("n")).first()[0] <= 6


def test_means_read_their_tables_once(spark):
    """No union and no join of the predictions with themselves, which would derive every diff anew."""
    df = catalog.QUERIES["means_with_default"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 2  # documents and labels


def test_numbered_scores_are_those_of_words(spark):
    """Exactly, for texts with none, one and few words, shared and not, nulls, other case and endings."""
    rng = random.Random(9)
    words = ["running", "Runs", "ran", "a", "b", "c-d", "naïve", "--", "relational", "sky", "skies", "x1"]
    texts = [None, "", "--", "a", "a b", "a b c-d"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    pairs = [(rng.choice(texts), r) for r in texts for _ in range(3)]
    got = rouge._scores(*(pd.Series(x, dtype=object) for x in zip(*pairs, strict=True)))
    for (g, r), row in zip(pairs, got.itertuples(index=False), strict=True):
        a, b = rouge.tokens(r), rouge.tokens(g)
        assert tuple(row) == (rouge.bleu4((r or "").split(), (g or "").split()), rouge.rouge_n(a, b, 1), rouge.rouge_n(a, b, 2), rouge.rouge_l(a, b))


def test_a_batch_stems_each_word_once(spark, monkeypatch):
    """However often it stands there, and however small the cache of stems is."""
    seen = []
    monkeypatch.setattr(stemmer, "stem", lambda w: seen.append(w) or w[:3])
    rouge._scores(pd.Series(["word other word"] * 50), pd.Series(["word third"] * 50))
    assert sorted(seen) == ["other", "third", "word"]


def test_locations_are_those_of_the_whole_review(spark):
    """Against both patterns over the whole text: shared backticks, places within places, numbers that are equal or too large, letters beyond ASCII."""
    rng = random.Random(7)
    parts = ["`", "`", "a.py", "b/c.ts", ":7", ":07", ":99999999999", "name", "_x1", "é", " ", "\n", "-", ".", ":", "ab", "`a.py:7`", "`name`"]
    bodies = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = df.select("b", text.locations(F.col("b")).alias("x")).collect()
    for body, found in got:
        places = [(f, int(n) if n and int(n) < 2**31 else None, None) for f, n in re.findall(r"`([A-Za-z0-9_./\-]+\.(?:py|js|jsx|ts|tsx|java|go|rb|c|cpp|h|hpp|rs))(?::([0-9]+))?`", body or "")]
        names = [(None, None, x) for x in re.findall(r"`([A-Za-z_][A-Za-z0-9_]{1,40})`", body or "") if len(x) > 2]
        assert [tuple(x) for x in found] == list(dict.fromkeys(places + names))


def test_locations_of_long_reviews(spark):
    """30,000 places of one review are told apart by a hash, not by pairs."""
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda i: F.concat(F.lit("see `src/a"), i.cast("string"), F.lit(".py:3` "))), "").alias("b"))
    began = time.time()
    assert df.select(F.size(text.locations(F.col("b")))).first()[0] == 30000
    assert time.time() - began < 15


def test_lexical_scores_are_the_three_metrics(spark):
    """In one call of Python, for nulls, empty rows, repeats and places without a line too."""
    rng = random.Random(11)
    rows = []
    for k in range(300):
        locs = [(rng.choice([None, "", "a", "b:1"]), rng.choice([None, 0, 1, 3, 9]), rng.choice([None, "err", "x.y"])) for _ in range(rng.randrange(6))]
        labels = [(rng.choice([None, "", "a", "b:1"]), rng.choice([None, 0, 1, 3, 8]), rng.choice(["err", "x.y", None])) for _ in range(rng.randrange(6))]
        rows.append((k, None if k in (7, 9) else locs, None if k in (8, 9) else labels))
    df = spark.createDataFrame(rows, f"k int, p {LOC}, q {LABEL}")
    p, q = F.col("p"), F.col("q")
    once = df.select("k", overlap.lexical(p, q).alias("s")).select("k", "s.*")
    got = once.orderBy("k").collect()
    want = df.select("k", overlap.iou_strict(p, q), overlap.hit_rate_strict(p, q), overlap.hit_rate(p, q)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    pairs = lambda x: {(f, n) for f, n, _ in x or () if f and n}
    for r, (_, locs, labels) in zip(got, rows, strict=True):
        a, b = pairs(locs), pairs(labels)
        assert r.iou == (0.0 if locs is None or labels is None else len(a & b) / len(a | b) if a | b else 1.0)
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [run(") == 1
    assert "pythonUDF1" not in once._jdf.queryExecution().executedPlan().toString()


def test_strict_overlap_of_long_rows(spark):
    """20,000 pairs of each side are told apart by a hash."""
    df = spark.range(1).selectExpr(
        "transform(sequence(1, 20000), i -> named_struct('file', concat('f', i % 50), 'line', i, 'identifier', '')) as p",
        "transform(sequence(1, 20000), i -> named_struct('path', concat('f', i % 50), 'line', i + 50, 'text', '')) as q",
    )
    began = time.time()
    assert df.select(overlap.iou_strict(F.col("p"), F.col("q"))).first()[0] == 19950 / 20050
    assert time.time() - began < 10


def test_scores_of_a_batch_count_together(monkeypatch):
    """N-grams of a slice are numbered in six passes, not in six for each pair; slices of few characters give the same scores."""
    rng = random.Random(13)
    seen = []
    number = pd.factorize
    monkeypatch.setattr(pd, "factorize", lambda x: seen.append(len(x)) or number(x))
    texts = pd.Series([" ".join(rng.choice(["a", "bb", "running", "ü x", "\x1c", "　"]) for _ in range(rng.randrange(30))) for _ in range(200)])
    got = rouge._scores(texts, texts[::-1].reset_index(drop=True))
    assert len(seen) == 6
    monkeypatch.setattr(rouge, "SLICE", 100)
    assert rouge._scores(texts, texts[::-1].reset_index(drop=True)).equals(got)
    for g, r, row in zip(texts, texts[::-1], got.itertuples(index=False), strict=True):
        a, b = rouge.tokens(r), rouge.tokens(g)
        assert tuple(row) == (rouge.bleu4(r.split(), g.split()), rouge.rouge_n(a, b, 1), rouge.rouge_n(a, b, 2), rouge.rouge_l(a, b))
