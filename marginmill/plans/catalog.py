"""Registered queries of the review operators, each with SQL that DuckDB runs on the same tables.

The tables hold prose, not diffs, so reviews, diffs and labels are derived from the documents' words
by the same rule in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reward, text
from ..operators import curate, overlap, rouge, stats
from .base import ORACLES, QUERIES
from .base import query as _query
from .base import table as _table

# --- scores: documents and labels as reviews and defects -------------------------------------
_SCORED_SQL = """
WITH s AS (SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars,
  coalesce(CAST(l.quality = 0 AS INT), 0) + coalesce(CAST(l.toxic = 1 AS INT), 0) AS n_defects,
  CAST(d.n_chars < 400 AS INT) + CAST(lower(d.text) LIKE '%worthless%' AS INT) AS claims,
  coalesce(CAST(l.quality = 0 AND d.n_chars < 400 AS INT), 0) + coalesce(CAST(l.toxic = 1 AND lower(d.text) LIKE '%worthless%' AS INT), 0) AS caught
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, CASE WHEN n_defects > 0 THEN caught / n_defects END AS recall,
  CASE WHEN n_defects > 0 THEN CASE WHEN claims > 0 THEN least(1.0, caught / claims) ELSE 0.0 END END AS "precision",
  CASE WHEN n_defects = 0 THEN CAST(claims > 0 AS INT) * 1.0 END AS fp_rate FROM s)
"""
_MEANS_SQL = """count(*) AS n_total, count(*) FILTER (WHERE n_defects > 0) AS n_labeled, count(*) FILTER (WHERE n_defects = 0) AS n_clean,
  round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(fp_rate), 6) AS fp_rate"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    df = _table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    low, toxic = F.col("n_chars") < 400, F.contains(F.lower("text"), F.lit("worthless"))
    n = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    df = df.select(
        "doc_id", "lang", "source", "text", "n_chars",
        (n(F.col("quality") == 0) + n(F.col("toxic") == 1)).alias("n_defects"), (n(low) + n(toxic)).alias("claims"),
        (n((F.col("quality") == 0) & low) + n((F.col("toxic") == 1) & toxic)).alias("caught"),
    )
    return df.withColumns(reward.components(F.col("n_defects"), F.col("caught"), F.col("claims"), F.lit(1.0), F.col("text")))


@_query(_SCORED_SQL + f"SELECT {_MEANS_SQL} FROM c")
def score_conditional_means(spark, sf_dir):
    return stats.conditional_means(_scored(spark, sf_dir))


@_query(_SCORED_SQL + f"SELECT coalesce(lang, 'unknown') AS bucket, {_MEANS_SQL} FROM c GROUP BY 1")
def breakdown_by_bucket(spark, sf_dir):
    return stats.conditional_means(_scored(spark, sf_dir).withColumn("bucket", F.coalesce("lang", F.lit("unknown"))), "bucket")


@_query(_SCORED_SQL + "SELECT source, round(avg(CAST(claims > 0 AS INT)), 6) AS pass_rate, count(*) AS n FROM c GROUP BY ROLLUP (source)")
def pattern_rollup(spark, sf_dir):
    return _scored(spark, sf_dir).rollup("source").agg(F.round(F.avg((F.col("claims") > 0).cast("int")), 6).alias("pass_rate"), F.count("*").alias("n"))


@_query(_SCORED_SQL + """SELECT round(avg(CASE WHEN n_defects > 0 THEN 1.5 * 1.5 * 0 + 3.25 * "precision" * recall / nullif(2.25 * "precision" + recall, 0) END), 6) AS fbeta_defined,
  round(avg(CASE WHEN n_defects = 0 THEN greatest(0.0, 1 - 0.35 * claims) END), 6) AS clean_quality,
  round(avg(CASE WHEN n_chars < 150 THEN n_chars / 150 WHEN n_chars <= 1000 THEN 1.0 ELSE greatest(0.0, 1 - (n_chars - 1000) / 1500) END), 6) AS length_score FROM c""")
def verifiable_reward_parts(spark, sf_dir):
    df = _scored(spark, sf_dir)
    return df.agg(
        F.round(F.avg(F.when((F.col("n_defects") > 0) & (2.25 * F.col("precision") + F.col("recall") > 0), F.col("quality"))), 6).alias("fbeta_defined"),
        F.round(F.avg(F.when(F.col("n_defects") == 0, F.col("quality"))), 6).alias("clean_quality"),
        F.round(F.avg(reward.length_score(F.col("text"))), 6).alias("length_score"),
    )


def _variants(spark, sf_dir):
    a = _scored(spark, sf_dir)
    one = F.lit(1)
    b = a.select("doc_id", "n_defects", "text", F.least("claims", one).alias("claims"), F.least("caught", one).alias("caught"))
    return a, b.withColumns(reward.components(F.col("n_defects"), F.col("caught"), F.col("claims"), F.lit(1.0), F.col("text")))


@_query(_SCORED_SQL + """, b AS (SELECT doc_id, CASE WHEN n_defects > 0 THEN least(caught, 1) / n_defects END AS recall, CASE WHEN n_defects = 0 THEN CAST(least(claims, 1) > 0 AS INT) * 1.0 END AS fp_rate FROM c)
SELECT count(*) AS n, round(avg(b.recall - c.recall), 6) AS recall_delta, round(avg(b.fp_rate - c.fp_rate), 6) AS fp_delta FROM c JOIN b USING (doc_id)""")
def paired_delta_point(spark, sf_dir):
    d = stats.paired_deltas(*_variants(spark, sf_dir), "doc_id")
    return d.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall_delta"), F.round(F.avg("fp_rate"), 6).alias("fp_delta"))


@_query()
def paired_bootstrap_exact(spark, sf_dir):
    return stats.paired_bootstrap(stats.paired_deltas(*_variants(spark, sf_dir), "doc_id"), "doc_id")


@_query()
def poisson_bootstrap_interval(spark, sf_dir):
    return stats.poisson_bootstrap(_scored(spark, sf_dir), "doc_id", "fp_rate")


# --- rewards: events as rollouts ---------------------------------------------------------------
_REWARDS_SQL = "WITH r AS (SELECT event_id, user_id, value - floor(value) AS reward FROM events) "


def _rewards(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") - F.floor("value")).alias("reward"))


@_query(_REWARDS_SQL + "SELECT event_id, round(reward - greatest(avg(reward) OVER (PARTITION BY user_id), 0.45), 6) + 0.0 AS advantage FROM r")
def clipped_advantage(spark, sf_dir):
    return stats.advantages(_rewards(spark, sf_dir), "user_id", 0.45).select("event_id", (F.round("advantage", 6) + 0.0).alias("advantage"))


@_query(_REWARDS_SQL + "SELECT round(avg(s), 6) AS mean_std, round(avg(s), 6) >= 0.1 AS passed FROM (SELECT stddev_pop(reward) AS s FROM r GROUP BY user_id)")
def group_std_gate(spark, sf_dir):
    return stats.spread_gate(_rewards(spark, sf_dir), "user_id")


@_query(_REWARDS_SQL + """, e AS (SELECT [0.0, 0.1, 0.2, CAST(0.30000000000000004 AS DOUBLE), 0.4, 0.5, CAST(0.6000000000000001 AS DOUBLE), CAST(0.7000000000000001 AS DOUBLE), 0.8, 0.9, 1.0]::DOUBLE[] AS edges),
h AS (SELECT least(len(list_filter(edges, lambda x: x <= reward)) - 1, 9) AS bin, count(*) AS n FROM r, e GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(10) g(i) LEFT JOIN h ON h.bin = i""")
def reward_histogram(spark, sf_dir):
    return stats.histogram(_rewards(spark, sf_dir), "reward")


@_query(_REWARDS_SQL + """SELECT round(quantile_cont(reward, 0.25) FILTER (WHERE reward >= 1e-9), 6) AS p25, round(quantile_cont(reward, 0.33) FILTER (WHERE reward >= 1e-9), 6) AS p33,
  round(quantile_cont(reward, 0.5) FILTER (WHERE reward >= 1e-9), 6) AS p50, count(*) FILTER (WHERE reward < 1e-9) AS n_zero FROM r""")
def reward_percentiles(spark, sf_dir):
    r = F.when(F.col("reward") >= 1e-9, F.col("reward"))
    at = lambda q: F.round(F.percentile(r, F.lit(q)), 6)
    return _rewards(spark, sf_dir).agg(at(0.25).alias("p25"), at(0.33).alias("p33"), at(0.5).alias("p50"), F.count_if(F.col("reward") < 1e-9).alias("n_zero"))


_VOTES_SQL = """WITH v AS (SELECT user_id, event_id, substr('ABT', CAST(event_id % 3 AS INT) + 1, 1) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
m AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE v = 'A') >= 2 THEN 'A' WHEN count(*) FILTER (WHERE v = 'B') >= 2 THEN 'B' ELSE 'TIE' END AS verdict FROM v WHERE k <= 3 GROUP BY user_id) """


def _verdicts(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("substr('ABT', cast(event_id % 3 as int) + 1, 1)").alias("v"))
    votes = curate.cap_per_group(e, "user_id", "event_id", 3).groupBy("user_id").agg(F.collect_list("v").alias("votes"))
    return votes.select("user_id", stats.majority(F.col("votes")).alias("verdict"))


@_query(_VOTES_SQL + "SELECT user_id, verdict FROM m")
def majority_vote(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@_query(_VOTES_SQL + "SELECT count(*) AS n, round(avg(CAST(verdict = 'A' AS INT)), 6) AS win_rate, round(avg(CAST(verdict = 'TIE' AS INT)), 6) AS tie_rate, CAST(count(*) FILTER (WHERE verdict = 'A') AS BIGINT) AS wins FROM m")
def win_rates(spark, sf_dir):
    v = F.col("verdict")
    return _verdicts(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg((v == "A").cast("int")), 6).alias("win_rate"), F.round(F.avg((v == "TIE").cast("int")), 6).alias("tie_rate"), F.count_if(v == "A").alias("wins")
    )


@_query()
def win_rate_interval(spark, sf_dir):
    return stats.win_rate(_verdicts(spark, sf_dir), "user_id")


# --- reviews and diffs derived from words ------------------------------------------------------
# Every word of a text is a line of the diff and a word of the review; some are ticked names, places or invented names, some are labels.
_DERIVED_SQL = """SELECT doc_id, lang, n_chars, source, text, w,
  array_join(transform(w, (x, i) -> CASE WHEN i % 19 = 0 THEN concat('`', x, '`') WHEN i % 31 = 7 THEN concat('`src/', x, '.py:', CAST(i % 40 AS STRING), '`') WHEN i % 37 = 5 THEN concat('the `', x, '_zz` function') ELSE x END), ' ') AS review,
  concat('--- a/src/', p, '.py', chr(10), '+++ b/src/', p, '.py', chr(10), '@@ -1,', CAST(size(w) AS STRING), ' @@ def ', p, chr(10),
    array_join(transform(w, (x, i) -> concat(CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END, x)), chr(10)), chr(10), 'diff --git a/lib/x.ts b/lib/x.ts', chr(10), '--- a/lib/x.ts', chr(10), '+++ /dev/null') AS diff,
  transform(filter(sequence(0, size(w), 29), i -> i < size(w)),
    i -> struct(CASE WHEN i % 87 <> 58 THEN concat('src/', w[i], '.py') END AS path, CAST(i % 40 + i % 9 - 4 AS INT) AS line, concat('see ', coalesce(try_element_at(w, i + 2), '')) AS text)) AS labels
FROM (SELECT *, coalesce(try_element_at(w, 1), 'none') AS p FROM {docs})"""

_DERIVED = """WITH t AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]{2,20}') AS w FROM documents),
u AS (SELECT *, coalesce(w[1], 'none') AS p FROM t),
d AS (SELECT doc_id, lang, n_chars, source, text, w, p,
  coalesce(array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 19 = 0 THEN '`' || x || '`' WHEN (i - 1) % 31 = 7 THEN '`src/' || x || '.py:' || ((i - 1) % 40) || '`' WHEN (i - 1) % 37 = 5 THEN 'the `' || x || '_zz` function' ELSE x END), ' '), '') AS review,
  '--- a/src/' || p || '.py' || chr(10) || '+++ b/src/' || p || '.py' || chr(10) || '@@ -1,' || len(w) || ' @@ def ' || p || chr(10)
    || coalesce(array_to_string(list_transform(w, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || x), chr(10)), '') || chr(10) || 'diff --git a/lib/x.ts b/lib/x.ts' || chr(10) || '--- a/lib/x.ts' || chr(10) || '+++ /dev/null' AS diff FROM u),
k AS (SELECT doc_id, i - 1 AS i, w[i] AS x, CASE WHEN (i - 1) % 87 <> 58 THEN 'src/' || w[i] || '.py' END AS path, CAST((i - 1) % 40 + (i - 1) % 9 - 4 AS INT) AS line, 'see ' || coalesce(w[i + 1], '') AS note
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM u) WHERE (i - 1) % 29 = 0),
f AS (SELECT doc_id, min(i) AS i, 'src/' || x || '.py' AS file, CAST(i % 40 AS INT) AS line FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM u) WHERE i % 19 <> 0 AND i % 31 = 7 GROUP BY doc_id, x, i % 40),
n AS (SELECT doc_id, min(i) AS i, CASE WHEN i % 19 = 0 THEN x ELSE x || '_zz' END AS identifier FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM u) WHERE i % 19 = 0 OR i % 31 <> 7 AND i % 37 = 5 GROUP BY doc_id, 3) """


def _derived(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,20}"), F.lit(0)))
    return spark.sql(_DERIVED_SQL, docs=docs).withColumn("locs", text.locations(F.col("review")))


@_query(_DERIVED + "SELECT doc_id, file, line, NULL AS identifier FROM f UNION ALL SELECT doc_id, NULL, NULL, identifier FROM n")
def extract_locations(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.explode("locs").alias("x")).select("doc_id", "x.file", "x.line", "x.identifier")


_STRICT = """, p2 AS (SELECT DISTINCT doc_id, file, line FROM f WHERE line <> 0), q2 AS (SELECT DISTINCT doc_id, path AS file, line FROM k WHERE path IS NOT NULL AND line <> 0),
both2 AS (SELECT doc_id, count(*) AS n FROM p2 JOIN q2 USING (doc_id, file, line) GROUP BY doc_id),
np AS (SELECT doc_id, count(*) AS n FROM p2 GROUP BY doc_id), nq AS (SELECT doc_id, count(*) AS n FROM q2 GROUP BY doc_id),
hs AS (SELECT k.doc_id, count(*) AS n, count(p2.file) AS hit FROM k LEFT JOIN p2 ON p2.doc_id = k.doc_id AND p2.file = k.path AND p2.line = k.line GROUP BY k.doc_id),
strict AS (SELECT d.doc_id, CASE WHEN np.n IS NULL AND nq.n IS NULL THEN 1.0 ELSE coalesce(both2.n, 0) / (coalesce(np.n, 0) + coalesce(nq.n, 0) - coalesce(both2.n, 0)) END AS iou, coalesce(hs.hit / hs.n, 1.0) AS hit
  FROM d LEFT JOIN np USING (doc_id) LEFT JOIN nq USING (doc_id) LEFT JOIN both2 USING (doc_id) LEFT JOIN hs USING (doc_id)) """
_LENIENT = """, m AS (SELECT k.doc_id, k.i AS label, f.i AS loc, 0 AS kind FROM k JOIN f ON f.doc_id = k.doc_id AND f.file = k.path AND f.line <> 0 AND k.line <> 0 AND abs(f.line - k.line) <= 5
  UNION ALL SELECT k.doc_id, k.i, n.i, 1 FROM k JOIN n ON n.doc_id = k.doc_id AND (n.identifier = 'see' OR n.identifier = substr(k.note, 5))),
lenient AS (SELECT d.doc_id, CASE WHEN count(k.i) = 0 THEN 1.0 ELSE count(DISTINCT m.label) / count(DISTINCT k.i) END AS hit FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.doc_id = k.doc_id AND m.label = k.i GROUP BY d.doc_id) """


@_query(_DERIVED + _STRICT + "SELECT doc_id, round(CAST(iou AS DOUBLE), 6) AS iou, round(CAST(hit AS DOUBLE), 6) AS hit FROM strict")
def iou_and_hits_strict(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.round(overlap.iou_strict(F.col("locs"), F.col("labels")), 6).alias("iou"), F.round(overlap.hit_rate_strict(F.col("locs"), F.col("labels")), 6).alias("hit"))


@_query(_DERIVED + _LENIENT + """, RECURSIVE_LOCS AS (SELECT doc_id, i, kind, row_number() OVER (PARTITION BY doc_id ORDER BY kind, i) AS step FROM (SELECT doc_id, i, 0 AS kind FROM f UNION ALL SELECT doc_id, i, 1 FROM n)),
ms AS (SELECT l.doc_id, l.step, list(m.label ORDER BY m.label) AS can FROM RECURSIVE_LOCS l JOIN m ON m.doc_id = l.doc_id AND m.loc = l.i AND m.kind = l.kind GROUP BY l.doc_id, l.step),
s2 AS (SELECT doc_id, can, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step FROM ms),
g AS (SELECT doc_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS taken FROM d UNION ALL
  SELECT g.doc_id, s2.step, CASE WHEN len(list_filter(s2.can, lambda y: NOT list_contains(g.taken, y))) > 0 THEN list_append(g.taken, list_filter(s2.can, lambda y: NOT list_contains(g.taken, y))[1]) ELSE g.taken END FROM g JOIN s2 ON s2.doc_id = g.doc_id AND s2.step = g.step + 1),
took AS (SELECT doc_id, max(len(taken)) AS n FROM g GROUP BY doc_id), nl AS (SELECT doc_id, count(*) AS n FROM RECURSIVE_LOCS GROUP BY doc_id), nk AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN nl.n IS NULL AND nk.n IS NULL THEN 1.0 ELSE took.n / (coalesce(nl.n, 0) + coalesce(nk.n, 0) - took.n) END, 6) AS iou FROM d JOIN took USING (doc_id) LEFT JOIN nl USING (doc_id) LEFT JOIN nk USING (doc_id)""".replace("RECURSIVE_LOCS", "locs"))
def iou_lenient_greedy(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.round(overlap.iou_lenient(F.col("locs"), F.col("labels")), 6).alias("iou"))


ORACLES["iou_lenient_greedy"] = ORACLES["iou_lenient_greedy"].replace("WITH t AS", "WITH RECURSIVE t AS", 1)


@_query(_DERIVED + _LENIENT + "SELECT doc_id, round(CAST(hit AS DOUBLE), 6) AS hit FROM lenient")
def hit_rate_lenient(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.round(overlap.hit_rate(F.col("locs"), F.col("labels")), 6).alias("hit"))


_CHANGED = """list_distinct(list_filter(flatten([regexp_extract_all(x, '[a-zA-Z_][a-zA-Z0-9_]{2,}') FOR x IN string_split(diff, chr(10)) IF x[1] IN ('+', '-') AND NOT starts_with(x, '+++') AND NOT starts_with(x, '---')]),
  lambda y: y NOT IN ('self', 'return', 'import', 'class', 'True', 'False', 'None', 'with', 'from', 'def', 'the', 'and', 'for', 'not', 'this', 'that', 'list', 'dict', 'str', 'int')))"""


@_query(_DERIVED + f"SELECT doc_id, array_to_string(list_sort({_CHANGED}), ' ') AS names FROM d")
def diff_identifiers_changed(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.names_changed(F.col("diff"), text.SMALL_STOP)), " ").alias("names"))


@_query(_DERIVED + "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['def', p], w))), ' ') AS names FROM d")
def diff_identifiers_in_hunks(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.names_in_hunks(F.col("diff"))), " ").alias("names"))


@_query(_DERIVED + """, o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT list_contains(w, identifier) AND identifier <> p AND identifier <> 'def') AS bad, count(*) FILTER (WHERE NOT contains(diff, identifier)) > 0 AS flag
  FROM n JOIN d USING (doc_id) WHERE identifier NOT IN ('self', 'return', 'import', 'class', 'True', 'False', 'None', 'with', 'from', 'def', 'the', 'and', 'for', 'not', 'this', 'that', 'list', 'dict', 'str', 'int') GROUP BY doc_id)
SELECT doc_id, coalesce(round(bad / n, 6), 0.0) AS ratio, coalesce(flag, false) AS flag FROM d LEFT JOIN o USING (doc_id)""")
def unknown_names(spark, sf_dir):
    r, d = F.col("review"), F.col("diff")
    return _derived(spark, sf_dir).select("doc_id", F.round(text.unknown_name_ratio(r, d, text.SMALL_STOP), 6).alias("ratio"), text.unknown_name_flag(r, d, text.SMALL_STOP).alias("flag"))


@_query(_DERIVED + f"""SELECT doc_id, CASE WHEN length(text) < 40 THEN 'drop' WHEN length(text) < 300 AND len(list_filter({_CHANGED}, lambda x: contains(text, x))) <= 1 THEN 'weak' ELSE 'keep' END AS tier FROM d""")
def tiering(spark, sf_dir):
    names = text.names_changed(F.col("diff"), text.SMALL_STOP)
    return _derived(spark, sf_dir).select("doc_id", curate.tier(F.col("text"), text.known_names(F.col("text"), names)).alias("tier"))


@_query(_DERIVED + f"""SELECT coalesce(reason, 'rewritten') AS family, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM (SELECT CASE
  WHEN len(list_filter({_CHANGED}, lambda x: contains(review, x))) < 1 THEN 'no_diff_identifier'
  WHEN length(review) < greatest(20, floor(0.3 * n_chars)) OR length(review) > least(1500, greatest(600, floor(3.0 * n_chars))) THEN 'length'
  WHEN len(list_filter(regexp_extract_all(review, '(?i)the `([a-zA-Z_][a-zA-Z0-9_]{{2,}})` (?:is|was|should|has|does|needs)', 1) || regexp_extract_all(review, '(?i)`([a-zA-Z_][a-zA-Z0-9_]{{2,}})` (?:function|method|variable|class|field|attribute)', 1), lambda x: NOT contains(diff, x))) > 0 THEN 'false_reference' END AS reason FROM d) GROUP BY 1""")
def safety_filter_reasons(spark, sf_dir):
    names = text.names_changed(F.col("diff"), text.SMALL_STOP)
    df = _derived(spark, sf_dir).select(F.coalesce(curate.rewrite_reason(F.col("review"), F.col("text"), F.col("diff"), names), F.lit("rewritten")).alias("family"))
    counts = df.groupBy("family").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("family", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


@_query(_DERIVED + "SELECT doc_id, 'src/' || p || '.py' AS path FROM d UNION ALL SELECT doc_id, 'lib/x.ts' FROM d")
def diff_paths(spark, sf_dir):
    return _derived(spark, sf_dir).select("doc_id", F.explode(text.diff_paths(F.col("diff"))).alias("path"))


@_query(_DERIVED + """SELECT d.doc_id, CAST(count(*) FILTER (WHERE k.path = 'src/' || p || '.py' OR k.path = 'lib/x.ts') AS INT) AS n_grounded,
  CAST(count(k.i) FILTER (WHERE k.path IS NULL OR k.path <> 'src/' || p || '.py' AND k.path <> 'lib/x.ts') AS INT) AS n_ungrounded FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def grounded_comments(spark, sf_dir):
    out = curate.grounded(_derived(spark, sf_dir).withColumnRenamed("labels", "reference_comments"))
    return out.select("doc_id", F.size("grounded").alias("n_grounded"), "n_ungrounded")


@_query("SELECT round(avg(length(text)), 4) AS mean_length, round(quantile_cont(length(text), 0.5), 4) AS median_length, round(quantile_cont(length(text), 0.95), 4) AS p95_length FROM documents")
def length_stats(spark, sf_dir):
    n = F.length("text")
    return _table(spark, sf_dir, "documents").agg(F.round(F.avg(n), 4).alias("mean_length"), F.round(F.percentile(n, F.lit(0.5)), 4).alias("median_length"), F.round(F.percentile(n, F.lit(0.95)), 4).alias("p95_length"))


@_query()
def loop_detect(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.loops(F.col("text")).alias("loops"))


@_query("SELECT page_id, trim(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), ' ' || chr(9) || chr(10) || chr(13)) AS block FROM pages")
def extract_first_block(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.strip(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)).alias("block"))


_RAW = [(1, "<think>a <review>...</review></think>\n<review>Fix `x`</review>"), (2, "plain text "), (3, "<review>one</review><review>...</review>"), (4, "<think>no end"), (5, "")]


@_query("SELECT * FROM (VALUES (1, 'Fix `x`', false), (2, 'plain text', false), (3, 'one', false), (4, '<think>no end', true), (5, '', false)) v(id, review, unfinished)")
def extract_review(spark, sf_dir):
    df = spark.createDataFrame(_RAW, "id int, raw string")
    return df.select("id", text.review_block(F.col("raw")).alias("review"), reward.unfinished(F.col("raw")).alias("unfinished"))


_ANSWERS = [(1, "A", False), (2, "A", True), (3, "???", False), (4, "tie, A", False), (5, "b wins", False)]


@_query("SELECT * FROM (VALUES (1, 'A', 5), (2, 'B', 5), (3, 'TIE', 5), (4, 'TIE', 5), (5, 'B', 5)) v(id, verdict, score)")
def parse_answers(spark, sf_dir):
    df = spark.createDataFrame(_ANSWERS, "id int, raw string, swapped boolean")
    return df.select("id", text.pairwise_verdict(F.col("raw"), F.col("swapped")).alias("verdict"), text.judge_score(F.col("raw")).alias("score"))


_GATES = [(1, False, True, 60.0, 55.0, 5.0, 5.0, 1.0, 2.0), (2, True, True, 60.0, 55.0, 5.0, 5.0, 1.0, 2.0), (3, True, False, 60.0, 55.0, 5.0, 5.0, -1.0, 2.0), (4, True, False, 60.0, 55.0, 5.0, 6.01, 1.0, 2.0),
          (5, True, False, 60.0, 55.0, 5.0, 6.0, 1.0, 12.0), (6, True, False, 60.0, 55.0, 5.0, 6.0, 1.0, 2.0), (7, True, False, 60.0, 49.0, 5.0, 5.0, 1.0, 2.0), (8, True, False, 50.5, 51.0, 5.0, 5.0, 1.0, 2.0)]


@_query("SELECT * FROM (VALUES (1, 'ABORTED'), (2, 'FAILED'), (3, 'DO_NOT_SHIP'), (4, 'FAILED'), (5, 'SUSPICIOUS'), (6, 'SHIP'), (7, 'INCONCLUSIVE'), (8, 'FAILED')) v(id, verdict)")
def decision_gate(spark, sf_dir):
    df = spark.createDataFrame(_GATES, "id int, variance_gate_passed boolean, training_diverged boolean, wins_pct double, ci_lo double, halluc_a double, halluc_b double, cross_check_lift double, per_domain_spread double")
    return df.select("id", stats.decide({c: F.col(c) for c in df.columns}).alias("verdict"))


@_query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins_dedup(spark, sf_dir):
    return curate.last_wins(_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2")
def cap_n_per_group(spark, sf_dir):
    return curate.cap_per_group(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 2)


@_query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 200 THEN 'eval' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return curate.hash_split(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@_query()
def seeded_split(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return curate.seeded_split(docs, "doc_id", docs.count())


@_query("SELECT doc_id FROM documents WHERE lower(split_part(source, '/', 1)) NOT IN (SELECT DISTINCT lower(source) FROM documents WHERE doc_id % 10 = 0)")
def leakage_antijoin(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
    return curate.without_repos(docs, docs.where("doc_id % 10 = 0")).select("doc_id")


@_query()
def near_dup_antijoin(spark, sf_dir):
    return rouge.without_near(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", curate.reference_tail(_table(spark, sf_dir, "benchmark"), "item_id", "text")).select("doc_id")


@_query()
def text_overlap_scores(spark, sf_dir):
    df = _derived(spark, sf_dir).withColumn("s", rouge.text_scores(F.col("review"), F.array_join(F.transform("labels", lambda x: x["text"]), " ")))
    return df.agg(*(F.round(F.avg(f"s.{c}"), 6).alias(c) for c in ("bleu4", "rouge1", "rouge2", "rougel")))


@_query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""")
def chat_prompt(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    piece = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"]), "").alias("prompt"))


@_query("""SELECT doc_id, length(coalesce(text, '')) AS n, CAST(least(length(coalesce(text, '')), CASE WHEN length(coalesce(text, '')) <= 400 THEN 12000 ELSE 337 END) AS INT) AS kept FROM documents""")
def prompt_budget(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(body).alias("n"), F.length(curate.budgeted(body, lambda x: F.length(x), 400)).alias("kept"))


@_query("""SELECT doc_id, issue_type FROM (SELECT doc_id, 'correctness' AS issue_type FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'style' FROM labels WHERE toxic = 1) WHERE issue_type <> 'style'""")
def style_filter(spark, sf_dir):
    kinds = F.array_compact(F.array(F.when(F.col("quality") == 0, "correctness"), F.when(F.col("toxic") == 1, "style")))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.transform(kinds, lambda k: F.struct(k.alias("issue_type"))).alias("defects"))
    return curate.without_style(labels).select("doc_id", F.explode("defects").alias("d")).select("doc_id", "d.issue_type")


@_query(r"""SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0
  AND regexp_matches(coalesce(text, ''), '(?i)(^|[^a-z0-9_À-ÿ])(bug|issue|error|incorrect|wrong|missing|fail|broken|vulnerab|leak|race|en|de|is)([^a-z0-9_À-ÿ]|$)')
  AND NOT regexp_matches(left(coalesce(text, ''), 40), '(?i)(^|[^a-z0-9_À-ÿ])(bug|issue|error|incorrect|wrong|missing|fail|broken|vulnerab|leak|race|en|de|is)([^a-z0-9_À-ÿ]|$)')""")
def disagreement_candidates(spark, sf_dir):
    """Documents that a label calls clean, where one model asserts a defect and the other is quiet; short function words stand for assertions too, as the texts are invented."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id")
    common = F.lit(r"(?i)(^|[^a-z0-9_À-ÿ])(en|de|is)([^a-z0-9_À-ÿ]|$)")
    says = lambda c: text.asserts(c) | F.rlike(F.coalesce(c, F.lit("")), common)
    a, b = F.col("text"), F.substring("text", 1, 40)
    return docs.where(says(a) & text.is_quiet(b) & ~says(b)).select("doc_id")


from . import more  # noqa: E402, F401  registers the others
