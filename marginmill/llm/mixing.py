"""Mixing sources to target weights by entropy balancing.

The rates are those nearest to 1, in relative entropy over words, that give each source its target
words and keep, as far as these allow, the words of each band of document lengths (powers of two).
A document has one constraint of either kind, so the constraints overlap; its rate is
exp(x of its source + y of its band), at most ``most``. The x and y solve the convex dual

    sum over documents of words * phi(x + y)  -  sum of target * x  -  sum of words of band * y  +  softness / 2 * sum of words of band * y^2

with phi' the rate. Given y, each source's x is the root of its own equation; so Newton's method
runs on y alone, with the Schur complement of the sources' diagonal block. Value, gradient and
Hessian are sums over the documents: documents of one source and band enter as one row of a table
that is aggregated once, each step is an aggregate over it, and what comes to the driver is
one number a pair of bands (at most 64 bands, by the range of lengths), however many sources.

Rates are rounded into whole copies by carrying the error from long documents to short ones within a
source, over the histogram of lengths; which of equally long documents get the copy more is decided
by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
#: How soft the constraints on bands are: a band may miss its words by softness * |y| of them.
SOFTNESS, STEPS, ROOT_STEPS = 0.1, 30, 80
#: Copies of equal rows that one task makes.
CHUNK = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (key, words) with weight and target words.

    Sources in the order of key weigh the given weights in turn and share the words of all. A target
    stops at most times its source's words; the excess is shared by weight again, until none is
    above. Each round is one aggregate.
    """
    spark, folder = sources.sparkSession, shared.work_folder(sources.sparkSession)
    # ranks by ranges: the ranges are written, so that they stay, and counted
    ranged = shared.written(sources.repartitionByRange("key").withColumn("range", F.spark_partition_id()), folder, "ranged")
    n = ranged.count()
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    offsets = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    df = ranged.join(offsets, "range").withColumn("rank", rank).select("key", "words", turn.alias("weight"))
    df = shared.written(df, folder, "weights", n)
    cap = F.lit(float(most)) * F.col("words")
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level > cap
        left, open_weight, n_full = df.agg(
            F.coalesce(F.sum("words"), F.lit(0)) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full)
        ).first()
        if n_full == capped or not open_weight:
            break
        capped, level = n_full, max(level, left / open_weight)
    return spark.read.schema(df.schema).parquet(f"{folder}/weights").withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def band(size):
    """The power of two that a length lies above."""
    return F.floor(F.log2(size.cast("double")) + 1e-9).cast("int")


def _rate(x, y, most: int):
    return F.least(F.exp(F.least(x + y, F.lit(50.0))), F.lit(float(most)))


def balance(goals: DataFrame, marginals: DataFrame, most: int = MOST, softness: float = SOFTNESS, steps: int = STEPS) -> DataFrame:
    """Rates of (key, band) from goals (key, target) and marginals (key, band, words): Newton on the dual.

    A source's words come to its target exactly, unless that is most times its words or more: then all
    its rates are most. Bands come to (1 - softness * y) times their words.
    """
    spark, folder = goals.sparkSession, shared.work_folder(goals.sparkSession)
    per = marginals.groupBy("key").agg(F.collect_list(F.struct("band", F.col("words").cast("double").alias("words"))).alias("cells")).join(goals, "key")
    per = shared.written(per.select("key", "cells", F.col("target").cast("double").alias("target")), folder, "per_source", goals.count())
    totals = {r["band"]: float(r["words"]) for r in marginals.groupBy("band").agg(F.sum("words").alias("words")).collect()}  # at most 64 bands
    bands = sorted(totals)
    w = np.array([totals[b] for b in bands])
    number = F.create_map(*(F.lit(v) for b in enumerate(bands) for v in b[::-1])) if bands else None

    def solved(y: np.ndarray) -> DataFrame:
        """per with x, each source's multiplier given those of the bands, by bisection."""
        by_band = F.array(*(F.lit(float(v)) for v in y))
        cells = F.transform("cells", lambda c: F.struct(c["band"].alias("band"), c["words"].alias("words"), F.get(by_band, number[c["band"]]).alias("y")))
        df = per.withColumn("cells", cells)
        halve = lambda s, _: F.when(
            F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["words"] * _rate((s["lo"] + s["hi"]) / 2, c["y"], most)) < F.col("target"),
            F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
        return df.withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(ROOT_STEPS)), F.struct(F.lit(-40.0).alias("lo"), F.lit(40.0).alias("hi")), halve)["hi"])

    def look(y: np.ndarray):
        """Value, gradient and Hessian of the dual in y, with the sources' multipliers at their roots: one aggregate."""
        edge, at = float(np.log(most)), {b: i for i, b in enumerate(bands)}
        cells = F.transform(
            "cells",
            lambda c: F.struct(
                c["band"].alias("band"), (c["words"] * _rate(F.col("x"), c["y"], most)).alias("mass"),
                F.when(F.col("x") + c["y"] < edge, c["words"] * F.exp(F.col("x") + c["y"])).otherwise(0.0).alias("live"),
                F.when(F.col("x") + c["y"] < edge, c["words"] * F.exp(F.col("x") + c["y"])).otherwise(c["words"] * (most + most * (F.col("x") + c["y"] - edge))).alias("phi"),
            ),
        )
        df = solved(y).select("x", "target", cells.alias("cells"))
        df = df.withColumn("sum", F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["live"]))
        entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
        value = entry(F.lit(-1), F.lit(-1), F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["phi"]) - F.col("target") * F.col("x"))
        mass = F.transform("cells", lambda c: entry(c["band"], F.lit(-1), c["mass"]))
        live = F.transform("cells", lambda c: entry(c["band"], F.lit(-2), c["live"]))
        cross = F.flatten(F.transform("cells", lambda c: F.transform("cells", lambda d: entry(c["band"], d["band"], F.when(F.col("sum") > 0, c["live"] * d["live"] / F.col("sum")).otherwise(0.0)))))
        got = df.select(F.explode(F.concat(F.array(value), mass, live, cross)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v")).collect()
        total, slope, curve = 0.0, softness * w * y - w, np.diag(softness * w)
        for r in got:  # at most 64 * 66 + 1 numbers
            if r["i"] < 0:
                total = r["v"]
            elif r["j"] == -1:
                slope[at[r["i"]]] += r["v"]
            elif r["j"] == -2:
                curve[at[r["i"]], at[r["i"]]] += r["v"]
            else:
                curve[at[r["i"]], at[r["j"]]] -= r["v"]
        return total + float((-w * y + softness / 2 * w * y * y).sum()), slope, curve

    y = np.zeros(len(bands))
    if len(bands) and softness < np.inf:
        value, slope, curve = look(y)
        for _ in range(steps):
            if np.abs(slope).max() <= 1e-9 * w.sum():
                break
            move, size = -np.linalg.solve(curve, slope), 1.0
            while size > 1e-6:  # shorter steps until the value falls
                new = look(y + size * move)
                if new[0] <= value + 1e-4 * size * float(slope @ move) + 1e-9 * abs(value):
                    break
                size /= 2
            y, (value, slope, curve) = y + size * move, new
    if not bands:
        return marginals.select("key", "band", F.lit(1.0).alias("rate"))
    out = solved(y).select("key", "x", F.explode("cells").alias("c"))
    return out.select("key", F.col("c.band").alias("band"), _rate(F.col("x"), F.col("c.y"), most).alias("rate"))


def _quotas(batches):
    """Of rows (key, size, n, rate) sorted by key and falling size: how many of the n get a copy more."""
    key, carry = object(), 0.0
    for batch in batches:
        out = []
        for k, z, n, rate in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                key, carry = k, 0.0
            base = np.floor(rate + 1e-9)
            want = max(rate - base, 0.0) * n * z + carry
            m = int(min(max(round(want / z), 0), n)) if z and rate > base + 1e-9 else 0
            carry = want - m * z if z else carry
            out.append((k, z, n, int(base), m))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "size", "n", "base", "more"])


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of docs as ``row``, with key (source), size and two hashes of all columns."""
    plain = [F.col(f"`{c}`") for c in docs.columns]
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    # in code point order, null last
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">"))
    return docs.select(F.struct(*plain).alias("row"), key.alias("key"), size.alias("size"), F.xxhash64(F.lit(seed), *plain).alias("h"), F.xxhash64(F.lit(seed + 1), *plain).alias("g"))


class _Plan:
    """What the mix decides: goals by source, quotas by source and length, and the equal rows that get one copy more.

    Equal rows (in all columns) are one identity (key, size, h, g) with the number of its rows; an
    identity's rows are counted before the shuffle, so repeated rows are no hot key.
    """

    def __init__(self, docs: DataFrame, weights, most: int, softness: float, seed: int, group: int | None):
        self.spark, self.folder = docs.sparkSession, shared.work_folder(docs.sparkSession)
        folder = self.folder
        rows = _measured(docs, seed).select(F.col("row.doc_id").alias("doc_id"), "key", "size", "h", "g")
        self.rows = shared.written(rows.groupBy("doc_id", "key", "size", "h", "g").agg(F.count("*").alias("m")), folder, "rows")
        n = self.rows.count()
        cells = shared.written(self.rows.groupBy("key", "size").agg(F.sum("m").alias("n")), folder, "cells", n)
        n = cells.count()
        self.goals = targets(cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights, most)
        marginals = cells.where("size > 0").groupBy("key", band(F.col("size")).alias("band")).agg(F.sum(F.col("n") * F.col("size")).alias("words"))
        self.rates = balance(self.goals, marginals, most, softness)
        rated = cells.withColumn("band", band(F.col("size"))).join(self.rates, ["key", "band"], "left")
        rated = rated.select("key", "size", "n", F.when(F.col("size") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0).alias("rate"))
        sorted_cells = rated.repartition("key").sortWithinPartitions("key", F.desc("size"))
        self.quotas = shared.written(sorted_cells.mapInArrow(_quotas, "key string, size long, n long, base int, more long"), folder, "quotas", n)
        self.total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        group = group or shared.hot_limit(self.total) // 2  # rows that are ranked together
        df = shared.join_counted(self.rows, self.quotas, ["key", "size"], "n", self.total)
        # large cells are ranked bucket by bucket
        df = df.withColumn("slots", F.when(F.col("n") > group, F.ceil(F.col("n") / group)).otherwise(F.lit(1)).cast("long"))
        df = df.withColumn("b", _slot("slots", seed))
        before = Window.partitionBy("key", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        buckets = df.where(F.col("n") > group).groupBy("key", "size", "b").agg(F.sum("m").alias("m"))
        buckets = buckets.select("key", "size", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("o"))
        within = Window.partitionBy("key", "size", "b").orderBy("h", "g", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("first", F.coalesce(F.sum("m").over(within), F.lit(0))).join(buckets, ["key", "size", "b"], "left")
        left = F.col("more") - F.col("first") - F.coalesce("o", F.lit(0))
        #: of an identity's m rows, q get base + 1 copies
        self.drawn = df.withColumn("q", F.greatest(F.lit(0).cast("long"), F.least(left, F.col("m")))).select("doc_id", "key", "size", "h", "g", "m", "base", "q", "b", "slots")


def _slot(slots: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed + 2), "h"), F.col(slots)).cast("int")


def _unfolded(df: DataFrame, n, *by: str) -> DataFrame:
    """df, each row as often as n says; more than CHUNK of a row are dealt out in chunks."""
    df = df.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    df = df.repartition(*by, "_k") if by else df
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("_n") - F.col("_k") * CHUNK)))).drop("_n", "_k", "_i")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, softness: float = SOFTNESS, seed: int = 3, group: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    size counts words (null text: 0); documents without words have no copies. A null source is a
    source of its own. Reruns agree: rows that equal each other in all columns are interchangeable,
    and each is drawn on its own. An empty table gives no rows; further columns only tell rows apart.
    """
    plan = _Plan(docs, weights, most, softness, seed, group)
    kinds = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("q").alias("n")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("q")).alias("n")))
    df = plan.drawn.select("doc_id", "key", "size", F.explode(kinds).alias("kind")).select("doc_id", "key", "size", "kind.copies", "kind.n")
    df = _unfolded(df, F.col("n")).drop("n")
    # the sources are few, but one may have a third of the rows: joined by the rows each has
    counted = plan.quotas.groupBy("key").agg(F.sum("n").alias("n")).join(plan.goals.select("key", F.col("words").alias("source_size"), "target"), "key")
    df = shared.join_counted(df, shared.written(counted, plan.folder, "counted", plan.goals.count()), ["key"], "n", plan.total)
    source = F.when(F.col("key").startswith("="), F.substring("key", 2, 1 << 30))
    return df.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, softness: float = SOFTNESS, seed: int = 3, group: int | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Texts aren't shuffled, unless there are more than BROADCAST_ROWS pairs of source and length: a row
    finds its copies by these and its hashes. Only equal rows of which the mix takes some once more
    than others are put together first.
    """
    plan = _Plan(docs, weights, most, softness, seed, group)
    # in a cell (source and length) the rows up to a place in the order of the draw get one copy more
    place = F.struct("b", "h", "g")
    drawn = plan.drawn.groupBy("key", "size").agg(
        F.sum("m").alias("n"), F.first("base").alias("base"), F.max(F.when(F.col("q") == F.col("m"), place)).alias("up_to"),
        F.max(F.when((F.col("q") > 0) & (F.col("q") < F.col("m")), F.struct(place.alias("at"), "m", "q"))).alias("part"), F.max("slots").alias("slots"),
    )
    cells = shared.written(drawn, plan.folder, "cells_drawn", plan.quotas.count())
    rows = _measured(docs, seed)
    if shared.is_small(cells):
        rows = rows.join(F.broadcast(cells), ["key", "size"])
    else:
        rows = shared.join_counted(rows, cells, ["key", "size"], "n", plan.total)
    rows = rows.withColumn("place", F.struct(_slot("slots", seed).alias("b"), "h", "g"))
    in_part = F.coalesce(F.col("place") == F.col("part.at"), F.lit(False))
    plain = rows.where(~in_part).select("row", (F.col("base") + F.coalesce(F.col("place") <= F.col("up_to"), F.lit(False)).cast("int")).alias("copies"))
    out = plain.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("_i")).select("row")
    if cells.where("part is not null").limit(1).count():  # equal rows of which some get one copy more than others
        equal = rows.where(in_part).groupBy("key", "size", "h", "g").agg(F.any_value("row").alias("row"), F.any_value("base").alias("base"), F.any_value("part").alias("part"))
        out = out.unionByName(_unfolded(equal, F.col("part.m") * F.col("base") + F.col("part.q"), "h", "g").select("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
