"""Shared storage, bounded batches, size-checked joins and components for the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000
#: Narrow rows of a file, where their number is known.
FILE_ROWS = 200_000
#: At most so many keys are hot, at any size: a hot key has more than this share of the rows.
HOT_KEYS = 100_000
#: Rows that the Parquet reader and Arrow hold at once. Spark's defaults are for narrow rows; texts
#: of megabytes would make a batch of gigabytes. Settings that the session has changed stay.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}

_folders: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> SparkSession:
    """Sets BATCHES in the session, where it still has Spark's defaults."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    return spark


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, removed when Python ends.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only in a local session
    without it (tests) a folder under the warehouse takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marginmill"
    folder = f"{base.rstrip('/')}/marginmill-{uuid.uuid4().hex}"
    _folders.append((spark, folder))
    return folder


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of a work folder that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clean() -> None:
    """Deletes all work folders that this process has made."""
    while _folders:
        spark, folder = _folders.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            drop(spark, folder)


def written(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: cuts the lineage.

    rows, a bound of the number of narrow rows, if known: so few are written in few files.
    """
    path = f"{folder}/{name}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df, a table of narrow rows, has at most limit rows; counts no further."""
    return df.limit(limit + 1).count() <= limit


def semi_by_size(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids (distinct, one narrow column).

    ids is counted first: up to ``limit`` rows it is broadcast, beyond that both sides shuffle.
    """
    return df.join(F.broadcast(ids) if is_small(ids, limit) else ids, key, "left_semi")


def hot_limit(total: int) -> int:
    """Rows from which a key counts as hot: so that at most HOT_KEYS keys can be."""
    return max(1000, -(-total // HOT_KEYS))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row a key and in n how many of the total rows have it.

    Hot keys are joined by broadcast (at most HOT_KEYS narrow rows, by their counts), wherever their
    rows lie; the others shuffle, with a bounded number of rows a key. Key columns of table hold no nulls.
    """
    hot = F.broadcast(table.where(F.col(n) > hot_limit(total)))
    cold = table.where(F.col(n) <= hot_limit(total))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def _are_stars(edges: DataFrame) -> bool:
    """Has every a one b, and is no b an a? One pre-aggregated group-by."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").count()


def components(edges: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: (node, root), root the least node.

    Alternating large-star and small-star steps; each step is a pre-aggregated group-by and a join
    in which hubs, by their counts, are broadcast. Steps are written to the shared folder, so that
    nothing is collected and lineage stays short. Ends when all edges are stars around least nodes.
    rows: a bound of the number of edges, if known.
    """
    spark, step, path = edges.sparkSession, 0, f"{folder}/{name}-0"
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0", rows)
    while not _are_stars(now):
        step += 1
        n = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large-star: every larger neighbour of a node is tied to the node's least neighbour
        large = join_counted(both.where("b > a"), least, ["a"], "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), folder, f"{name}-{step}a", n)
        # small-star: the node itself and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], "n", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), folder, f"{name}-{step}b", 2 * n)
        drop(spark, path, f"{folder}/{name}-{step}a")
        path = f"{folder}/{name}-{step}b"
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
