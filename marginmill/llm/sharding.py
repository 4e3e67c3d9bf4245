"""A uniform shuffle into shards of exact sizes.

Rows lie in local partitions by a hash. The numbers of rows that each partition sends to each shard
form a matrix whose rows have the partitions' counts and whose columns the shards' sizes; a uniform
shuffle has a multivariate hypergeometric law for it, from which it is drawn exactly. Each partition
permutes its rows and cuts them by its row of the matrix; after the exchange each shard permutes
what it got. The permutations rank keyed hashes of a row and of its number among the rows that equal
it, so equal rows part like any others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that are sorted together, about; the number of local partitions follows from it.
LOCAL_ROWS = 50_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> tuple[np.ndarray, list[int]]:
    """Rows that partition i sends to shard j; shard sizes differ by one at most."""
    total, rng = sum(counts), np.random.default_rng(seed)
    room = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    sizes, out = room.tolist(), np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        # many small draws: each is a hypergeometric split of what is left, shard by shard
        left, pool = n, int(room.sum())
        for j in range(shards):
            pool -= int(room[j])
            x = left if pool == 0 else _split(rng, int(room[j]), pool, left)
            out[i, j], left = x, left - x
        room -= out[i]
    return out, sizes


def _split(rng, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw: how many of n drawn from good + bad are good."""
    if not n or not good:
        return 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # beyond numpy's limit: inversion over 12 standard deviations, exact to double precision
    share = good / (good + bad)
    spread = int(12 * np.sqrt(n * share * (1 - share)) + 30)
    middle = int(n * share)
    low, high = max(0, n - bad, middle - spread), min(n, good, middle + spread)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def numbered(rows: DataFrame, chunk: int = LOCAL_ROWS) -> tuple[DataFrame, int]:
    """rows (one column, ``row``) with ``_c``, their number from 0 among the rows that equal them; and how many there are.

    Equal rows are counted before the shuffle and unfolded again, in chunks that are dealt out where
    a row repeats more than chunk times; so no group of equal rows meets in one task.
    """
    counted = shared.written(rows.groupBy("row").agg(F.count("*").alias("_n")), shared.work_folder(rows.sparkSession), "counted")
    total, most = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    chunks = counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    if most > chunk:
        chunks = chunks.repartition("row", "_k")
    first = F.col("_k") * chunk
    return chunks.select("row", F.explode(F.sequence(first, F.least(F.col("_n"), first + chunk) - 1)).alias("_c")), total


def shard_rows(df: DataFrame, shards: int = 40, seed: int = 1, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """df with ``shard`` (0 to shards-1, numbers of rows at most one apart) and ``slot`` (gapless from 0).

    All columns count as identity: rows that are equal in all of them are interchangeable, so reruns
    agree, but each of them is dealt on its own. Nulls are values like others. An empty table gives
    no rows. Columns named shard or slot are replaced. Wide columns are moved several times; to shard
    wide rows, shard their keys. The driver draws a matrix of a row per local_rows rows and a
    column a shard; Spark joins it by its size.
    """
    df = df.drop("shard", "slot")
    plain = [F.col(f"row.`{c}`") for c in df.columns]
    rows, n = numbered(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")), local_rows)
    parts = int(max(1, -(-n // local_rows), min(256, n // 100)))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_c", *plain)).withColumn("_g", F.xxhash64(F.lit(seed + 1), "_c", "_h", *plain))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64(F.lit(seed + 2), "_h"), F.lit(parts)).cast("int"))
    counts = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # a number a partition
    matrix, sizes = communication_matrix([counts.get(i, 0) for i in range(parts)], shards, seed)
    table = [(i, [int(x) for x in np.cumsum(matrix[i])]) for i in range(parts)]
    cuts = df.sparkSession.createDataFrame(table, "_p int, _cuts array<long>")
    local = Window.partitionBy("_p").orderBy("_h", *plain, "_c")
    rows = rows.withColumn("_r", F.row_number().over(local) - 1).join(cuts, "_p")
    rows = rows.withColumn("shard", F.expr("size(filter(_cuts, x -> x <= _r))")).drop("_cuts", "_r", "_p", "_h")
    # after the exchange: the rank of _g in the shard, by its leading bits and then within them
    bits = max(0, int(np.ceil(np.log2(max(1, max(sizes, default=0) / local_rows)))))
    bits = max(bits, min(5, int(np.log2(max(1, n // (shards * 50))))))
    rows = rows.withColumn("_b", F.expr(f"cast(shiftrightunsigned(_g, {64 - bits}) as int)") if bits else F.lit(0))
    rows = shared.written(rows, shared.work_folder(df.sparkSession), "dealt")
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_b").count().select("shard", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("shard", "_b").orderBy("_g", *plain, "_c")
    rows = rows.withColumn("_s", F.row_number().over(within) - 1).join(offsets, ["shard", "_b"])
    return rows.select("row.*", "shard", (F.col("_o") + F.col("_s")).cast("long").alias("slot"))
