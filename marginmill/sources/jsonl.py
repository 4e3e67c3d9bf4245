"""JSON-lines sources and sinks with explicit schemas, strict or tolerant, and resumable outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import curate

COMMENT = "struct<path: string, line: int, text: string>"
DEFECT = "struct<path: string, line: int, issue_type: string, canonical_desc: string>"
RAW = (
    "instance_id string, repo string, language string, commit_to_review struct<head_commit: string, patch_to_review: string>, "
    "reference_review_comments array<struct<text: string, path: string, diff_hunk: string, line: int, start_line: int, original_line: int, original_start_line: int>>, "
    "metadata struct<problem_domain: string, difficulty: string, estimated_review_effort: int>"
)
SCHEMAS = {
    "ood_input": f"instance_id string, repo string, diff string, reference_comments array<{COMMENT}>, reference_text string, difficulty string, problem_domain string",
    "ood_preds": f"instance_id string, repo string, diff string, reference_comments array<{COMMENT}>, reference_text string, difficulty string, problem_domain string, v4_pred string, base_pred string",
    "defect_labels": f"instance_id string, defects array<{DEFECT}>, n_ungrounded int",
    "oracle_preds": "instance_id string, diff string, oracle_pred string",
    "base_samples": "instance_id string, base_output string",
    "train_rows": "instruction string, input string, output string, repo string, rewrite_status string",
    "traces": "_idx long, output string, trace_status string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def strict(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Blank lines are skipped, malformed ones fail the query."""
    return spark.read.schema(schema(name)).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Malformed lines are dropped."""
    full = T.StructType([*schema(name).fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")


def labels(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Defect labels; missing defects are none, a missing n_ungrounded is 0. Of rows with one id the last line counts.

    order, a column of the lines, says which is last; without one it is the place in the files.
    """
    rows = strict(spark, path, "defect_labels") if order is None else spark.read.schema(T.StructType([*schema("defect_labels").fields, T.StructField(order, T.LongType())])).option("mode", "FAILFAST").json(path)
    rows = rows.select("instance_id", F.coalesce("defects", F.array().cast(f"array<{DEFECT}>")).alias("defects"), F.coalesce("n_ungrounded", F.lit(0)).alias("n_ungrounded"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_at"))
    return curate.last_wins(rows, "instance_id", "_at").drop("_at")


def base_samples(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with base_output from the cache; a row that it lacks fails the query."""
    return curate.must_match(rows, cache.select("instance_id", "base_output"), "instance_id", "cached base sample")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def trained_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repository names of a training file; the default ones if it is missing or names none."""
    rows = tolerant(spark, path, "train_rows") if exists(spark, path) else None
    return curate.trained_repos(rows, spark)


def source_split(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """The exported split (test or dev) of the source, as Parquet or JSON lines."""
    if split not in ("test", "dev"):
        raise ValueError(f"unknown split: {split!r}")
    parquet = f"{folder}/{split}.parquet"
    return spark.read.parquet(parquet) if exists(spark, parquet) else spark.read.schema(T.StructType.fromDDL(RAW)).json(f"{folder}/{split}.jsonl")


def compact(spark: SparkSession, path: str, name: str, key: str, done: Callable[[], Column]) -> DataFrame:
    """Keys that are done in an earlier output; rows to try again are taken out of it, and only then it is written anew.

    The new rows are written beside the old ones and take their place when they are whole.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([f for f in schema(name).fields if f.name == key]))
    kept, keys, lost = curate.resumed(tolerant(spark, path, name), key, done())
    if not lost:
        return keys
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    kept.write.mode("overwrite").json(new)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)
    return tolerant(spark, path, name).where(F.col(key).isNotNull()).select(key).distinct()


def checkpoints(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> list[tuple[int, str]]:
    """(step, path) of the folders named by step, in its order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [(s.getPath().getName(), str(s.getPath())) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory()]
    return sorted((int(n[len(prefix) :]), path) for n, path in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def shards_whole(spark: SparkSession, folder: str, index: str = "model.safetensors.index.json", pattern: str = "*.safetensors") -> bool:
    """Whether the shards' bytes come to what the index says; False without an index or a size."""
    if not exists(spark, f"{folder}/{index}"):
        return False
    total = spark.read.text(f"{folder}/{index}", wholetext=True).select(F.get_json_object("value", "$.metadata.total_size").cast("long")).first()[0] or 0
    have = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return total > 0 and have >= total


def viewed(rows: DataFrame, status: str, value: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """n rows of a status, by a seeded hash of their key (a view, so the order is fixed by the seed)."""
    return rows.where(F.col(status) == value).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def probed(spark: SparkSession, candidates: list[str], fields: tuple[str, ...] = ("review_only", "sft_pred", "v4_pred", "review", "output"), n: int = 20, seed: int = 42) -> DataFrame | None:
    """Up to n reviews of the first candidate file that is there: the first of the fields that its rows have; None without one."""
    for path in candidates:
        if exists(spark, path):
            rows = spark.read.json(path)
            found = next((f for f in fields if f in rows.columns), None)
            if found:
                body = F.col(found).cast("string")
                block = F.regexp_extract(body, "(?s)<review>(.*?)</review>", 1)
                body = F.when((F.lit(found) == "output") & body.rlike("(?s)<review>.*?</review>"), text.strip(block)).otherwise(body)
                return rows.select(body.alias("review")).where("review <> ''").orderBy(F.xxhash64(F.lit(seed), "review")).limit(n)
    return None


def document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document over several lines."""
    return spark.read.option("multiLine", True).json(path)


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def report(rows: DataFrame, path: str) -> None:
    """A nested report as JSON text."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def to_do(rows: DataFrame, done: DataFrame, key: str, transient: Column | None = None) -> DataFrame:
    """Rows whose key isn't in what is done; results with a transient status are to be done again."""
    kept = done if transient is None else done.where(~transient)
    return rows.join(kept.select(key).distinct(), key, "left_anti")
