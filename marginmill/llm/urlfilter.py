"""URL filters as a sort-merge range join of reversed-host keys.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
On the axis of reversed hosts (``com.example.``) a rule's host is the interval of all keys that it is
a prefix of; intervals nest, at most one at each depth of labels. Urls and openings of intervals are
sorted together on the axis of reversed host, path and page, dealt by ranges of it, and swept once:
the stack has a place for each depth, an opening takes the place of its depth, and intervals that
have closed show in that they are no prefix of the point. An opening carries the rules of its host;
the longest that the path starts with wins.

Ranges split hosts and even single urls with many pages. A range starts with the stack that is open
at its first key: the prefixes of that key. Hosts with more than HOST_RULES rules carry none; what
they say is looked up by the prefixes of the path, for the pages in their interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of a host that an opening carries along the sweep.
HOST_RULES = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def axis_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(rules: Column) -> Column:
    """The longest of an array of rules; of equally long ones that with the longer path."""
    return F.array_max(F.transform(rules, lambda r: F.struct(F.length(r["rule"]).alias("size"), F.length(r["path"]).alias("depth"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", host_rules: int = HOST_RULES) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules has host, path and verdict (allow or block). A null path is empty; rules without a host
    are left out; of rules that repeat, block wins; of equally long ones that fit, the longer path.
    No rule: rule is null and the verdict is the default. Null urls, or those without ``://``, have
    an empty host and path and fit no rule. Rows that repeat are all returned; further columns of
    pages are ignored. An empty table gives no rows.
    """
    folder = shared.work_folder(pages.sparkSession)
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = rules.where("host is not null and trim(host) <> ''").select(F.translate(F.trim("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block before allow
    own = shared.written(own.select(axis_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict"), folder, "rules")
    kind = "array<struct<path: string, rule: string, verdict: string>>"
    count = own.groupBy("key").agg(F.count("*").alias("n"))
    openings = own.join(count.where(F.col("n") <= host_rules), "key").groupBy("key").agg(F.collect_list(F.struct("path", "rule", "verdict")).alias("carried"))
    openings = openings.unionByName(count.where(F.col("n") > host_rules).select("key", F.lit(None).cast(kind).alias("carried")))  # too many to carry
    openings = openings.withColumn("depth", F.regexp_count("key", F.lit(r"\.")).cast("int"))
    openings = shared.written(openings, folder, "openings")
    depths = sorted(r["depth"] for r in openings.select("depth").distinct().collect())  # of labels: a host name has 127 at most

    events = urls.where("host <> ''").select(axis_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast(kind).alias("carried"), F.lit(None).cast("int").alias("depth"))
    none = F.lit(None)
    opens = openings.select("key", F.lit(0).alias("kind"), F.lit("").alias("path"), none.cast(urls.schema["page_id"].dataType).alias("page_id"), none.cast("string").alias("host"), "carried", "depth")
    ranged = events.unionByName(opens).repartitionByRange("key", "kind", "path", "page_id").withColumn("range", F.spark_partition_id())
    ranged = shared.written(ranged, folder, "ranged")  # so that ranges stay what they are
    # the stack at the start of a range: openings that are prefixes of its first key
    starts = ranged.groupBy("range").agg(F.min("key").alias("low"))
    labels = F.expr("filter(transform(sequence(1, length(low)), i -> substring(low, 1, i)), x -> endswith(x, '.'))")
    carry = starts.select("range", F.explode(labels).alias("key")).join(openings, "key")
    carry = carry.select(*(F.col(c) if c in carry.columns else F.lit(v).cast(t).alias(c) for c, v, t in (
        ("key", None, "string"), ("kind", 0, "int"), ("path", "", "string"), ("page_id", None, urls.schema["page_id"].dataType), ("host", None, "string"), ("carried", None, kind), ("depth", None, "int"), ("range", None, "int"))))
    sweep = Window.partitionBy("range").orderBy("key", "kind", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda d: F.last(F.when(F.col("depth") == d, F.struct("key", "carried")), ignorenulls=True).over(sweep)
    stack = F.array(*(place(d) for d in depths)) if depths else F.array().cast(f"array<struct<key: string, carried: {kind}>>")
    swept = ranged.unionByName(carry).withColumn("stack", stack).where("kind = 1")
    # open are those that are prefixes of the point
    swept = swept.withColumn("open", F.filter("stack", lambda s: F.coalesce(F.startswith(F.col("key"), s["key"]), F.lit(False))))
    fits = F.flatten(F.transform("open", lambda s: F.filter(F.coalesce(s["carried"], F.array().cast(kind)), lambda r: F.startswith(F.col("path"), r["path"]))))
    many = F.transform(F.filter("open", lambda s: s["carried"].isNull()), lambda s: s["key"])
    swept = swept.select("page_id", "host", "path", _top(fits).alias("top"), many.alias("many"))
    best = swept.select("page_id", "host", "path", "top")
    if count.where(F.col("n") > host_rules).limit(1).count():
        swept = shared.written(swept, folder, "swept")
        best = swept.where(F.size("many") == 0).select("page_id", "host", "path", "top").unionByName(_looked_up(swept.where(F.size("many") > 0), own, count.where(F.col("n") > host_rules)))
    none_fit = urls.where("host = ''").select("page_id", "host", "path", F.lit(None).cast(best.schema["top"].dataType).alias("top"))
    return best.unionByName(none_fit).select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _looked_up(rows: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows (page_id, host, path, top, many) with the longest of top and of the rules of the hosts in many."""
    lengths = rules.join(hosts, "key", "left_semi").groupBy("key").agg(F.collect_set(F.length("path")).alias("lengths"))
    points = rows.select("page_id", "host", "path", "top", F.explode("many").alias("key")).join(F.broadcast(lengths) if shared.is_small(lengths) else lengths, "key")
    cut = F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    points = points.select("page_id", "host", "path", "key", cut).withColumn("prefix", F.expr("substring(path, 1, n)"))
    found = rules.select("key", F.col("path").alias("prefix"), F.struct(F.length("rule").alias("size"), F.length("path").alias("depth"), "rule", "verdict").alias("own"))
    got = points.join(F.broadcast(found) if shared.is_small(found) else found, ["key", "prefix"]).groupBy("page_id", "host", "path").agg(F.max("own").alias("own"))
    got = got.select(F.struct("page_id", "host", "path").alias("page"), "own")
    out = rows.withColumn("page", F.struct("page_id", "host", "path"))
    out = out.join(got.withColumnRenamed("page", "its"), F.col("page").eqNullSafe(F.col("its")), "left")
    return out.select("page_id", "host", "path", F.greatest("top", "own").alias("top"))
