"""Line deduplication by content-defined spans of lines.

A rolling hash over the hashes of the last two lines chooses the boundaries of chunks, so the same
passage is cut alike wherever it stands. Chunks with two lines of words or more that occur anywhere
before, in order of doc_id and place, are removed; equal hashes only nominate them, their bytes decide.

The first and last chunk of a shared passage reach into its neighbours. So besides chunks each line
begins and ends a window: the fewest lines from it on, and up to it, that have ``window_words``
words. A repeated passage of so many words is the union of windows that lie in it, so it goes whole,
whatever its neighbours, be it one long line or many. Windows are compared like chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MODULUS, WINDOW = 3, 2
SPAN = "doc_id long, t long, at int, lines int, h1 long, h2 long"


def chunks(body: str) -> Iterator[tuple[list[str], bool]]:
    """(lines, whether they may be removed) of a whole text; the lines of all chunks are those of the text."""
    out, recent = [], []
    for line in body.split("\n"):
        out.append(line)
        recent = [*recent, hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()][-WINDOW:]
        if len(out) > 1 and int.from_bytes(hashlib.blake2b(b"".join(recent), digest_size=4).digest(), "big") % MODULUS == 0:
            yield out, sum(1 for x in out if x.strip()) > 1
            out = []
    if out:
        yield out, sum(1 for x in out if x.strip()) > 1


def windows(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """First line and end of the fewest lines of least words from each line on, and up to each line."""
    lo = hi = total = 0
    for lo in range(len(words)):
        while total < least and hi < len(words):
            total += words[hi]
            hi += 1
        if total < least:
            break
        yield lo, hi
        total -= words[lo]
    lo = total = 0
    for hi, n in enumerate(words, 1):
        total += n
        while total - words[lo] >= least:
            total -= words[lo]
            lo += 1
        if total >= least:
            yield lo, hi


def spans(body: str, window_words: int) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines of a text, and (first line, end) of what may be removed."""
    all_lines, at, found = body.split("\n"), 0, set()
    for lines, may in chunks(body):
        if may:
            found.add((at, at + len(lines)))
        at += len(lines)
    found.update(windows([len(x.split()) for x in all_lines], window_words))
    return all_lines, sorted(found)


def _digests(lines: list[str]) -> bytes:
    return b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines)


def _hash(digests: bytes, at: int, end: int, bits: int) -> tuple[int, int]:
    d = int.from_bytes(hashlib.blake2b(digests[16 * at : 16 * end], digest_size=16).digest(), "big") >> (128 - bits)
    return tuple(int.from_bytes((d >> k & (2**64 - 1)).to_bytes(8, "big"), "big", signed=True) for k in (0, 64))


def _emit(with_text: bool, window_words: int, bits: int):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *((pa.string(),) if with_text else ()))
    names = [x.split()[0] for x in SPAN.split(", ")] + ["body"] * with_text

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, t, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines, found = spans(body.as_py() or "", window_words)
                digests = _digests(lines) if found else b""
                for at, end in found:
                    rows.append((doc_id, t, at, end - at, *_hash(digests, at, end, bits), *(("\n".join(lines[at:end]),) if with_text else ())))
                    if len(rows) > 20_000:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out = []
    for body, removed in zip(text, gone, strict=True):
        if body is None:
            out.append((None, 0, 0))
            continue
        lines = body.split("\n")
        if removed is None or not len(removed):
            out.append((body, len(lines), 0))
            continue
        drop = {i for r in removed for i in range(r["at"], r["at"] + r["lines"])}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)))
    return pd.DataFrame(out, columns=["clean_text", "n_lines", "n_removed_lines"])


def _repeats(spans_: DataFrame, first: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Spans that aren't the first of their key, nor overlap it in the same document."""
    df = shared.join_counted(spans_, first, keys, "n", total)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    return df.where(~(same & (F.col("at") < F.col("first.at") + F.col("lines")))).select("doc_id", "t", "at", "lines")


def without_repeats(docs: DataFrame, window_words: int = 50, bits: int = 128) -> DataFrame:
    """docs with clean_text, n_lines and n_removed_lines.

    The first occurrence of a span, by least doc_id (null last) and then place, stays, and so do those
    in the same document that overlap it. A null text stays null and has no lines; an empty one has
    one. Rows with the same doc_id and text are one document; rows that only share a doc_id, or have
    none, are told apart by a hash of their texts. Very long texts are split into spans one text at a
    time. Columns with the added names are replaced. An empty table gives no rows. bits of the
    spans' hashes are used: with few of them only more spans' bytes are compared.
    """
    made = ["clean_text", "n_lines", "n_removed_lines"]
    docs = docs.drop(*made)
    folder = shared.work_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    many = texts.mapInArrow(_emit(False, window_words, bits), SPAN).groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    many = shared.written(many, folder, "many")
    bodies = texts.mapInArrow(_emit(True, window_words, bits), SPAN + ", body string").join(F.broadcast(many) if shared.is_small(many) else many, ["h1", "h2"], "left_semi")
    bodies = shared.written(bodies, folder, "bodies")
    total = bodies.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "at")).alias("first")
    groups = bodies.groupBy("h1", "h2").agg(F.count("*").alias("n"), first, (F.min("body") == F.max("body")).alias("equal")).where("n > 1")
    groups = shared.written(groups, folder, "groups")
    gone = _repeats(bodies.drop("body"), groups.where("equal").drop("equal"), ["h1", "h2"], total)
    if groups.where("not equal").limit(1).count():  # different bytes with one hash: compared as they are
        unlike = bodies.join(groups.where("not equal").select("h1", "h2"), ["h1", "h2"], "left_semi")
        own = unlike.groupBy("h1", "h2", "body").agg(F.count("*").alias("n"), first).where("n > 1")
        gone = gone.unionByName(_repeats(unlike, own, ["h1", "h2", "body"], total))
    gone = gone.distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "lines")).alias("gone"))  # within one document
    gone = shared.written(gone, folder, "gone").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("gone").alias("_gone"))
    places = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0]
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_t"))
    df = df.join(F.broadcast(gone) if places <= shared.BROADCAST_ROWS else gone, same, "left")
    cut = F.pandas_udf(_cut, "struct<clean_text: string, n_lines: long, n_removed_lines: long>")
    df = df.select("row", cut(F.col("row.text").cast("string"), F.col("_gone")).alias("cut"))
    return df.select("row.*", *(F.col(f"cut.{c}").alias(c) for c in made))
