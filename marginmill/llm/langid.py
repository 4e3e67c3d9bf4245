"""Language ID by error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit, over hashed character
n-grams, scores a text; loss-weighted decoding picks the nearest codeword. Each bit's loss weighs as
much as the bit was right in calibration. A text whose best language isn't ``margin`` times as likely
as the second is ambiguous; the margin is lowered until few calibration texts that are decoded right
are.

Training sums up n-grams by language, then by bit; what comes to the driver is a vector a bit and a
few numbers a bit and task of the sample, and the languages with their numbers of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, text

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Bound of the training sample: about so many documents of a language, drawn by hash.
TRAIN_ROWS = 2_000
#: Documents of the sample in a task.
TASK_ROWS = 1_000
#: How much likelier the best language must be than the second, and the share of right decisions that it may flag.
MARGIN, MOST_FLAGGED, LEVELS = 10.0, 0.005, 64
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def grams(body: str | None, block: int = 1 << 20) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, block by block; None if it has no letter."""
    if not body:
        return None
    total, letters = np.zeros(BUCKETS), _letters()
    tail, carried = np.array([32], np.uint64), 0  # the characters before the block, and how many of them have been counted
    any_letter = False
    for at in range(0, len(body), block):
        part = body[at : at + block].lower().encode("utf-32-le", "surrogatepass")
        a = np.frombuffer(part, np.uint32)
        ok = letters[a]
        any_letter |= bool(ok.any())
        a = np.where(ok, a, 32)
        a = np.concatenate([tail, a.astype(np.uint64)] + ([np.array([32], np.uint64)] if at + block >= len(body) else []))
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        a = a[keep]
        for n in ORDERS:
            x = a[max(0, carried - n + 1) :]  # n-grams that lie in what was counted are done
            if len(x) < n:
                continue
            with np.errstate(over="ignore"):
                h = x[: len(x) - n + 1] * text.U(n)
                for j in range(1, n):
                    h = h * text.U(0x9E3779B97F4A7C15) + x[j : len(x) - n + 1 + j]
                h = (h * text.U(0xBF58476D1CE4E5B9)) >> text.U(64 - 13)
            total += np.bincount(h.astype(np.int64), minlength=BUCKETS)
        tail = a[-(max(ORDERS) - 1) :]
        carried = len(tail)
    return total if any_letter else None


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits for up to 7 languages, else random bits that lie far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1, *(1 if i >> j & 1 else -1 for j in range(n - 1))] for i in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7)
    if n > 1000:  # too many pairs to compare: random words of so many bits lie far apart all the same
        return np.where(rng.random((n, 2 * bits)) < 0.5, -1.0, 1.0)
    tries = [np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0) for _ in range(50)]
    return max(tries, key=lambda m: ((m @ m.T) - 2 * bits * np.eye(n)).max() * -1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits
    shift: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    #: A text is ambiguous if the best language's probability is not so many times the second's.
    margin: float = MARGIN

    def raw(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weight / max(counts.sum(), 1)

    def losses(self, raw: np.ndarray) -> np.ndarray:
        return (np.logaddexp(0, -self.code * ((raw - self.shift) * self.scale)) * self.trust).sum(1)

    def decode(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        if counts is None or not self.languages:
            return "und", 0.0, counts is not None
        loss = self.losses(self.raw(counts))
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        second = np.sort(p)[-2] if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] < self.margin * second)


def _sample(rows: DataFrame):
    """Per task: sums of the n-gram shares by language, of the training part of the sample."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (c := grams(body)) is not None:
                    sums[lang] = sums.get(lang, 0) + c / c.sum()
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "sums"])

    return rows.mapInArrow(run, "lang string, sums binary")


def _sums(batches) -> dict[str, np.ndarray]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer())
            sums[lang] = sums[lang] + x if lang in sums else x
    return sums


def _add(batches):
    """One row per key of the task: the sum of its rows."""
    sums = _sums(batches)
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "sums"])


def _by_bit(number: dict[str, int], code: np.ndarray):
    """Per bit the sums of the shares of the languages on either side, of the task's languages."""

    def run(batches):
        sides = np.zeros((code.shape[1], 2, BUCKETS))
        for lang, x in sorted(_sums(batches).items()):
            for b, side in enumerate(code[number[lang]]):
                sides[b, int(side < 0)] += x / max(x.sum(), 1e-9)
        if sides.any():
            yield pa.record_batch([pa.array(range(len(sides)), pa.int32()), pa.array([x.tobytes() for x in sides], pa.binary())], names=["bit", "sums"])

    return run


def _raw(model):
    def run(batches):
        m = model.value
        for batch in batches:
            got = [(lang, m.raw(c).tobytes()) for body, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := grams(body)) is not None]
            if got:
                yield pa.record_batch([pa.array([x for x, _ in got]), pa.array([x for _, x in got], pa.binary())], names=["lang", "z"])

    return run


def _summed(raw: DataFrame, number: dict[str, int], measure) -> np.ndarray | None:
    """Sum of measure(language's number, raw scores) over the calibration rows: a vector a task comes to the driver."""

    def run(batches):
        total = None
        for batch in batches:
            for lang, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = measure(number[lang], np.frombuffer(z.as_buffer()))
                total = x if total is None else total + x
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = raw.mapInArrow(run, "sums binary").collect()
    return sum(np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: bytes(r.sums))) if rows else None


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows (doc_id, text, lang); rows without lang or text are left out.

    Each language's sample has about train_rows documents, drawn by a hash of doc_id; a quarter of
    the sample calibrates. All languages that have a row are learned. Repeated rows are drawn alike.
    """
    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null")
    sizes = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])  # a row a language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1), np.ones(1))
    code, number = codewords(len(languages)), {x: i for i, x in enumerate(languages)}
    rates = spark.createDataFrame([(r["lang"], min(1.0, train_rows / r["count"])) for r in sizes], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    # written once: the corpus is read for it one time, and all passes over it are small jobs
    tasks = max(1, -(-sum(min(train_rows, r["count"]) for r in sizes) // TASK_ROWS))
    calibrates = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)) == 0
    drawn = rows.join(F.broadcast(rates) if len(sizes) <= shared.BROADCAST_ROWS else rates, "lang").where(draw < F.col("rate"))
    sample = drawn.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "text").select("text", "lang", calibrates.alias("calibrates"))
    folder = shared.work_folder(spark)
    sample = shared.written(sample, folder, "sample")
    sums = _sample(sample.where("not calibrates").select("text", "lang"))
    sums = sums.repartition("lang").sortWithinPartitions("lang", F.xxhash64("sums"))  # added up in the same order in every run
    sides = sums.mapInArrow(_by_bit(number, code), "bit int, sums binary")
    total = np.zeros((code.shape[1], 2, BUCKETS))
    sides = sides.withColumn("lang", F.col("bit").cast("string")).select("lang", "sums").repartition("lang").sortWithinPartitions("lang", F.xxhash64("sums")).mapInArrow(_add, "lang string, sums binary")
    for row in sides.collect():  # a row a bit
        total[int(row["lang"])] = np.frombuffer(row["sums"]).reshape(2, BUCKETS)
    n_sides = np.stack([(code > 0).sum(0), (code < 0).sum(0)], 1)
    weight = np.zeros((BUCKETS, code.shape[1]))
    smooth = 1e-6
    for b, (one, two) in enumerate(n_sides):
        if one and two:
            weight[:, b] = np.log(total[b, 0] / one + smooth) - np.log(total[b, 1] / two + smooth)
    bits = code.shape[1]
    model = Model(languages, code, weight, np.zeros(bits), np.full(bits, 4.0), np.ones(bits))
    raw = shared.written(sample.where("calibrates").select("text", "lang").mapInArrow(_raw(spark.sparkContext.broadcast(model)), "lang string, z binary"), folder, "raw")
    up = code > 0
    got = _summed(raw, number, lambda i, z: np.concatenate([z * up[i], up[i] * 1.0, z * ~up[i], ~up[i] * 1.0]))
    if got is None:
        return model
    one, n_one, two, n_two = got.reshape(4, bits)
    both = (n_one > 0) & (n_two > 0)
    one, two = one / np.maximum(n_one, 1), two / np.maximum(n_two, 1)
    shift = np.where(both, (one + two) / 2, 0.0)
    scale = np.where(both, 6 / np.maximum(one - two, 1e-6), 4.0)
    right = _summed(raw, number, lambda i, z: ((z > shift) == up[i]) * 1.0) / np.maximum(n_one + n_two, 1)
    model = Model(languages, code, weight, shift, scale, np.where(both, np.maximum(0.05, 2 * (right - 0.5)), 1.0))
    if len(languages) > 1:
        levels = np.linspace(0, np.log(MARGIN), LEVELS)
        odds = lambda loss: float(np.diff(np.sort(loss)[:2])[0])
        below = _summed(raw, number, lambda i, z: np.append(levels > odds(model.losses(z)), 1.0) * (model.losses(z).argmin() == i))
        fits = levels[below[:-1] <= MOST_FLAGGED * below[-1]]
        model.margin = min(MARGIN, float(np.exp(fits[-1] if len(fits) else 0.0)))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; only the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0. Very long texts are counted in
    blocks. Of languages that are equally near the first by name is taken, and the text is ambiguous.
    Repeated rows get the same result. Columns of docs that have these names are replaced. Empty
    tables give no rows.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared_model.value
        for batch in batches:
            found = [m.decode(grams(x.as_py())) for x in batch.column(1)]
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["row", *names])

    names = ("lang_pred", "score", "ambiguous")
    docs = docs.drop(*names)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields]))
    return out.select("row.*", *names)


def held_out():
    """Documents that are never learned from: crc32 of the doc_id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
