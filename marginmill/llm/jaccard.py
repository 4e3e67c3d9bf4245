"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Shingles are ordered by a frequency sketch over all texts (rare first, ties by hash). Two sets with
similarity t share a shingle among the first ``n - ceil(t n) + 1`` of each, so only these prefix
shingles are shuffled, once, and sorted by size of set: the length filter is a cut of the sorted list into runs, within
which each set has a neighbour of a size that can link, and runs of one set are dropped. Pairs that
survive the length, positional and suffix filters (parities of bins of the whole sets, and for large
sets the numbers in bins) are verified once on their whole sets: each set is
sent to where the pair's busier set is.

Components need fewer pairs than all links. Of the sets of a run the few with the least hashes
are pivots (so the shingles of one group of near copies have the same ones), and first every set is
verified against its pivots. Sets that are then in the same component need no further
pair; every other pair that shares a prefix shingle is verified in a second round. So a group of
thousands of near copies costs pairs in proportion to its size, and no link that could change a
component is left untested. ``links`` skips the shortcut and lists every link between different sets.

A shingle that many unconnected sets share is paired block by block: its sets are dealt by bands of
size, of which only neighbours can link, and by salts, so that no task compares all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text

COUNTERS = 1 << 19  # of the frequency sketch; fixed, whatever the corpus size
PIECE = 1 << 14
PIVOTS = 8  # sets per shingle that all others of the shingle are first verified against
HOT_TOKEN = 500  # sets of a run from which it is paired block by block; pairs of a set from which they are dealt out
RUN = 100_000  # sets of a run of which the pivots are drawn; a longer run has those of its first part
SEEN = 200_000  # sets that a task remembers so as to emit the prefix of copies once
WORDS = 8  # of 64 bits, for the suffix filter
PARITY = [f"p{i}" for i in range(WORDS)]
#: From so many shingles a set also has the numbers of its shingles in so many bins: parities of random sets differ in half of the bits only.
LARGE, BINS = 1000, 512


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingle hashes, as two signed longs."""
    with np.errstate(over="ignore"):
        one = text.mix(np.array([text.mix(s, 7).sum() + text.U(len(s))], text.U), 8)
        two = text.mix(np.array([np.bitwise_xor.reduce(text.mix(s, 9))], text.U), 10)
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    for lo, raw, off in text.chunks(col):
        h, _, wo = text.words(raw, off)
        s, so = text.shingles(h, wo, k)
        for i in range(len(off) - 1):
            yield lo + i, np.unique(s[so[i] : so[i + 1]])


SET_SCHEMA = "doc_id long, s1 long, s2 long, n int, " + "".join(f"{p} long, " for p in PARITY) + "bins binary, piece int, counts binary"


def _scan(k: int):
    """One row per document, and at the end of a task the pieces of its frequency sketch."""
    names = [x.split()[0] for x in SET_SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in SET_SCHEMA.split(", ")]
    schema = pa.schema(zip(names, kinds, strict=True))

    def record(**cols):
        size = len(next(iter(cols.values())))
        return pa.record_batch([cols[c] if c in cols else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], schema=schema)

    def run(batches):
        total, wait, waiting = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            s1, s2, n, bins, parity = [], [], [], [], np.zeros((batch.num_rows, 64 * WORDS), np.uint8)
            for i, s in _sets(batch.column(1), k):
                one, two = _signature(s) if len(s) else (None, None)
                s1.append(one)
                s2.append(two)
                n.append(len(s))
                parity[i] = np.bincount((s & text.U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
                bins.append(np.minimum(np.bincount((s >> text.U(16) & text.U(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() if len(s) >= LARGE else None)
                wait.append((s >> text.U(64 - 19)).astype(np.int64))
                waiting += len(s)
                if waiting > 1 << 18:
                    total += np.bincount(np.concatenate(wait), minlength=COUNTERS)
                    wait, waiting = [], 0
            bits = np.packbits(parity, axis=1).view(np.int64).T
            yield record(doc_id=batch.column(0).cast(pa.int64()), s1=pa.array(s1, pa.int64()), s2=pa.array(s2, pa.int64()), n=pa.array(n, pa.int32()), bins=pa.array(bins, pa.binary()), **{p: pa.array(x) for p, x in zip(PARITY, bits, strict=True)})
        if wait:
            total += np.bincount(np.concatenate(wait), minlength=COUNTERS)
        if total.any():
            pieces = range(COUNTERS // PIECE)
            yield record(piece=pa.array(pieces, pa.int32()), counts=pa.array([zlib.compress(total[i * PIECE : (i + 1) * PIECE].tobytes(), 1) for i in pieces], pa.binary()))

    return run


def _add_pieces(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.int64)
            sums[piece] = sums[piece] + x if piece in sums else x
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["piece", "counts"])


def _ceil(a, num: int, den: int):
    return -(-a * num // den)


def _prefixes(k: int, num: int, den: int, sketch):
    """The rarest shingles of each set: (token, s1, n, pos)."""

    def run(batches):
        counts, seen = sketch.value, set()
        for batch in batches:
            out = []
            for _, s in _sets(batch.column(0), k):
                if not len(s):
                    continue
                s1 = _signature(s)[0]
                if s1 in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(s1)
                n = len(s)
                first = n - _ceil(n, num, den) + 1
                order = np.lexsort((s, counts[(s >> text.U(64 - 19)).astype(np.int64)]))[:first]
                out.append((s[order].view(np.int64), s1, n))
            if out:
                lens = np.array([len(x) for x, _, _ in out])
                yield pa.record_batch(
                    [
                        np.concatenate([x for x, _, _ in out]),
                        np.repeat(np.array([x for _, x, _ in out], np.int64), lens),
                        np.repeat(np.array([x for _, _, x in out], np.int32), lens),
                        np.concatenate([np.arange(x, dtype=np.int32) for x in lens]),
                    ],
                    names=["token", "s1", "n", "pos"],
                )

    return run


def _runs(num: int, den: int):
    """Of postings sorted by token, size and set: those of runs of two different sets or more, ranked by hash from 0.

    A run ends where the next size can't link with the last one; its number is its first size.
    """

    def finish(cols, start: int):
        """Runs of whole cols; start: sets of the first run that have been given out before."""
        token, s1, n = cols[:3]
        again = np.concatenate([[False], (token[1:] == token[:-1]) & (s1[1:] == s1[:-1])])  # the same set comes from several tasks
        token, s1, n, pos = (x[~again] for x in cols)
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (num * n[1:].astype(np.int64) > den * n[:-1].astype(np.int64))])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(token)))
        of = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((s1, of))
        rank = np.empty(len(token), np.int64)
        rank[order] = np.arange(len(token)) - np.repeat(first, size)
        keep = np.repeat(size, size) > 1
        if start:
            keep[: size[0]], rank[: size[0]] = True, rank[: size[0]] + start
        kinds = (np.int64, np.int32, np.int64, np.int32, np.int32, np.int64)
        out = (token, np.repeat(n[first], size), s1, n, pos, rank)
        return pa.record_batch([pa.array(x[keep].astype(t)) for x, t in zip(out, kinds, strict=True)], names=["token", "run", "s1", "n", "pos", "r"])

    def run(batches):
        wait, start, number = None, 0, None  # postings of the last run; what of it is out, and its first size
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(cols[0]):
                continue
            cols = cols if wait is None else [np.concatenate(x) for x in zip(wait, cols, strict=True)]
            token, n = cols[0], cols[2].astype(np.int64)
            breaks = np.flatnonzero((token[1:] != token[:-1]) | (num * n[1:] > den * n[:-1])) + 1
            cut = int(breaks[-1]) if len(breaks) else 0
            if cut:
                yield numbered(finish([x[:cut] for x in cols], start), number, start)
                start, number = 0, None
            wait = [x[cut:] for x in cols]
            if len(wait[0]) >= RUN:
                number = int(wait[2][0]) if number is None else number
                out = finish(wait, start or 0) if start else whole(wait)
                yield numbered(out, number, 1)
                start, wait = start + out.num_rows, [x[-1:] for x in wait]
        if wait is not None:
            yield numbered(finish(wait, start), number, start)

    def whole(cols):
        out = finish(cols, 1)
        return out.set_column(5, "r", pa.array(out.column(5).to_numpy() - 1))

    def numbered(out, number, start):
        """The first run of out has gone on from before: it keeps its number."""
        if number is None or not start or not out.num_rows:
            return out
        run_ = out.column(1).to_numpy().copy()
        run_[(out.column(0).to_numpy() == out.column(0)[0].as_py()) & (run_ == run_[0])] = number
        return out.set_column(1, "run", pa.array(run_))

    return run


def _bound(na: str, ia: str, nb: str, ib: str, num: int, den: int) -> str:
    """SQL: the sizes fit, and so do the positions of the first common shingle (linked sets pass at theirs)."""
    return (
        f"{num} * greatest({na}, {nb}) <= {den} * least({na}, {nb}) AND "
        f"least({na} - {ia}, {nb} - {ib}) * {num + den}L >= {num}L * ({na} + {nb})"
    )


def _suffix(x: str, y: str, num: int, den: int) -> str:
    """SQL: the sets differ in at least as many shingles as the parities of their hash bins; do so many fit?"""
    differ = " + ".join(f"bit_count({p}_{x} ^ {p}_{y})" for p in PARITY)
    return f"(n_{x} + n_{y} - ({differ})) * {num + den}L >= {2 * num}L * (n_{x} + n_{y})"


SENT = "hub long, salt int, role int, s1 long, grams binary"


def _send(k: int):
    """Of rows (text, wants) the set of the text to every place that wants it."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i, s in _sets(batch.column(0), k):
                if not len(s):
                    continue
                s1, grams = _signature(s)[0], None
                for w in batch.column(1)[i].as_py():
                    if w["s1"] == s1:  # rows that repeat a doc_id may hold another text
                        grams = grams or s.tobytes()
                        out.append((w["hub"], w["salt"], w["role"], s1, grams))
                        size += len(grams)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])

    return run


def _bins_fit(num: int, den: int):
    """Of pairs (a, b, sizes, bins): those whose bins don't differ by more shingles than linked sets may."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for i in (4, 5))
            ok = (na + nb - np.abs(x - y).sum(1)) * (num + den) >= 2 * num * (na + nb)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _verify(num: int, den: int):
    """Of sets sorted by hub, the hub's own first: the links (a, b) of the hub with the others."""

    def run(batches):
        hub, own = None, None
        for batch in batches:
            out = []
            for h, role, s1, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                x = np.frombuffer(grams.as_buffer(), text.U)
                if role == 0:
                    hub, own = h, x.copy()
                elif h == hub:
                    small, large = (x, own) if len(x) <= len(own) else (own, x)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if den * both >= num * (len(x) + len(own) - both):
                        out.append((min(h, s1), max(h, s1)))
                else:
                    raise ValueError("a set without the hub it was sent to")
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


class JaccardJoin:
    """Links between documents whose sets of k-word shingles have a Jaccard similarity of num/den or more.

    docs needs ``doc_id`` (whole numbers) and ``text``; further columns are ignored. Null or empty
    texts have an empty set and no links. Equal sets are one class. Rows that repeat a doc_id are
    one node. A document without doc_id takes part, but is never a component's id. An empty table
    gives empty results. Very long texts are hashed in blocks. Ties in the order of shingles go by
    their hashes. Sets are told apart by 128-bit signatures; shingles, and the classes in pairs, by
    64-bit hashes. After ``components`` the postings are gone: call ``links`` on an object of its own.
    """

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100):
        self.k, self.num, self.den = k, num, den
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark = docs.sparkSession
        self.folder = shared.work_folder(self.spark)
        scan = shared.written(self.docs.mapInArrow(_scan(k), SET_SCHEMA), self.folder, "sets")
        self.rows = scan.where("n is not null").select("doc_id", "s1", "s2", "n", *PARITY)
        self.bins = scan.where("bins is not null").select("s1", "bins")
        classes = self.rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.count("*").alias("copies"), *(F.min(p).alias(p) for p in PARITY))
        self.n_rows = self.rows.count()
        self.classes = shared.written(classes, self.folder, "classes", self.n_rows)
        pieces = scan.where("piece is not null").select("piece", "counts")
        sums = pieces.repartition(COUNTERS // PIECE, "piece").mapInArrow(_add_pieces, "piece int, counts binary")
        counts = np.zeros(COUNTERS, np.int64)
        for row in sums.collect():  # at most COUNTERS numbers, whatever the corpus size
            counts[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(row.counts), np.int64)
        sketch = self.spark.sparkContext.broadcast(counts)
        postings = self.docs.select("text").mapInArrow(_prefixes(k, num, den, sketch), "token long, s1 long, n int, pos int")
        sort = postings.repartition("token").sortWithinPartitions("token", "n", "s1")
        self.common = shared.written(sort.mapInArrow(_runs(num, den), "token long, run int, s1 long, n int, pos int, r long"), self.folder, "common")

    def _checked(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b) of sets those that link."""
        sets = self.classes.select("s1", "n", *PARITY)
        a, b = (sets.select(F.col("s1").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in sets.columns[1:])) for side in "ab")
        fit = pairs.join(a, "a").join(b, "b").where(_suffix("a", "b", self.num, self.den)).select("a", "b", "n_a", "n_b")
        fit = shared.written(fit, self.folder, f"{name}-sized")
        n = fit.count()
        large = f"n_a >= {LARGE} and n_b >= {LARGE}"
        bins = self.bins.dropDuplicates(["s1"])
        bins = [bins.select(F.col("s1").alias(side), F.col("bins").alias(f"bins_{side}")) for side in "ab"]
        near = fit.where(large).join(bins[0], "a").join(bins[1], "b").select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
        near = near.mapInArrow(_bins_fit(self.num, self.den), "a long, b long")
        fit = shared.written(fit.where(f"not ({large})").select("a", "b").unionByName(near), self.folder, f"{name}-fit", n)
        # the busier set of a pair is its hub; hubs with many pairs are at several places
        ends = fit.select(F.col("a").alias("v")).unionByName(fit.select(F.col("b").alias("v")))
        busy, total = ends.groupBy("v").agg(F.count("*").alias("m")), 2 * fit.count()
        edges = fit
        for side in "ab":
            edges = shared.join_counted(edges, busy.select(F.col("v").alias(side), F.col("m").alias(f"m_{side}")), [side], f"m_{side}", total)
        first = (F.col("m_a") > F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("a") < F.col("b")))
        edges = edges.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("mate"))
        edges = shared.written(edges, self.folder, f"{name}-edges", n)
        hubs = edges.groupBy("hub").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / HOT_TOKEN).cast("int"))
        salted = shared.join_counted(edges, hubs, ["hub"], "m", total)
        wants = salted.select(F.col("mate").alias("s1"), "hub", F.expr("cast(pmod(mate, salts) as int)").alias("salt"), F.lit(1).alias("role"))
        wants = wants.unionByName(hubs.select(F.col("hub").alias("s1"), "hub", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("role")))
        wants = wants.join(self.classes.select("s1", "least"), "s1")
        wants = wants.groupBy("s1", "least").agg(F.collect_list(F.struct("hub", "salt", "role", "s1")).alias("wants"))  # a set's own pairs
        wants = shared.written(wants, self.folder, f"{name}-wants", 2 * n)
        by_id = wants.where("least is not null").select(F.col("least").alias("doc_id"), "wants")
        by_id = by_id.groupBy("doc_id").agg(F.flatten(F.collect_list("wants")).alias("wants"))
        few = total <= shared.BROADCAST_ROWS  # every pair gives two wants
        sent = self.docs.join(F.broadcast(by_id) if few else by_id, "doc_id").select("text", "wants").mapInArrow(_send(self.k), SENT)
        # sets of which no document has an id
        unnamed = self.docs.where("doc_id is null").select("text").distinct().mapInArrow(_signatures(self.k), "text string, s1 long, s2 long")
        unnamed = unnamed.dropDuplicates(["s1"]).join(wants.where("least is null"), "s1").select("text", "wants")
        sent = sent.unionByName(unnamed.mapInArrow(_send(self.k), SENT))
        good = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInArrow(_verify(self.num, self.den), "a long, b long")
        good = shared.written(good.distinct(), self.folder, f"{name}-links", n)
        shared.drop(self.spark, *(f"{self.folder}/{name}-{x}" for x in ("sized", "fit", "edges", "wants")))
        return good

    def _pairs(self, some: DataFrame, others: DataFrame, which: str, blocks: str = "") -> DataFrame:
        """Distinct pairs of sets of the same run that the length, positional and (if they have it) suffix filters let pass.

        blocks, a name for a table: many of others may be of the same run.
        """
        key = ["token", "run"]
        x, y = (df.select(*key, *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in key)) for df, side in ((some, "x"), (others, "y")))
        ok = F.expr(f"{which} AND " + _bound("n_x", "pos_x", "n_y", "pos_y", self.num, self.den))
        if PARITY[0] in some.columns:
            ok = ok & F.expr(_suffix("x", "y", self.num, self.den))
        pair = (F.least("s1_x", "s1_y").alias("a"), F.greatest("s1_x", "s1_y").alias("b"))
        if not blocks:
            return x.join(y, key).where(ok).select(*pair).distinct()
        # sets that link lie in the same band of size or in neighbours; of a hot run one side goes to all three, salted by the other
        size = F.floor(F.log(F.col("n_y").cast("double")) / F.log(F.lit(self.den / self.num)))
        counts = y.groupBy(*key, size.alias("band")).agg(F.count("*").alias("m"))
        counts = shared.written(counts, self.folder, f"{blocks}-counts", self.common.count())
        hot = counts.groupBy(*key).agg(F.sum("m").alias("m")).where(F.col("m") > HOT_TOKEN).select(*key)
        hint = F.broadcast if shared.is_small(hot) else (lambda z: z)
        cold = x.join(hint(hot), key, "left_anti").join(y, key).where(ok).select(*pair)
        salts = counts.join(hint(hot), key).select(*key, "band", F.ceil(F.col("m") / HOT_TOKEN).cast("int").alias("salts"))
        band_x = F.floor(F.log(F.col("n_x").cast("double")) / F.log(F.lit(self.den / self.num)))
        to = F.explode(F.array(band_x - 1, band_x, band_x + 1)).alias("band")
        hot_x = x.join(hint(hot), key).select("*", to).join(hint(salts), [*key, "band"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
        hot_y = y.join(hint(hot), key).withColumn("band", size).join(hint(salts), [*key, "band"]).withColumn("salt", F.expr("cast(pmod(s1_y, salts) as int)")).drop("salts")
        return cold.unionByName(hot_x.join(hot_y, [*key, "band", "salt"]).where(ok).select(*pair)).distinct()

    def links(self) -> DataFrame:
        """All links (a, b) between different sets, as the least doc_ids of each (a < b)."""
        good = self._checked(self._pairs(self.common, self.common, "s1_x < s1_y", "all"), "all")
        ids = self.classes.select("s1", "least")
        good = good.join(ids.select(F.col("s1").alias("a"), F.col("least").alias("x")), "a").join(ids.select(F.col("s1").alias("b"), F.col("least").alias("y")), "b")
        return good.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def components(self) -> DataFrame:
        """Per document (doc_id, n_shingles, component_id): the least doc_id reachable by links."""
        pivots = self.common.where(F.col("r") < PIVOTS)
        star = shared.written(self._pairs(self.common, pivots, "r_x > r_y AND s1_x <> s1_y"), self.folder, "star")
        near = self._checked(star, "star")
        root = shared.written(shared.components(near, self.folder, "first", near.count()), self.folder, "first", self.n_rows)
        members = self.common.select("token", "run", "s1", "n", "pos").join(root.select(F.col("node").alias("s1"), "root"), "s1", "left")
        members = members.withColumn("root", F.coalesce("root", "s1"))
        open_ = members.groupBy("token", "run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "run")
        members = members.join(open_, ["token", "run"], "left_semi").join(self.classes.select("s1", *PARITY), "s1")
        members = shared.written(members, self.folder, "open", self.common.count())
        rest = self._pairs(members, members, "s1_x < s1_y AND root_x <> root_y", "open").join(star, ["a", "b"], "left_anti")
        # what is connected so far goes on as one edge a set
        near = root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        near = near.unionByName(self._checked(shared.written(rest, self.folder, "rest"), "rest"))
        shared.drop(self.spark, *(f"{self.folder}/{x}" for x in ("common", "star", "open", "open-counts", "rest")))
        # a doc_id that several rows have is one node: its classes belong together
        twice = self.rows.where("n > 0").groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("doc_id is not null and a <> b")
        same = self.rows.where("n > 0").select("doc_id", "s1").join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("s1").alias("b"))
        root = shared.written(shared.components(near.unionByName(same), self.folder, "last"), self.folder, "last", self.n_rows)
        known = self.classes.select("s1", "s2", "least", "copies").join(root.select(F.col("node").alias("s1"), "root"), "s1", "left")
        known = known.select("s1", "s2", "least", "copies", F.coalesce("root", "s1").alias("root"))
        total = self.classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        known = shared.join_counted(known, least, ["root"], "members", total).select("s1", "s2", "copies", "root", "component_id")
        self.known = known = shared.written(known, self.folder, "known", self.n_rows)
        full = shared.join_counted(self.rows.where("n > 0").select("doc_id", "s1", "s2", "n"), known.drop("root"), ["s1", "s2"], "copies", total)
        full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        none = self.rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return full.unionByName(none).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            found = {i: _signature(s) for i, s in _sets(batch.column(0), k) if len(s)}
            s1, s2 = ([found[i][j] if i in found else None for i in range(batch.num_rows)] for j in (0, 1))
            yield pa.record_batch([batch.column(0), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], names=["text", "s1", "s2"])

    return run


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near copies: of each component the least doc_id stays.

    Of rows without doc_id one stays if its component has no row with one (that of the least signature
    and text). Rows with the same doc_id are one document; documents without words all stay.
    """
    join = JaccardJoin(docs, k, num, den)
    found = shared.written(join.components().where("component_id <> doc_id").select("doc_id").distinct(), join.folder, "gone", join.n_rows)
    out = docs.where("doc_id is not null").join(F.broadcast(found) if shared.is_small(found) else found, "doc_id", "left_anti").select(docs.columns)
    unnamed = docs.where("doc_id is null")
    if unnamed.limit(1).count():
        bodies = unnamed.select(F.col("text").cast("string").alias("text")).distinct().mapInArrow(_signatures(k), "text string, s1 long, s2 long")
        known = bodies.where("s1 is not null").join(join.known, ["s1", "s2"]).where("component_id is null and root = s1")
        stays = known.groupBy("s1", "s2").agg(F.min("text").alias("_t")).select("_t")
        full = unnamed.join(stays, unnamed["text"].cast("string") == F.col("_t")).select(unnamed.columns)
        empty = unnamed.join(bodies.where("s1 is null").select(F.col("text").alias("_t")), unnamed["text"].cast("string").eqNullSafe(F.col("_t")), "left_semi")
        out = out.unionByName(full.dropDuplicates(["text"])).unionByName(empty)
    return out
