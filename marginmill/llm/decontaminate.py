"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

The test items are taken in blocks of a fixed number, so that what is broadcast has a bound; each
block is run against all documents. A first pass counts the items' seeds over all documents, a second
finds the rarest of them in each whole text and aligns item and stretch word by word. The score is
the alignment's share of the item's own score (1.0: an exact copy).

A seed is a pair of words at most n - 1 words apart (n >= 3), in the item and in the text. No
alignment that reaches the threshold t is missed. Let an item have L words and an alignment m matches
and penalties P: 2m - P >= 2tL. Two matches in a row cost at least n - 1 unless both their words lie
within n, in item and text, so of the m - 1 links at least m - 1 - P / (n - 1) >= tL - 1 are seeds;
each starts at another word of the item and of the text, and all lie within m + P <= (3 - 2t)L words
of the text. So the links of the item's tL - 2 most frequent starts can be left unsearched, however
often the item leaked, and a stretch with fewer than tL - 1 starts needs no alignment.

The bound needs tL > 1. Shorter items, and those under least_words words, are found where all their
words stand together in the text: fewer words that agree tell nothing of a copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text

#: Test items of a block, and words of its items together (one longer item is a block of its own).
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 22
RESULT = "doc_id long, item_id long, score double, matched_words long, first_word long, last_word long"


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman with linear gaps: (score, matched words, first and last word of the part).

    Row by row, in memory of a few rows: each cell carries where its best alignment starts and how many
    words match, so nothing is traced back. Ties go to a pair of words, then to a gap in the part.
    """
    n = len(part)
    j = np.arange(n + 1)
    score, start, matched = np.zeros(n + 1, np.int64), j.copy(), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, -1)
    for word in item:
        same = part == word
        pair, up = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP
        by_pair = pair >= up
        row, first, hits = np.zeros(n + 1, np.int64), j.copy(), np.zeros(n + 1, np.int64)
        row[1:] = np.where(by_pair, pair, up)
        first[1:] = np.where(by_pair, start[:-1], start[1:])
        hits[1:] = np.where(by_pair, matched[:-1] + same, matched[1:])
        empty = row <= 0
        row[empty], first[empty], hits[empty] = 0, j[empty], 0
        # gaps along the part: each cell comes from the last one before it that gives the most
        level = row - GAP * j
        most = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == most, j, 0))
        score, start, matched = most + GAP * j, first[source], hits[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(matched[at]), int(start[at]), at - 1)
    return best


def pairs(h: np.ndarray, wo: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each word and the one 1 to n - 1 words on in its row; 0 where the row ends before."""
    out = np.zeros((n - 1, len(h)), text.U)
    end, first = np.repeat(wo[1:], np.diff(wo)), text.mix(h, 1)
    for d in range(1, min(n, len(h))):
        with np.errstate(over="ignore"):
            key = text.mix(first[:-d] + h[d:], 2)
        out[d - 1, :-d] = np.where(np.arange(d, len(h)) < end[:-d], key, text.U(0))
    return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = text.mix(h[: max(len(h) - n + 1, 0)], n)
    for d in range(1, n):
        with np.errstate(over="ignore"):
            out = text.mix(out + h[d : len(h) - n + 1 + d], d)
    return out


def _blocks(rows: Iterator, items: int, words: int) -> Iterator[list]:
    block, size = [], 0
    for row in rows:
        n = len((row[1] or "").split())
        if block and (len(block) >= items or size + n > words):
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block


class _Items:
    """Word hashes and seeds of one block of test items."""

    def __init__(self, rows, n: int, least: int, threshold: float):
        self.n, self.ids, self.words, self.pairs = n, [], [], []
        self.short: dict[int, dict[int, list]] = {}  # by number of words and hash of all of them: items
        of, start, gram = [], [], []
        for item_id, body in rows:
            if item_id is None or not body:
                continue
            raw = np.frombuffer(body.encode(), np.uint8)
            h, _, wo = text.words(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            if len(h) < least or threshold * len(h) <= 1:
                self.short.setdefault(len(h), {}).setdefault(int(_runs(h, len(h))[0]), []).append(item_id)
                continue
            p = pairs(h, wo, n)
            d, at = np.nonzero(p)
            of.append(np.full(len(at), len(self.ids)))
            start.append(at)
            gram.append(p[d, at])
            self.ids.append(item_id)
            self.words.append(h)
            self.pairs.append(np.unique(gram[-1]))
        self.of, self.at, self.gram = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((of, np.int64), (start, np.int64), (gram, text.U)))
        size = np.array([len(x) for x in self.words], np.int64)
        self.links = np.maximum(np.ceil(threshold * size - 1 - 1e-9), 1).astype(np.int64)
        self.span = np.floor((3 - 2 * threshold) * size + 1e-9).astype(np.int64)
        self._index()

    def _index(self):
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.of, self.at = self.gram[order], self.of[order], self.at[order]
        self.keys, self.start = np.unique(self.gram, return_index=True)
        self.start = np.append(self.start, len(self.gram))
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.keys >> text.U(64 - FILTER_BITS)).astype(np.int64)] = True

    def keep_rare(self, counts: np.ndarray):
        """Of each item all but its ``links - 1`` most frequent starts stay: every alignment has one of them."""
        size = np.array([len(x) for x in self.words])
        first = np.cumsum(size) - size
        cost = np.bincount(first[self.of] + self.at, counts[np.searchsorted(self.keys, self.gram)], size.sum())
        item = np.repeat(np.arange(len(size)), size)
        last = np.arange(len(item)) == (first + size - 1)[item]  # begins no pair
        order = np.lexsort((cost, last, item))
        rank = np.empty(len(item), np.int64)
        rank[order] = np.arange(len(item)) - first[item[order]]
        stay = (rank < (size - self.links)[item])[first[self.of] + self.at]
        self.gram, self.of, self.at = self.gram[stay], self.of[stay], self.at[stay]
        self._index()

    def find_short(self, h: np.ndarray, wo: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, first word, words) of the first place in each row where a short item stands whole."""
        for n, known in self.short.items():
            runs = _runs(h, n)
            keys = np.array(list(known), text.U)
            at = np.flatnonzero(np.isin(runs, keys))
            row = np.searchsorted(wo, at, "right") - 1
            inside = at + n <= wo[row + 1]
            seen = set()
            for r, x in zip(row[inside].tolist(), at[inside].tolist(), strict=True):
                for item_id in known[int(runs[x])]:
                    if (r, item_id) not in seen:
                        seen.add((r, item_id))
                        yield r, item_id, x - int(wo[r]), n

    def holds(self, i: int, s: np.ndarray) -> np.ndarray:
        """Which of s are pairs of item i, rare or not."""
        own = self.pairs[i]
        return own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in s that hold a key, and the keys' numbers."""
        at = np.flatnonzero(self.bits[(s >> text.U(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, s[at]), len(self.keys) - 1)
        ok = self.keys[k] == s[at]
        return at[ok], k[ok]


def _count(shared_items):
    def run(batches):
        items = shared_items.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for _, raw, off in text.chunks(batch.column(0)):
                h, _, wo = text.words(raw, off)
                for s in pairs(h, wo, items.n):
                    total += np.bincount(items.find(s)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["key", "n"])

    return run


def _search(shared_items, threshold: float):
    def run(batches):
        items = shared_items.value
        for batch in batches:
            ids, out = batch.column(0), []
            for lo, raw, off in text.chunks(batch.column(1)):
                h, _, wo = text.words(raw, off)
                out += [(ids[lo + r].as_py(), item, 1.0, n, x, x + n - 1) for r, item, x, n in items.find_short(h, wo)]
                near = pairs(h, wo, items.n)
                at, key = (np.concatenate(x) for x in zip(*map(items.find, near), strict=True))
                if not len(at):
                    continue
                reps = items.start[key + 1] - items.start[key]
                item = items.of[np.repeat(items.start[key] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
                at = np.repeat(at, reps)
                row = np.searchsorted(wo, at, "right") - 1
                order = np.lexsort((at, item, row))
                row, item, at = row[order], item[order], at[order]
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > items.span[item[1:]])]))
                best: dict[tuple[int, int], tuple] = {}
                for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    r, i = int(row[a]), int(item[a])
                    words, span, links = items.words[i], int(items.span[i]), int(items.links[i])
                    first, last = max(int(wo[r]), int(at[a]) - span), min(int(wo[r + 1]), int(at[b - 1]) + span)
                    starts = first + np.flatnonzero(items.holds(i, near[:, first:last]).any(0))
                    fits = np.flatnonzero(starts[links - 1 :] - starts[: max(len(starts) - links + 1, 0)] < span)
                    if not len(fits):
                        continue
                    first, last = max(first, int(starts[fits[0]]) - span), min(last, int(starts[fits[-1] + links - 1]) + span)
                    for x in range(first, last, 64 * len(words)):  # many copies in a row
                        points, matched, p, q = align(words, h[x : min(last, x + 64 * len(words) + span)])
                        score = points / (MATCH * len(words))
                        if score >= threshold and score > best.get((r, i), (0,))[0]:
                            best[r, i] = (score, matched, x - int(wo[r]) + p, x - int(wo[r]) + q)
                out += [(ids[lo + r].as_py(), items.ids[i], *v) for (r, i), v in best.items()]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.45, least_words: int = 5, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Pairs (doc_id, item_id) whose best alignment scores threshold or more, with its words in the text.

    docs needs ``doc_id`` and ``text``, benchmark ``item_id`` and ``text``; further columns are
    ignored. Null and empty texts match nothing, and items without an id are not searched for. Items
    of fewer than least_words words, or of up to 1 / threshold, count as found where they stand whole.
    Repeated rows of docs give a result each, repeated items one. Of alignments with the same score
    the first counts. Very long texts are searched in blocks, very long items aligned in memory of a
    few rows. Empty tables give no rows.
    """
    if n < 3:
        raise ValueError("n must be 3 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text").toLocalIterator()
    found = []
    for block in _blocks(rows, block_items, block_words):
        items = _Items(block, n, least_words, threshold)
        if not items.ids and not items.short:
            continue
        held = spark.sparkContext.broadcast(items)  # bounded by block_items and block_words
        if items.ids:
            counts = np.zeros(len(items.keys), np.int64)
            seen = docs.select("text").mapInArrow(_count(held), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            seen = seen.toArrow()  # at most the seeds of one block
            counts[seen["key"].to_numpy()] = seen["n"].to_numpy()
            items.keep_rare(counts)
            held = spark.sparkContext.broadcast(items)
        found.append(docs.mapInArrow(_search(held, threshold), RESULT))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no copy of a test item; a row without doc_id can't be named and stays."""
    folder = shared.work_folder(docs.sparkSession)
    gone = shared.written(contaminated(docs, benchmark, **how).select("doc_id").distinct(), folder, "contaminated")
    few = gone.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
