"""ROUGE and BLEU over word lists, and near-duplicate removal against a bounded reference set."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stemmer

#: Reference texts that a pass compares with, at most; choose them with curate.reference_tail.
REFERENCES = 500


def tokens(body: str, stem: bool = True) -> list[str]:
    """Lower-case runs of letters and digits, those of four characters or more without their endings."""
    out = re.sub(r"[^a-z0-9]+", " ", (body or "").lower()).split()
    return [stemmer.stem(w) if len(w) > 3 else w for w in out] if stem else out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over b."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | masks.get(w, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def rouge_l(a: list[str], b: list[str]) -> float:
    both = lcs(a, b) if a and b else 0
    return 2 * both / (len(a) + len(b)) if both else 0.0


def rouge_n(a: list[str], b: list[str], n: int) -> float:
    x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (a, b))
    both, total = sum((x & y).values()), sum(x.values()) + sum(y.values())
    return 2 * both / total if total else 0.0


def bleu4(reference: list[str], guess: list[str]) -> float:
    """Sentence BLEU-4; a precision without a hit counts 0.1 hits."""
    if not guess:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (guess, reference))
        hits, total = sum((x & y).values()), max(1, sum(x.values()))
        if n == 1 and not hits:
            return 0.0
        logs += log((hits or 0.1) / total) / 4
    return exp(min(0.0, 1 - len(reference) / len(guess)) + logs)


#: Pairs are scored together up to so many characters, a longer one alone.
SLICE = 1 << 19
_LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_SPACES = bytes(32 if 28 <= c < 32 else c for c in range(256))  # white space to Python and not to Arrow


def _plain(body: str | None) -> bytes:
    """The words of tokens without stems, between spaces."""
    return (body or "").lower().encode().translate(_LETTERS)


def _spaced(body: str | None) -> bytes:
    """The words of split, between white space of ASCII."""
    body = body or ""
    return body.encode().translate(_SPACES) if body.isascii() else " ".join(body.split()).encode()


class _Stems(dict):
    """The number of each word's stem; each word is stemmed once."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)

    def __missing__(self, word: str) -> int:
        self[word] = out = self.ids[stemmer.stem(word) if len(word) > 3 else word]
        return out


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words, how many each text has, and the words."""
    trimmed = pc.ascii_trim_whitespace(pa.array(texts, pa.large_string()))
    split = pc.ascii_split_whitespace(trimmed)
    found = split.flatten().dictionary_encode()
    sizes, full = split.value_lengths().to_numpy(), pc.binary_length(trimmed).to_numpy() > 0  # an empty text has one empty word
    return found.indices.to_numpy().astype(np.int64)[np.repeat(full, sizes)], np.where(full, sizes, 0), found.dictionary


def _common(words: np.ndarray, sizes: np.ndarray, orders: int) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray]]:
    """For n from 1 on: common n-grams of each pair, those of its two texts, all with repeats, and where the common ones begin. sizes: words of all first texts, then of all second ones."""
    n, ends = len(sizes) // 2, np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    row, left = text % max(n, 1), ends[text] - np.arange(len(words))
    split, width = int(sizes[:n].sum()), int(words.max(initial=0)) + 1
    at, kind = np.arange(len(words)), row
    for k in range(1, orders + 1):
        whole = left[at] >= k
        at, kind = at[whole], kind[whole]
        kind = pd.factorize(kind * width + words[at + k - 1])[0]
        kinds, first = int(kind.max(initial=-1)) + 1, at < split
        both = np.minimum(np.bincount(kind[first], minlength=kinds), np.bincount(kind[~first], minlength=kinds))
        of = np.zeros(kinds, np.int64)
        of[kind] = row[at]
        shared = both[kind] > 0  # a longer n-gram of both texts begins with one of both
        at, kind = at[shared], kind[shared]
        total = np.maximum(sizes - (k - 1), 0).tolist()
        yield np.bincount(of, weights=both, minlength=n).astype(np.int64).tolist(), total[:n], total[n:], at


def _bleu4(counts: list[tuple[int, int]], reference: int, guess: int) -> float:
    """bleu4 of hits and n-grams of the guess for each n, and of the words of both texts."""
    if not guess or not counts[0][0]:
        return 0.0
    logs = 0.0
    for hits, total in counts:
        logs += log((hits or 0.1) / max(1, total)) / 4
    return exp(min(0.0, 1 - reference / guess) + logs)


def _slice_scores(guess: list, reference: list, stem_of: _Stems) -> list[tuple[float, float, float, float]]:
    n = len(guess)
    words, sizes, _ = _numbered([_spaced(x) for x in guess + reference])
    fours = [list(zip(hits, total, strict=True)) for hits, total, _, _ in _common(words, sizes, 4)]
    lengths = sizes.tolist()
    bleu = [_bleu4([x[i] for x in fours], lengths[n + i], lengths[i]) for i in range(n)]
    words, sizes, kinds = _numbered([_plain(x) for x in guess + reference])
    stems = np.fromiter(map(stem_of.__getitem__, kinds.to_numpy(zero_copy_only=False)), np.int64, len(kinds))[words]
    ones, twos = _common(stems, sizes, 2)
    one, two = ([2 * h / (p + q) if p + q else 0.0 for h, p, q in zip(*x[:3], strict=True)] for x in (ones, twos))
    # only words of both can be in the common subsequence, and its rows are those of the shorter text
    at = np.searchsorted(ones[3], np.concatenate([[0], np.cumsum(sizes)])).tolist()
    shared, lengths = stems[ones[3]].tolist(), sizes.tolist()
    out = []
    for i in range(n):
        x, y = shared[at[i] : at[i + 1]], shared[at[n + i] : at[n + i + 1]]
        both = lcs(*sorted((x, y), key=len, reverse=True))
        out.append((bleu[i], one[i], two[i], 2 * both / (lengths[i] + lengths[n + i]) if both else 0.0))
    return out


def _scores(guess: pd.Series, reference: pd.Series) -> pd.DataFrame:
    stem_of = _Stems()
    ends = np.cumsum([len(g or "") + len(r or "") for g, r in zip(guess, reference, strict=True)])
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        out += _slice_scores(list(guess[at:to]), list(reference[at:to]), stem_of)
        at = to
    return pd.DataFrame(out, columns=["bleu4", "rouge1", "rouge2", "rougel"])


def text_scores(guess: Column, reference: Column) -> Column:
    return F.pandas_udf(_scores, "struct<bleu4: double, rouge1: double, rouge2: double, rougel: double>")(guess, reference)


def without_near(rows: DataFrame, body: str, references: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows whose ROUGE-L with each of the references (column text) is at most the threshold. More than REFERENCES are refused."""
    found = references.select("text").limit(REFERENCES + 1).collect()
    if len(found) > REFERENCES:
        raise ValueError(f"more than {REFERENCES} references: take their tail first")
    held = rows.sparkSession.sparkContext.broadcast([tokens(r.text) for r in found])

    @F.pandas_udf("boolean")
    def near(bodies: pd.Series) -> pd.Series:
        def one(body):
            t = tokens(body)
            c = Counter(t)
            for r in held.value:
                total = len(t) + len(r)
                # the common words bound the common subsequence
                if total and 2 * min(len(t), len(r)) > threshold * total and 2 * sum((c & Counter(r)).values()) > threshold * total and rouge_l(r, t) > threshold:
                    return True
            return False

        return bodies.map(one)

    flag: Column = near(F.col(body))
    return rows.withColumn("_near", flag).where(~F.col("_near")).drop("_near")
