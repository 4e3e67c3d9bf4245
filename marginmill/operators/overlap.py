"""Overlap of predicted locations with labelled ones within a row.

Sets of pairs are array expressions. Lenient matches and hits by label would compare all locations with all
labels in such ones, so they look labels up by path, line and word in Arrow batches, in proportion to the row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 5
#: An identifier that, where it stands as a word, is a whole run of these characters.
WORD = "[A-Za-z0-9_]+"


def _pairs(c: Column, file: str) -> Column:
    """Distinct pairs as strings, which are told apart by a hash and not by comparison with each other."""
    full = F.filter(c, lambda x: (F.coalesce(x[file], F.lit("")) != "") & (F.coalesce(x["line"], F.lit(0)) != 0))
    return F.array_distinct(F.transform(full, lambda x: F.concat_ws(":", x["line"].cast("int").cast("string"), x[file])))


def matches(loc: Column, label: Column, tolerance: int = TOLERANCE) -> Column:
    """Same file within the tolerance of lines, or the identifier as a word of the label's text."""
    near = (loc["file"] != "") & (loc["file"] == label["path"]) & (loc["line"] != 0) & (label["line"] != 0) & (F.abs(loc["line"] - label["line"]) <= tolerance)
    return F.coalesce(near, F.lit(False)) | _named(loc, label)


def _named(loc: Column, label: Column) -> Column:
    # the pattern is built only where the identifier stands in the text at all
    named = (loc["identifier"] != "") & F.contains(F.coalesce(label["text"], F.lit("")), loc["identifier"]) & F.regexp_like(F.coalesce(label["text"], F.lit("")), F.concat(F.lit(r"\b"), loc["identifier"], F.lit(r"\b")))
    return F.coalesce(named, F.lit(False))


def iou_strict(locs: Column, labels: Column) -> Column:
    p, q = _pairs(locs, "file"), _pairs(labels, "path")
    sizes = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), lambda z: F.struct(F.size(z["p"]).alias("p"), F.size(z["q"]).alias("q"), F.size(F.array_intersect(z["p"], z["q"])).alias("both")))
    return F.get(F.transform(sizes, lambda n: _iou(n["p"], n["q"], n["both"])), F.lit(0))  # variables, so that the pairs are made once


def _iou(p: Column, q: Column, both: Column) -> Column:
    return F.when((p == 0) & (q == 0), 1.0).otherwise(F.coalesce(both / F.nullif(p + q - both, F.lit(0)), F.lit(0.0)))


def _joined(locs: Column, labels: Column, count: Callable[..., tuple], fields: str) -> Column:
    """Numbers (struct of fields) that count(files, lines, identifiers of the locations; paths, lines, words of the labels; labels of each identifier that is no plain word) finds in a row; null where either is null."""
    width = fields.count(":")

    @F.arrow_udf(f"struct<{fields}>")
    def run(file: pa.Array, line: pa.Array, name: pa.Array, path: pa.Array, at: pa.Array, body: pa.Array, rest: pa.Array) -> pa.Array:
        bodies = _flat(body)
        words = {t: _words(t) for t in set(bodies)}
        locations = _rows(file, _flat(file), [n or 0 for n in _flat(line)], _flat(name))
        wanted = _rows(path, _flat(path), [n or 0 for n in _flat(at)], [words[t] for t in bodies])
        out = [None if x is None or y is None else count(*x, *y, _labels_of(z, len(y[0]))) for x, y, z in zip(locations, wanted, rest.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x and x[k] for x in out], pa.int32()) for k in range(width)], [f.split(":")[0].strip() for f in fields.split(",")])

    text = lambda y: F.coalesce(y["text"], F.lit(""))
    # texts of ASCII characters alone have the same words in Python
    bodies = F.transform(labels, lambda y: F.when(F.octet_length(text(y)) == F.length(text(y)), text(y)).otherwise(F.array_join(F.regexp_extract_all(text(y), F.lit(rf"\b{WORD}\b"), F.lit(0)), " ")))
    # identifiers of other characters are patterns, compared one by one: all pairs in one flat array, as Spark takes no lambda in a lambda as an argument of a call
    odd = F.filter(locs, lambda x: (x["identifier"] != "") & ~F.rlike(x["identifier"], F.lit(rf"\A{WORD}\z")))
    pairs = F.arrays_zip(F.flatten(F.transform(odd, lambda x: F.array_repeat(x, F.size(labels)))).alias("x"), F.flatten(F.array_repeat(labels, F.size(odd))).alias("y"))
    rest = F.when(F.rlike(F.array_join(locs["identifier"], ""), F.lit("[^A-Za-z0-9_]")), F.transform(pairs, lambda z: _named(z["x"], z["y"])))
    return run(locs["file"], locs["line"].cast("array<int>"), locs["identifier"], labels["path"], labels["line"].cast("array<int>"), bodies, rest)


def _flat(arrays: pa.Array) -> list:
    """The elements of all rows."""
    flat = arrays.flatten()
    if pa.types.is_integer(flat.type):
        return flat.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    return flat.to_numpy(zero_copy_only=False).tolist()


def _rows(arrays: pa.Array, *flat: list) -> Iterator[tuple[list, ...] | None]:
    """The parts of flat lists that belong to each row, None for null."""
    at = 0
    for size in arrays.value_lengths().to_pylist():
        yield None if size is None else tuple(x[at : at + size] for x in flat)
        at += size or 0


def _labels_of(named: list[bool] | None, n: int) -> list[list[int]]:
    """Per identifier the labels that name it, from one flag for each of n labels."""
    return [[i for i in range(n) if named[at + i]] for at in range(0, len(named), n)] if n and named else []


_plain = re.compile(WORD).fullmatch
_words = re.compile(WORD).findall


def _hit(files: list, lines: list, names: list, paths: list, at: list, words: list, rest: list, tolerance: int, by_name: bool = True) -> int:
    """How many labels any location matches."""
    places: dict[str, set | list] = {}
    for f, n in zip(files, lines, strict=True):
        if f and n:
            places.setdefault(f, set()).add(n)
    places = {f: sorted(x) for f, x in places.items()}
    named = {x for x in names if x} if by_name else set()
    others = {i for x in rest for i in x} if by_name else set()
    hits = 0
    for i, (f, n, w) in enumerate(zip(paths, at, words, strict=True)):
        near = places.get(f) if n else None
        k = bisect_left(near, n - tolerance) if near else 0
        hits += bool(near and k < len(near) and near[k] <= n + tolerance) or i in others or not named.isdisjoint(w)
    return hits


def _taken(files: list, lines: list, names: list, paths: list, at: list, words: list, rest: list, tolerance: int) -> int:
    """How many labels are taken when each location in order takes the first that is left and matches."""
    by_line: dict[str, dict[int, list[int]]] = {}
    by_word: dict[str, list[int]] = {x: [] for x in names if x}
    wanted = by_word.keys()
    known = {f for f in files if f}
    for i in range(len(paths) - 1, -1, -1):  # the first ones stand at the ends
        f, n = paths[i], at[i]
        if n and f in known:
            by_line.setdefault(f, {}).setdefault(n, []).append(i)
        if not wanted.isdisjoint(words[i]):
            for x in wanted & words[i]:
                by_word[x].append(i)
    places = {f: sorted(x) for f, x in by_line.items()}
    taken: set[int] = set()

    def first(left: list[int]) -> int:
        while left and left[-1] in taken:
            left.pop()
        return left[-1] if left else len(paths)

    others = iter(rest)
    for f, n, x in zip(files, lines, names, strict=True):
        best = len(paths)
        if n and f in places:
            near = places[f]
            k = bisect_left(near, n - tolerance)
            while k < len(near) and near[k] <= n + tolerance:
                best = min(best, first(by_line[f][near[k]]))
                k += 1
        if x:
            best = min(best, first(by_word[x]) if _plain(x) else next((i for i in next(others, ()) if i not in taken), best))
        if best < len(paths):
            taken.add(best)
    return len(taken)


def _strict(files: list, lines: list, names: list, paths: list, at: list, words: list, rest: list) -> tuple[int, int, int]:
    """Distinct pairs of the locations, of the labels, and of both."""
    p, q = ({(f, n) for f, n in zip(*x, strict=True) if f and n} for x in ((files, lines), (paths, at)))
    return len(p), len(q), len(p & q)


def iou_lenient(locs: Column, labels: Column, tolerance: int = TOLERANCE) -> Column:
    """Each location in order takes the first label that is left and matches."""
    both = _joined(locs, labels, lambda *x: (_taken(*x, tolerance),), "n: int")["n"]
    return _iou(F.size(locs), F.size(labels), both)


def _some(locs: Column) -> Column:
    return F.coalesce(locs, F.array().cast("array<struct<file: string, line: int, identifier: string>>"))


def _share(hit: Column, labels: Column) -> Column:
    return F.when(F.size(labels) == 0, 1.0).otherwise(hit / F.nullif(F.size(labels), F.lit(0)))


def hit_rate(locs: Column, labels: Column, tolerance: int = TOLERANCE) -> Column:
    return _share(_joined(_some(locs), labels, lambda *x: (_hit(*x, tolerance),), "n: int")["n"], labels)


def hit_rate_strict(locs: Column, labels: Column) -> Column:
    return _share(_joined(_some(locs), labels, lambda *x: (_hit(*x, 0, by_name=False),), "n: int")["n"], labels)


def lexical(locs: Column, labels: Column, tolerance: int = TOLERANCE) -> Column:
    """(iou, hit_strict, hit) of iou_strict, hit_rate_strict and hit_rate, in one pass."""
    n = _joined(_some(locs), labels, lambda *x: (*_strict(*x), _hit(*x, 0, by_name=False), _hit(*x, tolerance)), "p: int, q: int, both: int, strict: int, hit: int")
    iou = F.when(locs.isNull() | labels.isNull(), 0.0).otherwise(_iou(n["p"], n["q"], n["both"]))
    return F.struct(iou.alias("iou"), _share(n["strict"], labels).alias("hit_strict"), _share(n["hit"], labels).alias("hit"))
