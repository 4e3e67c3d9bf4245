"""Porter's stemmer (M.F. Porter, 1980) with the usual extensions of later implementations.

The extensions: a table of irregular forms, -ies and -ied of short words to -ie, -y to -i only after a
consonant that isn't the first letter, and the endings -alli, -fulli and -logi.
"""

from __future__ import annotations

from functools import cache, lru_cache

# Irregular forms.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = frozenset(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))
_SECOND, _THIRD = frozenset(SECOND), frozenset(THIRD)


_LETTERS = "".join("v" if chr(c) in "aeiou" else "y" if chr(c) == "y" else "c" for c in range(128))


def _kinds(w: str) -> str:
    """c or v for each letter: a y is a vowel after a consonant."""
    k = (w if w.isascii() else w.encode("ascii", "replace").decode()).translate(_LETTERS)
    i = k.find("y")
    while i >= 0:
        k = k[:i] + ("v" if i and k[i - 1] == "c" else "c") + k[i + 1 :]
        i = k.find("y", i)
    return k


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _short(w: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    k = _kinds(w)
    return (len(w) > 2 and k[-3:] == "cvc" and w[-1] not in "wxy") or (len(w) == 2 and k == "vc")


@cache
def _last(endings: frozenset) -> tuple[frozenset, tuple[int, ...]]:
    """The last letters of endings, and their lengths, longest first."""
    return frozenset(x[-1] for x in endings), tuple(sorted({len(x) for x in endings}, reverse=True))


def _longest(w: str, endings: frozenset) -> str | None:
    letters, lengths = _last(endings)
    if w[-1:] in letters:
        for n in lengths:
            if w[-n:] in endings:
                return w[-n:]
    return None


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: -len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            s = w[: -len(end)]
            if not _has_vowel(s):
                return w
            if s.endswith(("at", "bl", "iz")):
                return s + "e"
            if _double(s):
                return s if s[-1] in "lsz" else s[:-1]
            return s + "e" if measure(s) == 1 and _short(s) else s
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _second(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = _longest(w, _SECOND)
    return w[: -len(end)] + SECOND[end] if end and measure(w[: -len(end)]) > 0 else w


def _fourth(w: str) -> str:
    end = _longest(w, FOURTH)
    if not end or measure(w[: -len(end)]) <= 1 or (end == "ion" and w[-4:-3] not in ("s", "t")):
        return w
    return w[: -len(end)]


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _kinds(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _second(w)
    end = _longest(w, _THIRD)
    if end and measure(w[: -len(end)]) > 0:
        w = w[: -len(end)] + THIRD[end]
    w = _fourth(w)
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
