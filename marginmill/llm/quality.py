"""Line-first quality rules: lines are judged alone, then what is left of the document.

A line with words fails if it has no sentence end, if it is navigation (a bar or trail of short
entries between separators, or a page switch), or if it holds boilerplate: phrases of notices,
consent, accounts, sharing and page furniture in English, French, German and Spanish, each of a form that
running prose does not take. Failing lines are cut out. A document that loses too large a share of
its words is rejected; so is one that fails the base rules on its whole text.

Everything is a column expression over one row; the words' windows are hashed from one array, and only
positions of hashes that occur twice are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
#: A line passes if it ends in one of these marks (perhaps with a closing quote or bracket), or has one inside before a space.
SENTENCE_END = r"[.!?;:…。！？]([\"')\]”’»]*[\x20\x09-\x0D]|[\"')\]”’»]*$)"
#: Three short entries or more between separators; a trail of pages; a page switch.
NAVIGATION = r"([|»›•·→][\x20\x09-\x0D]+[^|»›•·→]{1,40}){3,}|^[\x20\x09-\x0D]*([^>/|]{1,30}[\x20\x09-\x0D](>|/|::)[\x20\x09-\x0D]){2,}[^>/|]{1,40}$|(?i)^[\x20\x09-\x0D]*(page|seite|página) [0-9]+ (of|de|von|sur) [0-9]+"
#: In lower case; a line of up to SHORT_LINE characters that contains one is boilerplate (longer lines are prose that speaks of it).
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "enable javascript", "click here",
    "sign up", "log in to", "subscribe to", "skip to content", "back to top", "lorem ipsum", "licensed under", "released under the", "copyright (c)", "read more", "share this", "powered by",
    "add to cart", "tous droits réservés", "mentions légales", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "cliquez ici", "en savoir plus", "abonnez-vous",
    "haut de page", "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "hier klicken", "mehr erfahren", "newsletter abonnieren", "nach oben",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "utiliza cookies", "aceptar cookies", "haga clic", "leer más", "suscríbete", "volver arriba",
)
SHORT_LINE = 240
MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 50
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "clean_text"]


def _has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _any_of(low: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def failing(line: Column) -> Column:
    """Whether a line with words fails one of the line rules."""
    return (~line.rlike(SENTENCE_END)) | line.rlike(NAVIGATION) | ((F.length(line) <= SHORT_LINE) & _any_of(F.lower(line), BOILERPLATE))


def clean(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_lost: int = MAX_LOST) -> DataFrame:
    """docs with the measures of each whole text, ``clean_text`` and the verdict ``kept``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    base_failed, kept, clean_text (the lines that pass; those without words stay). Columns of docs
    with these names are replaced. A null text is an empty one, and fails the base rules, as does
    any text under min_words words. Rows are judged one by one, so repeated rows get the same result
    and very long texts need memory for their own arrays only; an empty table gives no rows.
    """
    docs = docs.drop(*MADE)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    even = body
    for c in SPACES:
        even = F.replace(even, F.lit(c), F.lit(" "))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), body.alias("_t"), F.array_remove(F.split(even, " "), "").alias("_w"))
    # hashes of the windows of three words; the shifted words are looked up in the one array
    window = F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(
        "row", "_t",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_w").cast("long").alias("n_words"),
        F.when(F.size("_w") > 3, F.slice(window, 1, F.size("_w") - 2)).alias("_h"),
    )
    # only hashes that occur twice are sorted, with their positions
    df = df.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")))
    twice = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select("row", "_t", "word_chars", "n_words", twice.alias("_s"))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.filter(F.transform("_s", lambda x, i: F.when(same(x, F.get("_s", i + 1)) | same(x, F.try_element_at("_s", F.when(i > 0, i))), x["i"])), lambda x: x.isNotNull())
    df = df.select("row", "_t", "word_chars", "n_words", F.array_sort(F.coalesce(repeated, F.array().cast("array<int>"))).alias("_r"))
    # each repeated window covers three words, less those of the next repeated window
    covered = F.aggregate(F.transform("_r", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - x, F.lit(3)))), F.lit(0), lambda t, x: t + x)
    df = df.select("row", "_t", "word_chars", "n_words", covered.cast("long").alias("n_repeat_words"), F.split("_t", "\n").alias("_l"))
    df = df.withColumn("_bad", F.filter("_l", lambda x: _has_words(x) & failing(x)))
    full = F.filter("_l", _has_words)
    df = df.withColumn("n_dup_lines", (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
    lost = F.aggregate("_bad", F.lit(0), lambda t, x: t + F.regexp_count(x, F.lit(WORD)))
    df = df.withColumn("n_lost_words", lost.cast("long"))
    cut = F.array_join(F.filter("_l", lambda x: ~(_has_words(x) & failing(x))), "\n")
    df = df.withColumn("clean_text", F.when(F.size("_bad") == 0, F.col("_t")).otherwise(cut))
    df = df.withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= max_lost * F.col("n_words")))
    return df.select("row.*", *MADE)
