"""Column builders over reviews and diffs: locations, identifiers, tagged blocks and parsed answers."""

from __future__ import annotations

import builtins
import keyword
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (patterns and phrases that results depend on).
PLACE = r"`([A-Za-z0-9_./\-]+\.(?:py|js|jsx|ts|tsx|java|go|rb|c|cpp|h|hpp|rs)(?::\d+)?)`"
#: From a backtick to the last one that characters of PLACE and TICKED_NAME lead to.
TICKED = r"`[A-Za-z0-9_./:\-`]*`"
TICKED_NAME = r"`([A-Za-z_][A-Za-z0-9_]{1,40})`"
NAME_3 = r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"
NAME_2_41 = r"[A-Za-z_][A-Za-z0-9_]{1,40}"
METADATA = r"^(\+\+\+|---|diff |index |new file|deleted file|similarity index|rename |Binary files|GIT binary)"
CLEAN_VERDICT = ("no issue", "looks correct", "looks good", "no bug", "no significant", "no major", "lgtm")
ASSERTS = r"(?i)\b(bug|issue|error|incorrect|wrong|missing|fail|broken|vulnerab|leak|race)\b"
QUIET = r"(?i)(no (major |significant |obvious |apparent )?(issues?|bugs?|problems?)|looks (good|correct|fine)|lgtm)"
LOOP = r"(?s)(.{15,80}?)\1{9,}"
#: What each loop of a unit of 15 to 29, 30 to 59 or 60 to 80 characters has at one of every 75th, 150th or 300th: five of its ten units, whole.
LOOP_PROBES = tuple(rf"(?s)\A(?:.{{{5 * a}}})*?(?=(.{{{a},{b}}}?)\1{{4}})" for a, b in ((15, 29), (30, 59), (60, 80)))
FALSE_REFERENCES = (
    r"(?i)the `([a-zA-Z_][a-zA-Z0-9_]{2,})` (?:is|was|should|has|does|needs)",
    r"(?i)`([a-zA-Z_][a-zA-Z0-9_]{2,})` (?:function|method|variable|class|field|attribute)",
)
SMALL_STOP = ("self", "return", "import", "class", "True", "False", "None", "with", "from", "def", "the", "and", "for", "not", "this", "that", "list", "dict", "str", "int")
BUG_WORDS = ("bug", "error", "incorrect", "broken", "wrong", "missing", "problem", "should fix", "should use", "issue", "antipattern", "dangerous", "unsafe")
FEATURES = (".first()", '"true"', '"false"', "MAX_", "TIMEOUT", "RETRY")
CONCLUSION = r"(?i)(?:^|\n)\s*(?:\d+\.\s*)?(?:identifier-grounded\s+)?conclusion:?\s*([^\n]{20,500})"
SHORT_REVIEW = 20


def stopwords(extra: tuple[str, ...] = ()) -> list[str]:
    """Vocabulary of reviewers that names no symbol of a diff: Python's keywords, builtins and typing names, and extra ones."""
    return sorted({*keyword.kwlist, *dir(builtins), *typing.__all__, *SMALL_STOP, "self", "cls", *extra})


def loops(c: Column) -> Column:
    """Whether LOOP is found. It tries 66 units at each character, so only texts that a probe lets through are searched."""
    a, b, last = (F.rlike(c, F.lit(p)) for p in LOOP_PROBES)
    return (a | b | last) & F.rlike(c, F.lit(LOOP))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Any Unicode line boundary, in Java's pattern syntax.
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"


def split_lines(c: Column) -> Column:
    """Lines by any Unicode line boundary, without a last empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, LINE_END + r"\z", ""), LINE_END))


def locations(review: Column) -> Column:
    """Distinct (file, line, identifier) of backticked paths, then of backticked names of 3 letters or more."""
    # each pass runs over the ticked parts alone: no place or name reaches beyond one
    ticked = F.array_join(F.regexp_extract_all(F.coalesce(review, F.lit("")), F.lit(TICKED), F.lit(0)), " ")
    return F.get(F.transform(F.array(ticked), _ticked_locations), F.lit(0))  # a variable, so that the parts are found once


def _ticked_locations(body: Column) -> Column:
    number = lambda x: F.nullif(F.split_part(x, F.lit(":"), F.lit(2)), F.lit("")).try_cast("int")
    file = lambda x: F.split_part(x, F.lit(":"), F.lit(1))
    # as strings, which are told apart by a hash and not by pairs; paths have no colon
    places = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(PLACE), F.lit(1)), lambda x: F.concat_ws(":", file(x), number(x).cast("string"))))
    found = F.transform(places, lambda x: F.struct(file(x).alias("file"), number(x).alias("line"), F.lit(None).cast("string").alias("identifier")))
    names = F.filter(F.array_distinct(F.regexp_extract_all(body, F.lit(TICKED_NAME), F.lit(1))), lambda x: F.length(x) >= 3)
    single = F.transform(names, lambda x: F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), x.alias("identifier")))
    return F.concat(found, single)


def names_in_hunks(diff: Column) -> Column:
    """Names of 2 to 41 letters in the hunks of a diff: hunk headers, added, removed and context lines."""
    hunks = F.regexp_extract(F.coalesce(diff, F.lit("")), r"(?s)(?:\A|" + LINE_END + ")(@@.*)", 1)  # from the first hunk header on
    meta = lambda x: F.rlike(x, F.lit(METADATA))
    body = F.filter(F.split(hunks, LINE_END), lambda x: x.startswith("@@") | (F.substring(x, 1, 1).isin("+", "-", " ") & ~meta(x)))
    return F.array_distinct(F.flatten(F.transform(body, lambda x: F.regexp_extract_all(x, F.lit(NAME_2_41), F.lit(0)))))


def names_changed(diff: Column, stop: list[str], headers: bool = False, least: int = 3) -> Column:
    """Names on added and removed lines, without stop words; with headers, file header lines count too."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    changed = F.filter(lines, lambda x: F.substring(x, 1, 1).isin("+", "-") & (F.lit(headers) | ~(x.startswith("+++") | x.startswith("---"))))
    names = F.flatten(F.transform(changed, lambda x: F.regexp_extract_all(x, F.lit(NAME_3), F.lit(0))))
    return F.filter(F.array_except(F.array_distinct(names), F.array(*map(F.lit, stop))), lambda x: F.length(x) >= least)


def ticked_names(review: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.coalesce(review, F.lit("")), F.lit(TICKED_NAME), F.lit(1))), F.array(*map(F.lit, stop)))


def unknown_name_ratio(review: Column, diff: Column, stop: list[str]) -> Column:
    """Share of the review's backticked names that no hunk of the diff has; 0 where there are none."""
    names = ticked_names(review, stop)
    return F.when(F.size(names) > 0, F.size(F.array_except(names, names_in_hunks(diff))) / F.size(names)).otherwise(0.0)


def unknown_name_flag(review: Column, diff: Column, stop: list[str]) -> Column:
    """Whether any backticked name is no substring of the diff."""
    return F.exists(ticked_names(review, stop), lambda x: ~F.contains(F.coalesce(diff, F.lit("")), x))


def known_names(review: Column, names: Column) -> Column:
    """How many of names are substrings of the review."""
    return F.size(F.filter(names, lambda x: F.contains(review, x)))


def false_references(review: Column, source: Column) -> Column:
    """Names that the review speaks of as symbols and the source lacks."""
    named = F.concat(*(F.regexp_extract_all(review, F.lit(p), F.lit(1)) for p in FALSE_REFERENCES))
    return F.filter(F.array_distinct(named), lambda x: ~F.contains(source, x))


def review_block(raw: Column, ignore_case: bool = False) -> Column:
    """The review of a model's output: the first block after the last closed thought, else the last full block, else what is left without tags."""
    flag = "(?is)" if ignore_case else "(?s)"
    raw = F.coalesce(raw, F.lit(""))
    after = F.substring_index(raw, "</think>", -1)
    block = F.lit(flag + "<review>(.*?)</review>")
    direct = F.contains(raw, F.lit("</think>")) & F.regexp_like(after, block)
    full = F.filter(F.transform(F.regexp_extract_all(raw, block, F.lit(1)), strip), lambda x: ~x.isin("", "..."))
    bare = F.regexp_replace(F.regexp_replace(raw, flag + r"<think>.*?</think>", ""), flag + r"<review>\s*(\.\.\.)?\s*</review>", "")
    return F.when(direct, strip(F.regexp_extract(after, flag + "<review>(.*?)</review>", 1))).when(F.size(full) > 0, F.element_at(full, -1)).otherwise(strip(bare))


def without_thoughts(raw: Column, unclosed: bool = True) -> Column:
    """The text outside <think> blocks; an unclosed one reaches to the end."""
    out = strip(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""))
    return strip(F.regexp_replace(out, r"(?is)<think>.*$", "")) if unclosed else out


def first_block(raw: Column) -> Column:
    """The first review block, whatever its case; without one the text outside thoughts."""
    raw = F.coalesce(raw, F.lit(""))
    block = F.lit("(?is)<review>(.*?)</review>")
    return F.when(F.regexp_like(raw, block), strip(F.regexp_extract(raw, "(?is)<review>(.*?)</review>", 1))).otherwise(without_thoughts(raw))


def salvaged(raw: Column) -> Column:
    """(level, review): 1 the first block, 2 a conclusion line, 3 the text outside thoughts of 20 characters or more, 4 the last 300."""
    raw = F.coalesce(raw, F.lit(""))
    line = strip(F.regexp_extract(raw, CONCLUSION, 1))
    outside = without_thoughts(raw)
    level = F.when(F.regexp_like(raw, F.lit("(?is)<review>.*?</review>")), 1).when(F.length(line) >= 20, 2).when(F.length(outside) >= 20, 3).otherwise(4)
    last = strip(F.substring(raw, -300, 300))
    review = F.when(level == 1, strip(F.regexp_extract(raw, "(?is)<review>(.*?)</review>", 1))).when(level == 2, line).when(level == 3, outside).otherwise(F.when(F.length(raw) <= 300, strip(raw)).otherwise(last))
    return F.struct(level.alias("level"), review.alias("review"))


def extraction_level(raw: Column) -> Column:
    """The level that the breakdown counts: 1 an opening tag, 2 a conclusion line, 3 any text outside thoughts, 4 none."""
    raw = F.coalesce(raw, F.lit(""))
    return F.when(F.contains(F.lower(raw), F.lit("<review>")), 1).when(F.regexp_like(raw, F.lit(CONCLUSION)), 2).when(without_thoughts(raw) != "", 3).otherwise(4)


def last_block(raw: Column) -> Column:
    """The first full block after the last closed thought, else the last full block, else the text outside thoughts; any case of tags."""
    raw = F.coalesce(raw, F.lit(""))
    after = F.when(F.contains(raw, F.lit("</think>")), strip(F.regexp_extract(F.substring_index(raw, "</think>", -1), "(?is)<review>(.*?)</review>", 1))).otherwise("")
    full = F.filter(F.transform(F.regexp_extract_all(raw, F.lit("(?is)<review>(.*?)</review>"), F.lit(1)), strip), lambda x: ~x.isin("", "..."))
    return F.when(after != "", after).when(F.size(full) > 0, F.element_at(full, -1)).otherwise(without_thoughts(raw))


def base_review(raw: Column) -> Column:
    """A base model's output: extracted only where it has a review tag."""
    return F.when(F.contains(raw, F.lit("<review>")), review_block(raw)).otherwise(strip(F.coalesce(raw, F.lit(""))))


def thought_and_draft(thought: Column, answer: Column) -> Column:
    """(think, draft) of a first call: a thought within the answer counts where none came apart; the draft is the review block or all."""
    thought, answer = strip(F.coalesce(thought, F.lit(""))), strip(F.coalesce(answer, F.lit("")))
    inline = (thought == "") & F.regexp_like(answer, F.lit("(?is)<think>.*?</think>")) & F.contains(answer, F.lit("<think>"))
    think = F.when(inline, strip(F.regexp_extract(answer, "(?is)<think>(.*?)</think>", 1))).otherwise(thought)
    rest = F.when(inline, without_thoughts(answer, unclosed=False)).otherwise(answer)
    draft = F.when(F.regexp_like(rest, F.lit("(?is)<review>.*?</review>")), strip(F.regexp_extract(rest, "(?is)<review>(.*?)</review>", 1))).otherwise(rest)
    return F.struct(think.alias("think"), draft.alias("draft"))


def trace_target(think: Column, review: Column) -> Column:
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n<review>\n"), review, F.lit("\n</review>"))


def trace_parts(raw: Column) -> Column:
    """(think, review) of a trace; both null unless both are there and not empty."""
    parts = [strip(F.regexp_extract(F.coalesce(raw, F.lit("")), f"(?is)<{t}>(.*?)</{t}>", 1)) for t in ("think", "review")]
    full = (parts[0] != "") & (parts[1] != "")
    return F.struct(F.when(full, parts[0]).alias("think"), F.when(full, parts[1]).alias("review"))


def reconciliation(raw: Column) -> Column:
    """(text, label) of the reconciliation block; a missing label is ''."""
    body = strip(F.regexp_extract(F.coalesce(raw, F.lit("")), "(?is)<reconciliation>(.*?)</reconciliation>", 1))
    return F.struct(body.alias("text"), F.upper(F.regexp_extract(body, r"(?i)LABEL:\s*(AGREE|REFERENCE_BETTER|DRAFT_BETTER|BOTH_VALID)", 1)).alias("label"))


def diff_paths(diff: Column) -> Column:
    """Distinct paths of the file headers of a diff, without a/ and b/, /dev/null and empty ones."""
    heads = F.filter(split_lines(F.coalesce(diff, F.lit(""))), lambda x: x.startswith("+++ ") | x.startswith("--- "))
    paths = F.transform(heads, lambda x: strip(F.substr(x, F.lit(5))))
    return F.array_distinct(F.transform(F.filter(paths, lambda x: ~x.isin("", "/dev/null")), lambda x: F.regexp_replace(x, "^[ab]/", "")))


def pairwise_verdict(raw: Column, swapped: Column) -> Column:
    """A, B or TIE of a judge's answer; swapped answers are turned back."""
    up = F.upper(F.coalesce(raw, F.lit("")))
    a, b = F.contains(up, F.lit("A")), F.contains(up, F.lit("B"))
    plain = F.when(F.contains(up, F.lit("TIE")), "TIE").when(a & ~b, "A").when(b & ~a, "B").otherwise("TIE")
    return F.when(swapped & (plain == "A"), "B").when(swapped & (plain == "B"), "A").otherwise(plain)


def judge_score(raw: Column) -> Column:
    """First integer, held between 0 and 10; 5 where there is none."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"\d+", 0)
    return F.when(found == "", 5).otherwise(F.coalesce(F.least(found.try_cast("int"), F.lit(10)), F.lit(10)))


def claim_count(raw: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(raw, F.lit("")), r"\d+", 0).try_cast("int"), F.lit(0))


def yes_no(raw: Column) -> Column:
    up = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(F.length(strip(up)) == 0, "EMPTY").when(F.contains(up, F.lit("YES")), "YES").when(F.contains(up, F.lit("NO")), "NO").otherwise("UNKNOWN")


def names_any(review: Column, expected: Column) -> Column:
    return F.exists(expected, lambda k: F.contains(F.lower(review), F.lower(k)))


def says_clean(review: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CLEAN_VERDICT)), lambda k: F.contains(F.lower(review), k))


def status_family(status: Column) -> Column:
    return F.split_part(status, F.lit(":"), F.lit(1))


def finish_reason(raw: Column) -> Column:
    return F.upper(F.element_at(F.split(raw, r"\."), -1))


def starts_yes(raw: Column) -> Column:
    return strip(F.upper(F.coalesce(raw, F.lit("")))).startswith("Y")


def passes_pattern(pattern: Column, expected: Column, review: Column) -> Column:
    """Whether a review names one of the expected words; on diffs without an issue it may also just claim none."""
    low = F.lower(review)
    claims = F.exists(F.array(*map(F.lit, BUG_WORDS)), lambda w: F.contains(low, w))
    return names_any(review, expected) | ((pattern == "no_issue_diffs") & ~claims)


def asserts(review: Column) -> Column:
    return F.rlike(F.coalesce(review, F.lit("")), F.lit(ASSERTS))


def is_quiet(review: Column) -> Column:
    """No claim of a defect, or a statement that there is none."""
    body = F.coalesce(review, F.lit(""))
    return F.rlike(body, F.lit(QUIET)) | ~asserts(body)


def feature(diff: Column, features: tuple[str, ...] = FEATURES) -> Column:
    """The first of the features that a diff holds, in any case."""
    return F.coalesce(*(F.when(F.contains(F.lower(diff), F.lit(x.lower())), x) for x in features))


def unless_short(review: Column, value, otherwise: Column) -> Column:
    """value for reviews under 20 characters, which no judge is asked about."""
    return F.when(F.length(strip(F.coalesce(review, F.lit("")))) < SHORT_REVIEW, value).otherwise(otherwise)


def percent(x: Column, digits: int = 1) -> Column:
    """0.123 as 12.3%; n/a for null."""
    return F.coalesce(F.concat(F.format_number(100 * x, digits), F.lit("%")), F.lit("n/a"))


def signed(x: Column, digits: int = 4) -> Column:
    return F.coalesce(F.concat(F.when(x >= 0, "+").otherwise(""), F.format_number(x, digits)), F.lit("n/a"))


def interval_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), signed(low), F.lit(", "), signed(high), F.lit("]"))


def _truthy(v: Column) -> Column:
    """Python's truth of a JSON value: false, null, zero, '' and empty lists and objects aren't true; the string 'false' is."""
    kind, body = F.schema_of_variant(v), v.cast("string")
    empty = (kind == "VOID") | ((kind == "BOOLEAN") & (body == "false")) | ((kind == "STRING") & (body == "")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.to_json(v).try_cast("double") == 0)) | F.to_json(v).isin("[]", "{}")
    return F.coalesce(~empty, F.lit(False))


def comment_verdict(raw: Column) -> Column:
    """(issue_type, canonical_desc) of a classifier's JSON answer, fenced or not; null unless it calls a full defect."""
    body = strip(F.coalesce(raw, F.lit("")))
    fenced = "(?s)```(?:json)?\\s*(.*?)```"
    parsed = F.try_parse_json(F.when(F.regexp_like(body, F.lit(fenced)), strip(F.regexp_extract(body, fenced, 1))).otherwise(body))
    field = lambda x: F.try_variant_get(parsed, f"$.{x}", "variant")
    full = _truthy(field("is_defect")) & _truthy(field("issue_type")) & _truthy(field("canonical_desc"))
    return F.when(full, F.struct(field("issue_type").cast("string").alias("issue_type"), field("canonical_desc").cast("string").alias("canonical_desc")))
