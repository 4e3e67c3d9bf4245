"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation's turns are read in order; the machine checks each role against those that may follow
the role before. Every turn gives three segments of text: its opening mark, its escaped text and its
closing mark. Only segments of texts of roles that the template trains on are under the loss mask.
Rows are dealt by conversation and streamed in order, so that no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "roles": {
        "system": {"open": "<s>[SYS] ", "close": " [/SYS]\n", "loss": False},
        "user": {"open": "<s>[INST] ", "close": " [/INST]\n", "loss": False},
        "assistant": {"open": "<s>[OUT] ", "close": " </s>\n", "loss": True},
    },
    #: Any other role, named in JSON in its opening mark.
    "other": {"open": "<s>[ROLE] ", "named": " [/ROLE] ", "close": " [/TURN]\n", "loss": False},
    "controls": ["<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]"],
    "follows": {None: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "ends": ["assistant"],
}
SEGMENT = "conv_id long, turn_no long, part int, segment string, loss boolean, error string, last boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"
_MARK = "\\"


@cache
def _between(controls: tuple[str, ...], least: int) -> tuple[str, re.Pattern]:
    """The first characters of the control strings, and a pattern for one with least or more marks after its first character."""
    by: dict[str, list[str]] = {}
    for c in sorted(controls, key=len, reverse=True):
        by.setdefault(c[0], []).append(re.escape(c[1:]))
    alternatives = "|".join(f"(?<={re.escape(first)})(\\\\{{{least},}})(?={'|'.join(rests)})" for first, rests in by.items())
    return "".join(by), re.compile(alternatives)


def _marked(body: str, template: dict, least: int, change) -> str:
    firsts, pattern = _between(tuple(template["controls"]), least)
    if not any(c in body for c in firsts):
        return body
    return pattern.sub(lambda m: change(next(x for x in m.groups() if x is not None)), body)


def escape(body: str, template: dict = TEMPLATE) -> str:
    """Control strings get one mark more after their first character; all else stays."""
    return _marked(body, template, 0, lambda marks: marks + _MARK)


def unescape(body: str, template: dict = TEMPLATE) -> str:
    return _marked(body, template, 1, lambda marks: marks[1:])


def _format(template: dict):
    def run(batches):
        hold, conv, number, role_before, error = None, object(), 0, None, None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in SEGMENT.split(", ")]

        def segments(row, last):
            conv_id, no, role, body, bad = row
            how = template["roles"].get(role)
            if last and not bad and role not in template["ends"]:
                bad = f"ends with {role}"
            opening = how["open"] if how else template["other"]["open"] + escape(json.dumps(role), template) + template["other"]["named"]
            how = how or template["other"]
            for part, (x, loss) in enumerate(((opening, False), (escape(body, template), how["loss"]), (how["close"], False))):
                yield conv_id, no, part, x, loss, bad, last and part == 2

        for batch in batches:
            out = []
            for conv_id, role, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv_id != conv:
                    if hold:
                        out += segments(hold, True)
                    conv, number, role_before, error = conv_id, 0, None, None
                elif hold:
                    out += segments(hold, False)
                if error is None and role not in template["follows"].get(role_before, []):
                    error = f"turn {number}: {role} after {role_before or 'start'}"
                hold, number, role_before = (conv_id, number, role, body or "", error), number + 1, role
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if hold:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*segments(hold, True), strict=True), kinds, strict=True)], names=names)

    return run


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of all conversations, in order within a partition: conv_id, turn_no, part, segment, loss, error, last.

    turns has conv_id, turn, role and text; further columns are ignored. Rows of a conversation go
    by turn (null first), ties by role and text; rows that repeat are turns of their own. A null text
    is empty; rows without conv_id are one conversation. Conversations that break the order of roles
    are formatted all the same, and error names their first offence. An empty table gives no rows.
    """
    df = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    df = df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return df.select("conv_id", "role", "text").mapInArrow(_format(template), SEGMENT)


def _parse(template: dict):
    marks = {how["open"]: (role, how["close"]) for role, how in template["roles"].items()}
    other = template["other"]

    def turns_of(buffer: str):
        """Turns at the start of the formatted text, and the rest of it."""
        while True:
            for opening, (role, close) in marks.items():
                if buffer.startswith(opening):
                    end, skip = buffer.find(close, len(opening)), len(opening)
                    break
            else:
                role, close, end, skip = None, other["close"], -1, 0
                if buffer.startswith(other["open"]) and (named := buffer.find(other["named"])) > 0:
                    role, skip = json.loads(unescape(buffer[len(other["open"]) : named], template)), named + len(other["named"])
                    end = buffer.find(close, skip)
            if end < 0:
                return buffer
            yield role, unescape(buffer[skip:end], template)
            buffer = buffer[end + len(close) :]

    def run(batches):
        def fresh():
            return {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "buffer": ""}

        now = fresh()
        for batch in batches:
            out = []
            for conv_id, part, segment, loss, error, last in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                now["chars"] += len(segment)
                now["buffer"] += segment
                if loss:
                    plain = unescape(segment, template)
                    now["loss"].update(plain.encode("utf-8", "surrogatepass"))
                    now["loss_chars"] += len(plain)
                if part == 2:
                    reader = turns_of(now["buffer"])
                    while True:
                        try:
                            role, body = next(reader)
                        except StopIteration as rest:
                            now["buffer"] = rest.value
                            break
                        now["n"] += 1
                        now["all"].update(f"{role or ''}\n{body}\n".encode("utf-8", "surrogatepass"))
                if last:
                    if now["buffer"]:
                        raise ValueError(f"conversation {conv_id}: its text can't be read back")
                    out.append((conv_id, now["n"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], error is None, error))
                    now = fresh()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return run


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Per conversation what the segments hold: turns parsed from the text, and the text under the loss mask."""
    return segments.mapInArrow(_parse(template), READ)
