"""Operator 7. Chat formatting by schema fingerprints.

Records come as JSON objects of any layout. The sorted paths of a record's nested fields are hashed,
and the hash selects a declarative mapping to canonical turns (conversation, order, role, text).
Turns are then written in one template, with the spans of the assistant texts as loss mask.

Control strings of the template start with ``<`` or ``[``. In texts and role names these and the
backslash get a backslash in front, so no text can end a turn, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table


class Layout(NamedTuple):
    """Where a layout keeps its turns. ``each`` is a list of objects; fixed turns have a role here."""

    name: str
    paths: tuple[str, ...]
    key: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), "conv_id",
           role="role", text="text", order="turn"),
    Layout("prompt and response", ("conv_id", "prompt", "response"), "conv_id",
           fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("conv_id", "prompt", "completion"), "conv_id",
           fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("conv_id", "instruction", "output"), "conv_id",
           fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("conv_id", "instruction", "input", "output"), "conv_id",
           fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system, question and answer", ("conv_id", "system", "question", "answer"), "conv_id",
           fixed=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id",
           each="messages", role="role", text="content"),
    Layout("no messages", ("conv_id", "messages[]"), "conv_id", each="messages", role="role",
           text="content"),
    Layout("speakers", ("conv_id", "conversations[].from", "conversations[].value"), "conv_id",
           each="conversations", role="from", text="value"),
    Layout("nested messages", ("conv_id", "data.messages[].author.role",
                               "data.messages[].content.text"), "conv_id",
           each="data.messages", role="author.role", text="content.text"),
)
#: Other names of the canonical roles, in lists of messages. Turn rows name their roles themselves.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(value: Any, at: str = "") -> set[str]:
    """Paths of the leaves; ``[]`` stands for all items of a list."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        inner = {p for v in value for p in paths_of(v, f"{at}[]")}
        return inner or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _get(value: Any, path: str | None) -> Any:
    for step in (path or "").split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _string(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _long(value: Any) -> int | None:
    """Whole number of 64 bits, or nothing."""
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if -(2**63) <= number < 2**63 else None


def turns_of(record: Any, layout: Layout) -> Iterator[tuple[int | None, int, str, str]]:
    """Order, place, role and text of a record's turns."""
    if layout.fixed:
        for i, (role, parts) in enumerate(layout.fixed):
            yield None, i, role, "\n\n".join(t for p in parts if (t := _string(_get(record, p))))
        return
    items = _get(record, layout.each) or [] if layout.each else [record]
    for i, item in enumerate(items):
        role = _string(_get(item, layout.role))
        if layout.each:
            role = ROLES.get(role, role)
        yield (_long(_get(record, layout.order)) if layout.order else None, i, role,
               _string(_get(item, layout.text)))


def canonical_turns(records: DataFrame, column: str = "record",
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per turn: conv_id, turn, place, role, text, fingerprint and layout.

    Null texts and roles become empty, a key or order that is no whole number null. A record that is null, no JSON object, or of a layout that no
    mapping has, gives one row with its text, fingerprint and a null layout, so nothing is lost
    silently. Only ``column`` is read.
    """
    by_print = {fingerprint(x.paths): x for x in layouts}
    names = ["conv_id", "turn", "place", "role", "text", "fingerprint", "layout"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mark = fingerprint(paths_of(record))
                layout = by_print.get(mark) if isinstance(record, dict) else None
                if layout is None:
                    rows.append((None, None, 0, None, raw, mark, None))
                    continue
                key = _long(_get(record, layout.key))
                rows.extend((key, *t, mark, layout.name) for t in turns_of(record, layout))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return records.select(column).mapInArrow(
        convert, "conv_id long, turn long, place long, role string, text string, "
                 "fingerprint string, layout string")


# Control strings of the template.
BEGIN, SYSTEM, SYSTEM_END = "<s>", "<<SYS>>", "<</SYS>>"
USER, USER_END, REPLY_END = "[INST]", "[/INST]", "</s>"
OTHER, OTHER_TEXT, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"

_MARK = re.compile(r"(?<!\\)((?:\\\\)*)(<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\])")


def escape(text: str) -> str:
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def write_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation, and the spans of the assistant texts in it."""
    out, size, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((size, size + len(body)))
            part = body + REPLY_END
        elif role == "user":
            part = USER + body + USER_END
        elif role == "system":
            part = SYSTEM + body + SYSTEM_END
        else:
            part = OTHER + escape(role) + OTHER_TEXT + body + OTHER_END
        out.append(part)
        size += len(part)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at, role = [], 0, ""
    for m in _MARK.finditer(formatted):
        mark, body = m[2], formatted[at:m.start(2)]
        at = m.end()
        if mark == REPLY_END:
            turns.append(("assistant", unescape(body)))
        elif mark == USER_END:
            turns.append(("user", unescape(body)))
        elif mark == SYSTEM_END:
            turns.append(("system", unescape(body)))
        elif mark == OTHER_TEXT:
            role = unescape(body)
        elif mark == OTHER_END:
            turns.append((role, unescape(body)))
    return turns


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted text and loss spans (code points, end excluded).

    Turns are ordered by turn, place, role and text, nulls first; equal rows are all kept. Turns of
    no layout are left out. Rows of one conversation meet in one task, which holds one conversation
    at a time.
    """
    order = ["conv_id", "turn", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, done = None, [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.string()),
                pa.array([[{"start": a, "end": z} for a, z in d[2]] for d in done],
                         pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], ["conv_id", "formatted", "loss"])
            done.clear()
            return out

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
                if have and conv != now:
                    done.append((now, *write_turns(have)))
                    have = []
                now = conv
                have.append((role or "", text or ""))
            if done:
                yield flush()
        if have:
            done.append((now, *write_turns(have)))
            yield flush()

    return (turns.where("layout IS NOT NULL").select(order).repartition("conv_id")
            .sortWithinPartitions(*order)
            .mapInArrow(run, "conv_id long, formatted string, "
                             "loss array<struct<start: int, end: int>>"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the formatted conversations, from their texts and loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = read_turns(text)
                body = "".join(f"{role}\n{said}\n" for role, said in turns)
                learnt = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                rows.append((conv, len(turns), hashlib.sha256(body.encode()).hexdigest(),
                             len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")


def op7_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -7, whose texts hold control strings.

    The table's rows are records of the layout "turn rows", conversation -7 is one of "prompt and
    response".
    """
    rows = table(spark, sf_dir, "conversations").select(F.to_json(
        F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.to_json(F.struct(
        F.lit(-7).alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"),
    )).alias("record"))
    return read_back(format_turns(canonical_turns(rows.unionByName(more))))


QUERIES = {"op7_chat_fingerprint": op7_chat_fingerprint}
ORACLES: dict[str, str] = {}
