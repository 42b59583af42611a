"""Chat formatting with a grammar round trip (operator 4).

The template marks turns with control strings.  A text is first rendered as it is; the
rendered turn is parsed by a deterministic parser, and if the recovered turn differs
from the source, the control strings inside the text are escaped and the turn is
rendered and parsed again, until both are identical.

Grammar, one segment a turn::

    conversation = BOS turn*
    turn         = "[INST]" body "[/INST]"            (role user)
                 | "[ANS]" body "</s>"                (role assistant)
                 | "[ROLE " name "]" body "[/ROLE]"   (any other role)

An escape puts a backslash behind the first character of a control string (``<\\/s>``);
one that has backslashes there already gets one more, so that unescaping takes away
exactly one and any text comes back.

Defined results: a null text or role is empty; turns come in the order of (turn, role,
text), a null turn first; rows that repeat are turns of their own; rows with a null
conv_id form one conversation whose id is null; an empty table gives an empty result.
Columns besides conv_id, turn, role and text are not read, whatever their names are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

BOS = "<s>"
#: A control string of the template with any number of backslashes behind its first character.
CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|ANS\]|ROLE |/ROLE\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|ANS\]|ROLE |/ROLE\])")
OPEN = {"user": "[INST]", "assistant": "[ANS]"}
CLOSE = {"user": "[/INST]", "assistant": "</s>"}
_OTHER = re.compile(r"\[ROLE ((?:[^\]\\]|\\.)*)\]", re.S)


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _segment(role: str, body: str) -> str:
    if role in OPEN:
        return OPEN[role] + body + CLOSE[role]
    name = role.replace("\\", "\\\\").replace("]", "\\]")
    return f"[ROLE {name}]{body}[/ROLE]"


def parse(rendered: str, at: int = 0) -> tuple[str, str, int]:
    """The turn that starts at ``at``: its role, its text and where it ends."""
    for role, mark in OPEN.items():
        if rendered.startswith(mark, at):
            body, close = at + len(mark), CLOSE[role]
            break
    else:
        m = _OTHER.match(rendered, at)
        if not m:
            raise GrammarError(f"no turn at {at}")
        role, body, close = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end(), "[/ROLE]"
    end = body
    while True:
        m = CONTROL.search(rendered, end)
        if not m:
            raise GrammarError("a turn without its end")
        if not m[2]:  # a control string that is not escaped: it must be this turn's end
            if m[0] != close:
                raise GrammarError(f"{m[0]!r} inside a turn")
            return role, unescape(rendered[body : m.start()]), m.end()
        end = m.end()


def parse_all(rendered: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    if not rendered.startswith(BOS):
        raise GrammarError("no start")
    at, turns = len(BOS), []
    while at < len(rendered):
        role, text, at = parse(rendered, at)
        turns.append((role, text))
    return turns


def render(role: str, text: str) -> str:
    """The segment of a turn, escaped no further than its round trip needs."""
    for body in (text, escape(text)):
        segment = _segment(role, body)
        try:
            if parse(segment) == (role, text, len(segment)):
                return segment
        except GrammarError:
            pass
    raise GrammarError("a turn does not survive its round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered ``segment`` of every row.  The
    conversation's text is BOS and its segments in order."""
    schema = "conv_id long, turn long, role string, text string, segment string"
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = utf8(b.column(2)).to_pylist(), utf8(b.column(3)).to_pylist()
            done = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(done, pa.string())],
                names=["conv_id", "turn", "role", "text", "segment"],
            )

    return rows.mapInArrow(work, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text holds when it is parsed again.

    A conversation's digest runs over its turns in order, so its segments meet in one
    task; they stream through it with the state of the hashes and one batch in memory,
    however long the conversation is.  Rendering and escaping are done before that, in
    the tasks of the input."""
    n = formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = (
        formatted.repartition(int(n), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "segment")
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        out: list[tuple] = []

        def end() -> None:
            if state is not None:
                n, turns, chars, loss, total = state
                out.append((here, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or conv != here:
                    end()
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), len(BOS)]
                role, text, stop = parse(segment)
                if stop != len(segment):
                    raise GrammarError("a segment holds more than a turn")
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
            if out:
                yield _batch(out)
                out = []
        end()
        if out:
            yield _batch(out)

    return ordered.mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
