"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it, rendered, are
the context, and its reply is the only trainable part.  Turns after the last reply, or
a conversation without one, end in an example that trains nothing, so no turn is lost.

A turn is ``<|role|>``, a newline, its text, ``<|end|>`` and a newline.  Control strings
inside roles and texts, of this template and of common others, are broken up by a
backslash, and bars replaced; a backslash is doubled, so undoing it is exact.

A conversation's turns are sorted by Spark and streamed through one task, which holds
its rendered prefix and a few megabytes of output.  The examples of one conversation
grow with the square of its turns: that is what the method asks for.

Defined cases: null texts and roles are empty; ties in ``turn`` go by role and text;
null turns come first; rows with a null conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

CONTROL = re.compile(r"\\|\||</?s>|\[/?INST\]")
ESCAPED = re.compile(r"\\(.)", re.S)
#: Repeats hold whole stretches between escapes: the matcher remembers each repeat it began.
TURN = re.compile(r"<\|([^\\|]*(?:\\.[^\\|]*)*)\|>\n([^\\|]*(?:\\.[^\\|]*)*)<\|end\|>\n", re.S)
EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def escape(text: str) -> str:
    """Without any bar or control string: ``\\`` doubled, ``|`` as ``\\p``, the others broken after their first sign."""
    return CONTROL.sub(lambda m: {"\\": "\\\\", "|": "\\p"}.get(m[0]) or f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "|" if m[1] == "p" else m[1], text)


def render(role: str, text: str) -> tuple[str, str]:
    """The head of a turn and what follows it; the closing mark is part of neither."""
    return f"<|{escape(role)}|>\n", escape(text)


CLOSE = "<|end|>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted example, unescaped."""
    turns, at = [], 0
    while m := TURN.match(formatted, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at}")
    return turns


def _expand(batches, most: int = 8 << 20):
    schema = _arrow(EXAMPLES)
    out, size = [], 0
    started, conv, prefix, n, reply = False, None, "", 0, None

    def emit(last: bool) -> int:
        """The prefix as an example: of the reply it ends in, or of no reply."""
        out.append((conv, n, prefix, *(reply or (len(prefix), len(prefix))), last))
        return len(prefix)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if started and c != conv:
                size += emit(True)
            elif reply:
                size += emit(False)
                n, reply = n + 1, None
            if not started or c != conv:
                started, conv, prefix, n, reply = True, c, "", 0, None
            head, body = render(role or "", text or "")
            start = len(prefix) + len(head)
            prefix += head + body + CLOSE
            if role == "assistant":
                reply = start, start + len(body)
            if size > most:
                yield batch_of(out)
                out.clear()
                size = 0
    if started:
        emit(True)
    if out:
        yield batch_of(out)


def expand(turns: DataFrame) -> DataFrame:
    """The examples of ``conv_id, turn, role, text``: text and the span that trains.

    One shuffle, by conversation.  Examples of a conversation are together and in order.
    """
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


def _digest(batches):
    schema = _arrow(DIGESTS)
    loss, chars, formatted, n = hashlib.sha256(), 0, 0, 0
    for batch in batches:
        out = []
        for conv, _, text, start, end, last in zip(*(c.to_pylist() for c in batch.columns)):
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            chars, formatted, n = chars + len(reply), formatted + len(text), n + 1
            if last:
                whole = parse(text)
                said = hashlib.sha256()
                for role, words in whole:
                    said.update(f"{role}\n{words}\n".encode())
                out.append((conv, len(whole), said.hexdigest(), chars, loss.hexdigest(), formatted, n))
                loss, chars, formatted, n = hashlib.sha256(), 0, 0, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_back(examples: DataFrame, clustered: bool = False) -> DataFrame:
    """One row for each conversation, parsed from its examples.

    ``clustered`` tells that examples come straight from :func:`expand`; otherwise they
    are brought together and sorted first.
    """
    rows = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last")
    if not clustered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "last", "example")
    return rows.mapInArrow(_digest, DIGESTS)
