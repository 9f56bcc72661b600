r"""Chat formatting with a grammar round trip.

Grammar of the output, one conversation after its turns:

    conversation = turn*
    turn         = "<|im_start|>" role "\n" body "<|im_end|>\n"

The parser is deterministic: a role ends at the first line feed, a body at the
first "<|im_end|>". Content conflicts if it holds a control string, or one that
an escape would make: "<", any number of backslashes, then "|im_start|>" or
"|im_end|>". Escaping adds one backslash after that "<" and parsing takes one
away; in a role, backslashes and line feeds are escaped too. Every rendered turn
is parsed again and compared with its source: a turn that comes back unchanged
stays as it is, any other is escaped and parsed anew until it does.

Turns are rendered one by one in any task. Only a conversation's digests need
its turns in order; rows are sorted by Spark and pass through the task as a
stream, so that a conversation of any length takes the memory of one batch.

Defined cases: null text and null role count as empty; rows of equal turn
follow each other by role and text, a null turn comes first; a null conv_id is
a conversation of its own; no conversations, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLES = ("assistant",)
MAX_TRIES = 3

_CONFLICT = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")


def escape(text: str) -> str:
    return _CONFLICT.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, body, start and end of the raw body) of every turn, or None if the grammar doesn't hold."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        if not text.startswith(START, at) or line < 0:
            return None
        end = text.find(END, line + 1)
        if end < 0 or not text.startswith("\n", end + len(END)):
            return None
        body = text[line + 1 : end]
        role = text[at + len(START) : line]
        if START in body or START in role or END in role:
            return None
        turns.append((unescape_role(role), unescape(body), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(a turn that parses back to (role, text), start and end of its body)."""
    shown_role, body = role, text
    for _ in range(MAX_TRIES):
        turn = f"{START}{shown_role}\n{body}{END}\n"
        back = parse(turn)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return turn, back[0][2], back[0][3]
        if back is None or len(back) != 1 or back[0][0] != role:
            shown_role = escape_role(role)
        if back is None or len(back) != 1 or back[0][1] != text:
            body = escape(text)
    raise AssertionError("an escaped turn must parse back")


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null as empty), formatted, body_start and body_end (code points in formatted), in_loss."""
    schema = "conv_id long, turn long, role string, text string, formatted string, body_start int, body_end int, in_loss boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch[c].to_pylist()] for c in ("role", "text"))
            made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            cells = list(zip(*made, strict=True)) if made else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(cells[0], pa.string()), pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.int32()), pa.array([r in TRAINED_ROLES for r in roles])],
                names=["conv_id", "turn", "role", "text", "formatted", "body_start", "body_end", "in_loss"],
            )

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted`` and the loss mask alone: counts and SHA-256 digests."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def flush() -> None:
            if state:
                n, turns_digest, loss, loss_digest, chars = state
                done.append((current, n, turns_digest.hexdigest(), loss, loss_digest.hexdigest(), chars))

        for batch in batches:
            for conv, formatted, start, end, in_loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "body_start", "body_end", "in_loss")), strict=True):
                if state is None or conv != current:
                    flush()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, *_ in parse(formatted) or ():
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    loss = unescape(formatted[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=arrow)
                done.clear()
        flush()
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=arrow)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "body_start", "body_end", "in_loss").mapInArrow(run, schema)
