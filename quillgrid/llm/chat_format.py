r"""Chat formatting by columnar byte assembly, and reading it back.

A turn becomes `<|start|>role<|message|>text<|end|>` and a line feed. Inside roles and texts, every control string of this
and of other common templates gets a backslash after its first sign (one more, where there are some), so no text can open
or close a turn, and reading removes exactly that one. For a batch of turns the lengths of all segments are computed,
their running sum gives each segment's place, and numpy scatters headers and contents into one buffer, which Arrow takes as it is.
The loss mask covers the text of assistant turns.

Turns of a conversation are ordered by turn, role and text (nulls first). Defined results: a null text or role is empty; a null id is
one conversation; repeated rows are repeated turns; texts of any length are whole, and turns that tie in all three go in any order, as they are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.store import table, texts_of

START, MESSAGE, END = b"<|start|>", b"<|message|>", b"<|end|>\n"
TAIL = r"(?=\||/?s>|</?SYS>>|/?INST\])"
ESCAPE, UNESCAPE = re.compile(r"([<\[])(\\*)" + TAIL), re.compile(r"([<\[])\\(\\*)" + TAIL)
LOSS_ROLE = "assistant"

FORMATTED = "conv_id long, formatted string, loss array<struct<begin:long,end:long>>"
FORMATTED_ARROW = {"conv_id": pa.int64(), "formatted": pa.string(), "loss": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))}


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: m[1] + m[2] + "\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1] + m[2], text)


def escaped(column: pa.Array) -> pa.Array:
    """Strings with control strings escaped; only those that may hold one pass through Python."""
    column = pc.fill_null(column.cast(pa.string()), "")
    suspect = pc.match_substring_regex(column, r"[<\[]\\*(\||/?s>|</?SYS>>|/?INST\])").to_numpy(zero_copy_only=False)
    if not suspect.any():
        return column
    values = column.to_pylist()
    for i in np.flatnonzero(suspect):
        values[i] = escape(values[i])
    return pa.array(values, pa.string())


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all turns in it, and the begins of each turn's five segments and the end."""
    parts = [START, escaped(roles), MESSAGE, escaped(texts), END]
    n = len(roles)
    lens = np.zeros((n, 5), np.int64)
    views = []
    for j, p in enumerate(parts):
        if isinstance(p, bytes):
            lens[:, j] = len(p)
            views.append(None)
        else:
            raw, offsets, _ = texts_of(p)
            lens[:, j] = np.diff(offsets)
            views.append((raw, offsets))
    at = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lens.ravel(), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    begin = at[:-1].reshape(n, 5)
    for j, p in enumerate(parts):
        if views[j] is None:
            out[begin[:, j][:, None] + np.arange(len(p))] = np.frombuffer(p, np.uint8)
        else:
            raw, offsets = views[j]
            out[np.arange(len(raw)) + np.repeat(begin[:, j] - offsets[:-1], lens[:, j])] = raw
    return out, np.append(begin.ravel(), at[-1])


def format_batch(conv: list, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole conversations, their rows one after another."""
    out, at = assemble(roles, texts)
    first = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
    offsets = at[np.array([i * 5 for i in first] + [len(conv) * 5])]
    loss = np.asarray(pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False), bool)
    bound = [*first, len(conv)]
    spans = [[{"begin": int(at[5 * i + 3] - offsets[k]), "end": int(at[5 * i + 4] - offsets[k])} for i in range(bound[k], bound[k + 1]) if loss[i]] for k in range(len(first))]
    made = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out))
    return table(FORMATTED_ARROW, [[conv[i] for i in first], made.cast(pa.string()), spans])


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, formatted, and the loss mask as spans of bytes in formatted."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            one = lambda name: pa.concat_arrays(whole[name].chunks)
            return format_batch(whole["conv_id"].to_pylist(), one("role"), one("text"))

        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                conv = part.column("conv_id").to_pylist()
                # the last conversation may go on in what comes next
                last = len(conv)
                while last and conv[last - 1] == conv[-1]:
                    last -= 1
                if last or held and held[-1].column("conv_id")[-1].as_py() != conv[0]:
                    if held and last == 0:
                        yield flush()
                        held = [part]
                        continue
                    held.append(part.slice(0, last))
                    yield flush()
                    held = [part.slice(last)]
                else:
                    held.append(part)
        if held:
            yield flush()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn.removeprefix(START.decode()).partition(MESSAGE.decode())
        out.append((unescape(role), unescape(text)))
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns, whole = read_turns(text), text.encode()
                learned = "".join(unescape(whole[s["begin"] : s["end"]].decode()) for s in loss)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield table(DIGEST_ARROW, list(zip(*rows, strict=True)) if rows else [[]] * 6)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST)
