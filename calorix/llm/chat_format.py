"""Chat formatting: conversations as training text with a loss mask.

A turn becomes ``[INST]role[/INST]text</s>``. In roles and texts a backslash is doubled and the
first character of each control string gets a backslash behind it, so control strings of a text
cannot be taken for marks and reading back is exact. Rows are range-partitioned by conversation
and turn, so a conversation of any length is cut over tasks; each task writes its rows into one
preallocated buffer: lengths, running offsets and scatter indices come from numpy, and headers
and contents are copied by index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.llm.text import chunks, ranges, text_bytes

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
_ESCAPED = {c: f"{c[0]}\\{c[1:]}" for c in (OPEN, MIDDLE, CLOSE)}

FORMATTED = (
    "part int, seq long, conv_id long, n_turns long, formatted string,"
    " loss_start array<long>, loss_length array<long>"
)


def escaped(column: pa.Array) -> pa.Array:
    column = pc.fill_null(column, "")
    column = pc.replace_substring(column, "\\", "\\\\")
    for control, safe in _ESCAPED.items():
        column = pc.replace_substring(column, control, safe)
    return column


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Scatter every text of ``data`` to its place in ``out``."""
    out[ranges(to, np.diff(offsets))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, the offsets of the turns and the start of each text in it."""
    role, role_at = text_bytes(roles)
    text, text_at = text_bytes(texts)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (OPEN, MIDDLE, CLOSE)]
    sizes = n_role + n_text + sum(map(len, marks))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint8)
    place = at[:-1]
    content = place
    for mark, data, offsets in zip(
        marks, (role, text, None), (role_at, text_at, None), strict=True
    ):
        out[(place[:, None] + np.arange(len(mark))).ravel()] = np.tile(mark, len(place))
        place = place + len(mark)
        if data is not None:
            content = place
            _copy(out, place, data, offsets)
            place = place + np.diff(offsets)
    return out, at, content


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """Formatted pieces of every conversation.

    ``part, seq`` order the pieces of the table; the pieces of a conversation, put one after the
    other in that order, are its text. ``loss_start`` and ``loss_length`` give the bytes of each
    text of ``learn_role`` within the piece. Turns are ordered by number, null first; rows of the
    same conversation and turn by a hash of role and text, so the result does not depend on the
    order of the input. Null texts and roles are empty; null conversation ids are one conversation.
    """
    keys = ["conv_id", "turn", "tie"]
    placed = (
        turns.select(
            F.col(conv_col).cast("long").alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.xxhash64(role_col, text_col).alias("tie"),
            F.col(role_col).cast("string").alias("role"),
            F.col(text_col).cast("string").alias("text"),
        )
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for lo, hi in chunks(offsets):
                rows = batch.slice(lo, hi - lo)
                out = _formatted(rows, learn_role, part, seq)
                seq += out.num_rows
                yield out

    return placed.mapInArrow(run, FORMATTED)


def _formatted(rows: pa.RecordBatch, learn_role: str, part: int, seq: int) -> pa.RecordBatch:
    conv, roles = rows.column(0), rows.column(1)
    texts = escaped(rows.column(2))
    out, at, content = assemble(escaped(roles), texts)
    ids = conv.to_numpy(zero_copy_only=False) if not conv.null_count else None
    if ids is None:
        known = conv.is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(known, pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), 0)
        new = (np.diff(ids) != 0) | (known[1:] != known[:-1])
    else:
        new = np.diff(ids) != 0
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    last = np.append(first[1:], len(rows))
    learn = pc.fill_null(pc.equal(roles, learn_role), False).to_numpy(zero_copy_only=False)
    learned = np.flatnonzero(learn)
    size = at[1:] - len(CLOSE) - content
    piece = np.searchsorted(first, learned, "right") - 1
    list_at = np.searchsorted(learned, np.append(first, len(rows)))
    lists = [
        pa.ListArray.from_arrays(pa.array(list_at, pa.int32()), pa.array(v, pa.int64()))
        for v in (content[learned] - at[first][piece], size[learned])
    ]
    text = pa.LargeStringArray.from_buffers(
        len(first),
        pa.py_buffer(np.append(at[first], at[-1]).astype(np.int64)),
        pa.py_buffer(out),
    )
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, part), pa.int32()),
            pa.array(np.arange(seq, seq + n), pa.int64()),
            conv.take(pa.array(first)),
            pa.array(last - first, pa.int64()),
            text.cast(pa.string()),
            *lists,
        ],
        names=["part", "seq", "conv_id", "n_turns", "formatted", "loss_start", "loss_length"],
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(MIDDLE)
        turns.append((unescaped(role), unescaped(text)))
    return turns


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def digests(pieces: DataFrame) -> DataFrame:
    """Digest of every conversation, read back from its pieces, which are streamed in order."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            columns = (batch.column(name) for name in ("conv_id", "formatted", "loss_start", "loss_length"))
            for conv, formatted, starts, lengths in zip(*columns, strict=True):
                conv, formatted = conv.as_py(), formatted.as_py()
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                raw = formatted.encode()
                for start, length in zip(starts.as_py(), lengths.as_py(), strict=True):
                    text = unescaped(raw[start : start + length].decode())
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(formatted)
            yield _digest_batch(done)
        yield _digest_batch([now] if now else [])

    return ordered.mapInArrow(run, DIGEST)


def _digest_batch(done: list[list]) -> pa.RecordBatch:
    rows = [[d[0], d[1], d[2].hexdigest(), d[3], d[4].hexdigest(), d[5]] for d in done]
    fields = [f.split() for f in DIGEST.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


@query("op1_chat_format")
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every formatted conversation, and of one made of control strings."""
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", told), (-7, 1, "assistant", told)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(extra)))
