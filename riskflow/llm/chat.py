"""Chat formatting by columnar byte assembly, and reading it back.

Turns are dealt out by conversation and sorted, so a task sees each of its conversations as a run of rows. A batch of turns is
assembled at once: lengths of opening marks, texts and closing marks, cumulative offsets, and from them the indices by which
numpy copies all marks and all texts into one preallocated buffer, which becomes the Arrow column of formatted conversations.

Template: ``<<SYS>>\\n text \\n<</SYS>>\\n``, ``[INST] text [/INST]``, ``(space)text </s>`` for system, user and assistant turns, and
``<s>role<s>text </s>`` for any other role. Inside texts and roles a backslash is doubled and one is put after the first character of
each control string, so no control string is left and the change can be undone. The loss mask is a list of byte spans of the
assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OPEN = {"system": b"<<SYS>>\n", "user": b"[INST] ", "assistant": b" "}
CLOSE = {"system": b"\n<</SYS>>\n", "user": b" [/INST]", "assistant": b" </s>"}
#: What may not occur inside a text, as (first character, rest).
CONTROL = r"(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])"
AT_ONCE = 1 << 28  # bytes of text that are assembled together, unless one conversation has more


def escape(texts: pa.Array) -> pa.Array:
    doubled = pc.replace_substring_regex(texts, r"\\", r"\\\\")
    return pc.replace_substring_regex(doubled, CONTROL, r"\1\3\\\2\4")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def _scatter(out: np.ndarray, to: np.ndarray, pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ``length[i]`` bytes of ``pool`` from ``start[i]`` to ``to[i]`` of ``out``, for all i at once."""
    before = np.cumsum(length) - length
    step = np.arange(int(length.sum()))
    out[np.repeat(to - before, length) + step] = pool[np.repeat(start - before, length) + step]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns as one buffer, where each begins in it (and the end), and where each text begins and ends."""
    roles = roles.fill_null("")
    content, content_at = _buffer(escape(texts.fill_null("")))
    names = roles.dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = escape(names.dictionary).to_pylist()
    plain = names.dictionary.to_pylist()
    heads = [OPEN.get(r, b"<s>" + s.encode() + b"<s>") for r, s in zip(plain, said)]
    tails = [CLOSE.get(r, b" </s>") for r in plain]
    size = lambda parts: np.array([len(p) for p in parts], np.int64)
    pool = np.frombuffer(b"".join(heads + tails), np.uint8)
    place = np.concatenate([[0], np.cumsum(size(heads + tails))])
    head, tail, body = size(heads)[code], size(tails)[code], np.diff(content_at)
    ends = np.cumsum(head + body + tail)
    begins = ends - (head + body + tail)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, begins, pool, place[code], head)
    _scatter(out, begins + head, content, content_at[:-1], body)
    _scatter(out, begins + head + body, pool, place[len(heads) + code], tail)
    return out, np.append(begins, len(out)), begins + head, begins + head + body


def _runs(part: pa.Table) -> np.ndarray:
    """Where conversations begin in turns sorted by conversation."""
    keys = part.column("_conv").combine_chunks()
    if len(keys) < 2:
        return np.zeros(min(1, len(keys)), np.int64)
    a, b = keys[1:], keys[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False))])


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         learn: str = "assistant") -> DataFrame:
    """One row per conversation: (key, formatted, loss_spans = byte spans of the texts of role ``learn``).

    Turns are in the order of ``turn``; those that repeat a number by role, then text, nulls first, and all are kept. Null texts and roles
    are empty, a null key is a conversation like any other. A conversation is one row of output and has to fit in memory, as
    any row; a batch of turns beyond it is all that a task holds.
    """
    rows = turns.select(F.col(key).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    ddl = T.StructType([T.StructField("_conv", rows.schema["_conv"].dataType), T.StructField("formatted", T.StringType()),
                        T.StructField("loss_spans", spans)])
    schema = to_arrow_schema(ddl)

    def made(part: pa.Table) -> pa.RecordBatch:
        first = _runs(part)
        role_col, text_col = (part.column(c).combine_chunks().cast(pa.string()) for c in ("_role", "_text"))
        data, begins, start, end = assemble(role_col, text_col)
        at = np.append(begins[first], len(data))
        formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data))
        learned = pc.fill_null(pc.equal(role_col, learn), False).to_numpy(zero_copy_only=False)
        conv = np.cumsum(np.bincount(first, minlength=part.num_rows)) - 1
        base = at[:-1][conv]
        counts = np.concatenate([[0], np.cumsum(np.bincount(conv[learned], minlength=len(first)))])
        pairs = pa.StructArray.from_arrays([pa.array((x - base)[learned], pa.int64()) for x in (start, end)], names=["start", "end"])
        return pa.RecordBatch.from_arrays([part.column("_conv").combine_chunks().take(pa.array(first)), formatted,
                                           pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs).cast(schema.field(2).type)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                own = pa.Table.from_batches([part])
                held = own if held is None else pa.concat_tables([held, own])
                cut = int(_runs(held)[-1])  # the last conversation may go on in the next batch
                if cut and held.nbytes >= AT_ONCE // 16:
                    yield made(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield made(held)

    ordered = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return ordered.mapInArrow(work, ddl).withColumnRenamed("_conv", key)


TURN = re.compile(rb"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<role>.*?)<s>(?P<other>.*?) </s>| (?P<assistant>.*?) </s>", re.S)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns (role, text) of a formatted conversation; an error if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m["role"]), unescape(m["other"])) if m["role"] is not None else (m.lastgroup.encode(), unescape(m[m.lastgroup])))
        at = m.end()
    return out


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations."""
    rows = formatted.select(F.col(key).alias("_conv"), F.col("formatted").cast("binary").alias("formatted"), "loss_spans")
    ddl = T.StructType([T.StructField("_conv", rows.schema["_conv"].dataType), T.StructField("n_turns", T.LongType()),
                        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    schema = to_arrow_schema(ddl)

    def work(batches):
        for batch in batches:
            out = []
            for data, spans in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                turns = parse(data)
                learned = b"".join(unescape(data[s["start"] : s["end"]]) for s in spans.as_py())
                out.append((len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(),
                            len(learned.decode()), hashlib.sha256(learned).hexdigest(), len(data.decode())))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[k] for r in out], schema.field(k + 1).type) for k in range(5)], schema=schema)

    return rows.mapInArrow(work, ddl).withColumnRenamed("_conv", key)
