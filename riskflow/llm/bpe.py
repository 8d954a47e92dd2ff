"""Byte-pair encoding and decoding, with long texts encoded in parallel by tree concatenation.

A text of up to ``leaf`` bytes is encoded where it is. A longer one is halved until its pieces are that short; the pieces are
spread over the cluster and encoded on their own; then neighbours are joined pair by pair. At a join the last tokens of the left
side and the first of the right side are encoded again as one window, which doubles until it agrees with both sides: until it
has, on either side, a token with the same span as that side (or has reached the side's end).

That is exact. Text is first split by a pattern whose matches depend only on what follows a match's start, and are runs of
one class of characters; byte-pair encoding within a run is characterised by its adjacent pairs: a sequence of tokens is the
encoding of its bytes if each pair of neighbours is the encoding of theirs. A token that window and side share continues the
same run, and every pair of neighbours in the joined sequence stands in the window or in a side.

Ids travel as packed little-endian 32-bit integers (``ids``), the form in which training shards hold them.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskflow.llm.common import fresh

LEAF = 1 << 15
WINDOW = 16  # tokens on each side of a join, to begin with
BATCH = 1 << 20  # bytes of text that are encoded before a batch goes back

#: Fixed value: the pattern by which byte-level vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """A byte-level vocabulary file: ``encode`` and ``decode`` as its own library does, without special tokens added."""

    ranks: dict[bytes, int]
    special: dict[str, int]

    def __post_init__(self):
        import tiktoken

        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.length[i] = len(b)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.coder.encode(text, allowed_special="all")
        return self.coder.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode_bytes(ids).decode("utf-8", "replace")

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """The text between special tokens, and those, as (is special, text)."""
        out, at = [], 0
        while self.special:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                break
            i, _, s = min(found)
            out += [(False, text[at:i])] * (i > at) + [(True, s)]
            at = i + len(s)
        return out + [(False, text[at:])] * (at < len(text))

    def _aligned(self, ids: np.ndarray, n: int, last: bool) -> int:
        """At least ``n`` tokens at the end (``last``) or start of ``ids``, so many that no character is cut."""
        inside = lambda i: i in self.bytes_of and (self.bytes_of[i][0] & 0xC0) == 0x80
        while n < len(ids) and inside(int(ids[len(ids) - n] if last else ids[n])):
            n += 1
        return min(n, len(ids))

    def join(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """The encoding of two neighbouring pieces of one segment from theirs."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = self._aligned(left, window, True), self._aligned(right, window, False)
            near, far = left[len(left) - a :], right[:b]
            middle = np.array(self.coder.encode_ordinary(self.coder.decode_bytes([*near.tolist(), *far.tolist()]).decode()), np.uint32)
            ends = np.cumsum(self.length[middle])
            own = np.cumsum(self.length[near])
            split = own[-1]
            own_right = split + np.cumsum(self.length[far])
            spans = {(int(e - n), int(e)): k for k, (e, n) in enumerate(zip(ends, self.length[middle]))}
            first = (0, 0) if a == len(left) else next(
                ((k, spans[s]) for k in range(a - 1, -1, -1) if (s := (int(own[k] - self.length[near[k]]), int(own[k]))) in spans), None)
            last = (b, len(middle)) if b == len(right) else next(
                ((k, spans[s]) for k in range(b) if (s := (int(own_right[k] - self.length[far[k]]), int(own_right[k]))) in spans), None)
            if first is not None and last is not None and first[1] <= last[1]:
                return np.concatenate([left[: len(left) - a + first[0]], middle[first[1] : last[1]], right[last[0] :]])
            window *= 2

    def concatenate(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Pieces of one segment, joined as a tree of neighbours."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else np.empty(0, np.uint32)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a vocabulary file; it has to be byte-level, with ids in the order of its merges, as ``encode`` relies on that."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre, byte = data["model"], data["pre_tokenizer"], _byte_of_char()
    added = data["added_tokens"]
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in {x["content"] for x in added}}
    merged = [ranks.get(bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
    if (model["type"] != "BPE" or data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
            or merged != list(range(256, 256 + len(merged))) or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    return Vocabulary(ranks, {x["content"]: x["id"] for x in added})


def halves(data: bytes, leaf: int) -> list[bytes]:
    """``data`` halved, between characters, until no piece is longer than ``leaf``."""
    if len(data) <= max(leaf, 8):
        return [data]
    cut = len(data) // 2
    while (data[cut] & 0xC0) == 0x80:
        cut += 1
    return halves(data[:cut], leaf) + halves(data[cut:], leaf)


def pack(ids) -> bytes:
    return array("I", ids).tobytes() if isinstance(ids, list) else np.asarray(ids, "<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def _batches(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows made from each (first columns..., last column), sent on whenever the last columns amount to ``BATCH`` bytes."""
    for batch in batches:
        rest, data = batch.columns[:-1], batch.columns[-1]
        at, held, rows = 0, 0, []
        for i, x in enumerate(data):
            x = x.as_py()
            rows.append(make(x))
            held += len(x or b"")
            if held >= BATCH or i + 1 == len(data):
                own = [pa.array([r[k] for r in rows], schema.field(len(rest) + k).type) for k in range(len(rows[0]))]
                yield pa.RecordBatch.from_arrays([c.slice(at, i + 1 - at) for c in rest] + own, schema=schema)
                at, held, rows = i + 1, 0, []


def _worker() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task


def _run(rows: DataFrame, path: str, keep: list[str], last: str, make, fields: list[tuple[str, str]]) -> DataFrame:
    """``keep`` columns of ``rows`` and what ``make(vocabulary, value of last)`` returns, batch by batch."""
    kinds = {"binary": pa.binary(), "string": pa.string()}
    base = rows.select(*keep, last)
    schema = to_arrow_schema(base.select(*keep).schema)
    for name, kind in fields:
        schema = schema.append(pa.field(name, kinds[kind]))

    def work(batches):
        _worker()
        vocabulary = load(path)
        return _batches(batches, lambda x: make(vocabulary, x), schema)

    ddl = base.select(*keep).schema
    for name, kind in fields:
        ddl = ddl.add(name, kind)
    return base.mapInArrow(work, ddl)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, decoded: bool = True) -> DataFrame:
    """One row per row of ``docs``: (key, ids) and, on request, ``decoded``, the text that the ids stand for.

    Null and empty texts have no ids; bytes that aren't UTF-8 count as replacement characters; strings of the file's special
    tokens become those. Rows that repeat key and text are kept, each with its ids. No rows in, no rows out.
    """
    fields = [("ids", "binary")] + [("decoded", "string")] * decoded

    def finish(v: Vocabulary, ids) -> tuple:
        return (pack(ids), v.decode(ids if isinstance(ids, list) else ids.tolist())) if decoded else (pack(ids),)

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    short = rows.filter(F.octet_length("_data") <= leaf)
    out = _run(short, path, ["_key"], "_data", lambda v, x: finish(v, v.encode(_text(x))), fields)

    long = rows.filter(F.octet_length("_data") > leaf).withColumn("_hash", F.sha2("_data", 256))
    ddl = long.select("_key", "_hash").schema.add("_piece", "integer").add("_segment", "integer").add("_special", "boolean").add("_part", "binary")

    def cut(batches):
        schema, v = to_arrow_schema(ddl), load(path)
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [(n, special, part) for n, (special, s) in enumerate(v.segments(_text(batch["_data"][row].as_py())))
                         for part in ([s.encode()] if special else halves(s.encode(), leaf))]
                same = [batch[c].slice(row, 1).take(pa.array([0] * len(parts))) for c in ("_key", "_hash")]
                yield pa.RecordBatch.from_arrays(same + [
                    pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.int32()),
                    pa.array([p[1] for p in parts], pa.bool_()), pa.array([p[2] for p in parts], pa.binary())], schema=schema)

    pieces = long.select("_key", "_hash", "_data").mapInArrow(cut, ddl).repartition("_key", "_hash", "_piece")
    coded = _run(pieces, path, ["_key", "_hash", "_piece", "_segment", "_special"], "_part",
                 lambda v, x: (pack(v.encode(_text(x))),), [("_ids", "binary")])
    joined = coded.select("_key").schema
    for name, kind in fields:
        joined = joined.add(name, kind)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        _worker()
        v, times = load(path), int((group["_piece"] == 0).sum())
        one = group.drop_duplicates("_piece").sort_values("_piece")
        parts = [v.concatenate([np.frombuffer(x, "<u4") for x in ids]) for _, ids in one.groupby("_segment", sort=True)["_ids"]]
        values = finish(v, np.concatenate(parts))
        return pd.DataFrame({"_key": group["_key"].iloc[[0] * times].array} | {name: [x] * times for (name, _), x in zip(fields, values)})

    out = out.unionByName(coded.groupBy("_key", "_hash").applyInPandas(merge, joined))
    return out.withColumnRenamed("_key", key)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, ids) per row of ``docs``; see ``round_trip``."""
    return round_trip(docs, path, key, text, leaf, decoded=False)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the text of its packed ids; a null has a null text. An id that the file lacks is an error."""
    if out.lower() in {c.lower() for c in coded.columns}:
        raise ValueError(f"there is a column {out} already")
    data, = fresh(coded, "_packed")
    rows = coded.withColumn(data, F.col(ids))
    return _run(rows, path, coded.columns, data, lambda v, x: (None if x is None else v.decode(unpack(x)),), [(out, "string")])


def token_count(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
