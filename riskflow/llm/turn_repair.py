"""Repair of the turn structure of conversations by a Viterbi search whose survivors coalesce.

A well-formed conversation is ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then users and assistants in turn.
Each row can be kept (K, cost 0), given the role that is due (R, 2) or deleted (D, 3); an empty turn of the role that is due can be
inserted anywhere (I, 2). Blank rows and repeated ones have to be deleted; a truncated row that stays costs 1. The cheapest
edits win, of equally cheap ones those whose initials come first in ASCII order.

The four states (nothing yet, after a system, a user, an assistant turn) each keep one survivor. What it has done since the last common
edit is a path in a tree of back-pointers. A node dies with its last reader, and while the root has one child that edit is final and leaves
the tree, so memory holds what is unresolved and not the conversation. Survivors are never prefixes of each other between rows, so
an order of their whole strings is carried from row to row and ties are decided over the complete unresolved suffix. A survivor
that another state beats whatever follows is dropped, or an early one could keep the tree from coalescing.

A conversation is read by one task as a sorted stream, because what is returned of it is in order; memory is bounded by its
longest unresolved stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the state that the next user or assistant turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
AT_ONCE = 2048


class Edit:
    """A node of the back-pointer tree."""

    __slots__ = ("kids", "letter", "parent", "role", "row")

    def __init__(self, parent: Edit | None, letter: str, role: str, row):
        self.parent, self.letter, self.role, self.row, self.kids = parent, letter, role, row, []
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """The edits of one conversation, row by row. ``push`` and ``finish`` return edits that are final, in order."""

    def __init__(self):
        self.root = Edit(None, "", "", None)
        # by state: (cost, place among the survivors in string order, node)
        self.alive: dict[int, tuple[int, int, Edit]] = {NOTHING: (0, 0, self.root)}

    def _closed(self) -> dict[int, tuple[int, tuple, int, int]]:
        """By state: (cost, (place, inserts), survivor's state, inserts) with the insertions that pay after the last row."""
        out = {s: (c, (at, ""), s, 0) for s, (c, at, _) in self.alive.items()}
        for state in (NOTHING, SYSTEM, ASSISTANT, USER):  # to users first, then from them to assistants
            if state in out:
                cost, (at, said), source, n = out[state]
                new = (cost + INSERT, (at, said + "I"), source, n + 1)
                to = NEXT[state]
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    def push(self, initial: str, row, must_go: bool, truncated: bool) -> list[Edit]:
        best: dict[int, tuple] = {}

        def offer(to: int, cost: int, closed: tuple, letter: str, role: str) -> None:
            _, (at, said), source, n = closed
            new = (cost, (at, said + letter), source, n, letter, role)
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new

        for state, closed in self._closed().items():
            cost = closed[0]
            offer(state, cost + DELETE, closed, "D", "")
            if not must_go:
                cost += TRUNCATED * truncated
                to = NEXT[state]
                if initial == "s" and state == NOTHING:
                    offer(SYSTEM, cost + KEEP, closed, "K", "")
                elif initial == ROLE[to][0]:
                    offer(to, cost + KEEP, closed, "K", "")
                offer(to, cost + REROLE, closed, "R", ROLE[to])
        if ASSISTANT in best:
            cost, order = best[ASSISTANT][:2]
            if NOTHING in best and best[NOTHING][0] > cost + DELETE:
                del best[NOTHING]
            if SYSTEM in best and best[SYSTEM][:2] > (cost, order):
                del best[SYSTEM]
        before, inserted = self.alive, {}
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1]))}
        self.alive = {}
        for to, (cost, _, source, n, letter, role) in best.items():
            node, state = before[source][2], source
            for k in range(n):
                state = NEXT[state]
                if (source, k) not in inserted:
                    inserted[source, k] = Edit(node, "I", ROLE[state], None)
                node = inserted[source, k]
            self.alive[to] = (cost, order[to], Edit(node, letter, role, row))
        for _, _, node in before.values():
            self._drop(node)
        return self._settled()

    def _drop(self, node: Edit) -> None:
        """Remove a node that nothing reads any more, and what only it has read."""
        while not node.kids and node is not self.root and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.kids.remove(node)
            node = parent

    def _settled(self) -> list[Edit]:
        out, held = [], {id(node) for _, _, node in self.alive.values()}
        while len(self.root.kids) == 1 and id(self.root) not in held:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root)
        return out

    def finish(self) -> list[Edit]:
        closed = self._closed()
        _, _, source, n = min(closed[s] for s in (NOTHING, ASSISTANT) if s in closed)
        node, state = self.alive[source][2], source
        for _ in range(n):
            state = NEXT[state]
            node = Edit(node, "I", ROLE[state], None)
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]


def faults(text: str, repeated: Column) -> Column:
    """blank, duplicate or truncated, or null."""
    return (F.when(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), "blank").when(repeated, "duplicate")
            .when(~F.col(text).rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) of ``turns`` with one row in four damaged by its key, nulls in role and text as one space.

    A row that is dropped stays as one that isn't live, so that its conversation is still known.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: str | None = None) -> DataFrame:
    """One row per edit, by conversation and in order: (conv, turn, role, text, edit, fault, was).

    ``role`` and ``text`` are the repaired ones, or the deleted row's; ``was`` is the row's role before, null for inserted rows,
    which have no turn. Rows come by turn, nulls first, then by role and text, so ties and repeated rows have a fixed order. Null
    roles and texts are empty, and a role of another initial than s, u or a is never kept. Null conversations are one conversation.
    Where ``live`` is false a row says only that its conversation exists; one without live rows has one row with a null edit.
    No rows in, no rows out; other columns are left out.
    """
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("")).alias("_r"),
                        F.coalesce(F.col(text), F.lit("")).alias("_x"), (F.coalesce(F.col(live), F.lit(False)) if live else F.lit(True)).alias("_live"))
    again = F.row_number().over(Window.partitionBy("_c", "_live", "_r", "_x").orderBy("_t")) > 1
    flagged = rows.repartition("_c").withColumn("_f", faults("_x", again))
    flagged = flagged.sortWithinPartitions("_c", F.desc("_live"), "_t", "_r", "_x", F.col("_f").eqNullSafe("duplicate"))
    kind = T.StructType([T.StructField(conv, rows.schema["_c"].dataType), T.StructField(turn, rows.schema["_t"].dataType),
                         *[T.StructField(c, T.StringType()) for c in (role, text, "edit", "fault", "was")]])
    schema = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def put(key, edits) -> None:
            for e in edits:
                if e.row is None:
                    out.append((key, None, e.role, "", "I", None, None))
                else:
                    t, r, x, f = e.row
                    out.append((key, t, e.role or r, x, e.letter, f, r))
                    e.row = None

        at, search, any_live = None, None, False
        for batch in batches:
            for key, t, r, x, is_live, f in zip(*(c.to_pylist() for c in batch.columns)):
                if search is None or key != at:
                    if search is not None and any_live:
                        put(at, search.finish())
                    at, search, any_live = key, Repair(), False
                    if not is_live:
                        out.append((key, None, None, None, None, None, None))
                if is_live:
                    any_live = True
                    put(key, search.push(r[:1], (t, r, x, f), f in ("blank", "duplicate"), f == "truncated"))
                if len(out) >= AT_ONCE:
                    yield _batch(out, schema)
                    out = []
        if search is not None and any_live:
            put(at, search.finish())
        if out:
            yield _batch(out, schema)

    return flagged.mapInArrow(work, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def audit(edits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of what ``repair`` returns, read as a stream: counts of faults, the cost, all edits' initials, and the
    digest of the repaired rows. A conversation without rows has zeros, no edits and the digest of nothing."""
    kind = T.StructType([T.StructField(conv, edits.schema[conv].dataType),
                         *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    schema = to_arrow_schema(kind)
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT, None: 0}

    class Sum:
        def __init__(self):
            self.first = self.last = self.was = None
            self.turns = self.illegal = self.cost = self.said = 0
            self.found = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.letters, self.hash = [], hashlib.sha256()

        def add(self, t, r, x, e, f, was) -> None:
            self.cost += price[e] + (TRUNCATED if f == "truncated" and e != "D" else 0)
            self.letters.append(e or "")
            if f:
                self.found[f] += 1
            if was is not None:
                self.illegal += self.was is not None and self.was[:1] + was[:1] not in LEGAL
                self.was = was
                if t is not None:
                    self.first = t if self.first is None else self.first
                    self.turns += t != self.last
                    self.last = t
            if e is not None and e != "D":
                self.hash.update((("\n" if self.said else "") + f"{r}:{x}").encode())
                self.said = 1

        def row(self, key) -> tuple:
            gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
            return (key, gaps, *self.found.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, out = None, None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if total is None or key != at:
                    if total is not None:
                        out.append(total.row(at))
                    at, total = key, Sum()
                total.add(*row)
                if len(out) >= AT_ONCE:
                    yield _batch(out, schema)
                    out = []
        if total is not None:
            out.append(total.row(at))
        if out:
            yield _batch(out, schema)

    return edits.select(conv, turn, role, text, "edit", "fault", "was").mapInArrow(work, kind)
