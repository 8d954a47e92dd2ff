"""Hidden states behind each entity's sequence: a model from labelled sequences, and the most likely path.

Scores are whole numbers (millionths of natural logarithms), so sums do not depend on their order and ties are real ones: of equally likely paths
the one with the least last state wins, then the least state before it, and so on back.

Ordinary entities are read as a sorted stream, many at a time. A hot entity's rows lie in several segments. What a segment does to the scores is a
matrix in which plus takes the place of times and the maximum that of the sum; such matrices compose, so segments are worked through in parallel three times:
once for their matrices, once, the scores at their beginning being known, for the state that each last state began from,
and once, the last state being known, for the path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators import ordered as od
from riskflow.session import cut

UNIT, NEVER = 1_000_000, -(1 << 60)
MOST = 1000  # different states, or observations, that a model may have


@dataclass
class PathModel:
    states: list
    observations: list
    start: np.ndarray  # by state
    move: np.ndarray  # by state before and after
    emit: np.ndarray  # by observation and state; the last row is for observations that were never seen

    def step(self, seen: np.ndarray) -> np.ndarray:
        """Score matrices of rows from what was observed."""
        return self.move[None, :, :] + self.emit[seen][:, None, :]


def _units(counts: np.ndarray) -> np.ndarray:
    """Scores of shares with one added to each count, along the last axis."""
    total = counts.sum(axis=-1, keepdims=True) + counts.shape[-1]
    return np.vectorize(lambda a, b: math.floor(UNIT * math.log(a / b)), otypes=[np.int64])(counts + 1, np.broadcast_to(total, counts.shape))


def fit_path(df: DataFrame, key: str, order: Sequence[str], state: str, observed: str) -> PathModel:
    """First states, moves between consecutive states and observations in each, counted over all rows; rows with a null state count nowhere
    and don't part their neighbours. Only counts by state and observation leave the aggregation."""
    order = list(order)
    rows = df.filter(F.col(state).isNotNull()).select(key, *order, F.col(state).cast("string").alias("_s"), F.col(observed).cast("string").alias("_o"))
    lagged = od.shifted(rows, [key], order, {"_before": ("_s", 1)})
    moves = lagged.groupBy("_before", "_s").agg(F.count(F.lit(1)).alias("n")).limit(MOST * MOST).collect()
    seen = rows.filter(F.col("_o").isNotNull()).groupBy("_o", "_s").agg(F.count(F.lit(1)).alias("n")).limit(MOST * MOST).collect()
    states, observations = sorted({r["_s"] for r in moves}), sorted({r["_o"] for r in seen})
    if not states or max(len(states), len(observations)) >= MOST:
        raise ValueError(f"the model needs 1 to {MOST - 1} states and observations")
    at, spot = {s: i for i, s in enumerate(states)}, {o: i for i, o in enumerate(observations)}
    start, move, emit = np.zeros(len(states), np.int64), np.zeros((len(states),) * 2, np.int64), np.zeros((len(observations) + 1, len(states)), np.int64)
    for r in moves:
        if r["_before"] is None:
            start[at[r["_s"]]] = r["n"]
        else:
            move[at[r["_before"]], at[r["_s"]]] = r["n"]
    for r in seen:
        emit[spot[r["_o"]], at[r["_s"]]] = r["n"]
    return PathModel(states, observations, _units(start), _units(move), _units(emit.T).T)


def _forward(model: PathModel, seen: np.ndarray, begin: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores after the last row, and for each row the best state before, by state; the first row of an entity has none before it."""
    back = np.zeros((len(seen), len(model.states)), np.int32)
    score = begin
    for i, o in enumerate(seen):
        if first and i == 0:
            score = model.start + model.emit[o]
        else:
            through = score[:, None] + model.move
            back[i] = through.argmax(axis=0)
            score = through[back[i], np.arange(len(score))] + model.emit[o]
    return score, back


def _backward(back: np.ndarray, last: int) -> np.ndarray:
    out = np.empty(len(back), np.int32)
    for i in range(len(back) - 1, -1, -1):
        out[i] = last
        last = back[i, last]
    return out


def _many(model: PathModel, seen: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Paths of whole entities of any lengths at once: ``begins`` has where each begins in ``seen``."""
    lengths = np.diff(np.append(begins, len(seen)))
    by_length = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[by_length], lengths[by_length]
    back = np.zeros((len(seen), len(model.states)), np.int32)
    score = model.start + model.emit[seen[begins]]
    for i in range(1, lengths[0] if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i))  # those longer than i
        through = score[:n, :, None] + model.move
        best = through.argmax(axis=1)
        back[begins[:n] + i] = best
        score[:n] = np.take_along_axis(through, best[:, None, :], axis=1)[:, 0] + model.emit[seen[begins[:n] + i]]
    state, out = score.argmax(axis=1), np.empty(len(seen), np.int32)
    for i in range((lengths[0] if len(lengths) else 0) - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -i))
        out[begins[:n] + i] = state[:n]
        state[:n] = back[begins[:n] + i, state[:n]]
    return out


def likely_path(df: DataFrame, model: PathModel, key: str, order: Sequence[str], observed: str, ident: str, name: str = "path_state") -> DataFrame:
    """(ident, name): the state of each row on its entity's most likely path. ``order`` has no nulls and should leave no ties. Observations
    that the model has not seen, nulls too, have the score of one that was never seen in the state. Rows with a null key are one entity."""
    order = list(order)
    hot = od.find_hot(df, [key])
    codes = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(model.observations)], "_o string, _code int")
    coded = df.select(key, *[F.col(c) for c in order if c != ident], F.col(ident), F.col(observed).cast("string").alias("_o")).join(F.broadcast(codes), "_o", "left")
    coded = coded.select(F.col(key), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_k"), *[c for c in order if c != ident], ident,
                         F.coalesce("_code", F.lit(len(model.observations))).alias("_code"))
    parts = od.segment(coded, hot, order[0])
    kind = T.StructType([df.schema[ident], T.StructField(name, T.StringType())])
    states = np.array(model.states, dtype=object)

    def decoded(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({ident: part[ident], name: states[_many(model, part["_code"].to_numpy(), begins)]})

    def whole(batches):
        """Entities one after the other; what a batch cuts off waits for the next one."""
        held = None
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            k = part["_k"].to_numpy()
            begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
            if len(begins) > 1:
                yield decoded(part.iloc[: begins[-1]], begins[:-1])
            held = part.iloc[begins[-1] :].reset_index(drop=True) if len(begins) else None
        if held is not None and len(held):
            yield decoded(held, np.zeros(1, np.int64))

    plain = (od._without(parts, hot) if hot else parts).repartition("_k").sortWithinPartitions("_k", *order).select("_k", ident, "_code").mapInPandas(whole, kind)
    return plain.unionByName(_hot_paths(cut(od._only(parts, hot).drop(key)), model, order, kind, ident, name)) if hot else plain


def _hot_paths(parts: DataFrame, model: PathModel, order: list[str], kind: T.StructType, ident: str, name: str) -> DataFrame:
    n = len(model.states)
    identity = np.where(np.eye(n, dtype=bool), 0, NEVER).astype(np.int64)
    firsts = parts.groupBy("_k").agg(F.min("_seg").alias("_first"))
    rows = parts.join(F.broadcast(firsts), "_k")

    def matrix(part: pd.DataFrame) -> pd.DataFrame:
        seen = part.sort_values(order)["_code"].to_numpy()
        total, first = identity, part["_seg"].iloc[0] == part["_first"].iloc[0]
        if first:
            total, seen = np.broadcast_to(model.start + model.emit[seen[0]], (n, n)), seen[1:]
        for o in seen:
            total = (total[:, :, None] + model.move[None]).max(axis=1) + model.emit[o]
        return pd.DataFrame({"_k": part["_k"].iloc[:1], "_seg": part["_seg"].iloc[:1], "_m": [total.ravel().tolist()]})

    table = rows.groupBy("_k", "_seg").applyInPandas(matrix, "_k string, _seg int, _m array<bigint>")

    def forward(part: pd.DataFrame) -> pd.DataFrame:
        part, score, out = part.sort_values("_seg"), np.zeros(n, np.int64), []
        for m in part["_m"]:
            out.append(score.tolist())
            score = (score[:, None] + np.array(m, np.int64).reshape(n, n)).max(axis=0)
        return pd.DataFrame({"_k": part["_k"], "_seg": part["_seg"], "_begin": out, "_last": int(score.argmax())})

    begun = cut(table.groupBy("_k").applyInPandas(forward, "_k string, _seg int, _begin array<bigint>, _last int"))  # a row per segment

    def run(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        part = part.sort_values(order)
        first = part["_seg"].iloc[0] == part["_first"].iloc[0]
        return part, _forward(model, part["_code"].to_numpy(), np.array(part["_begin"].iloc[0], np.int64), first)[1]

    def entry(part: pd.DataFrame) -> pd.DataFrame:
        part, back = run(part)
        came = [int(back[0, _backward(back, s)[0]]) for s in range(n)]
        return pd.DataFrame({"_k": part["_k"].iloc[:1], "_seg": part["_seg"].iloc[:1], "_came": [came], "_last": part["_last"].iloc[:1]})

    given = rows.join(F.broadcast(begun), ["_k", "_seg"])
    came = given.groupBy("_k", "_seg").applyInPandas(entry, "_k string, _seg int, _came array<int>, _last int")

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_seg", ascending=False)
        state, out = int(part["_last"].iloc[0]), []
        for c in part["_came"]:
            out.append(state)
            state = int(c[state])
        return pd.DataFrame({"_k": part["_k"], "_seg": part["_seg"], "_end": out})

    ended = cut(came.groupBy("_k").applyInPandas(ends, "_k string, _seg int, _end int"))
    names = np.array(model.states, dtype=object)

    def path(part: pd.DataFrame) -> pd.DataFrame:
        part, back = run(part)
        return pd.DataFrame({ident: part[ident], name: names[_backward(back, int(part["_end"].iloc[0]))]})

    return given.join(F.broadcast(ended), ["_k", "_seg"]).groupBy("_k", "_seg").applyInPandas(path, kind)
