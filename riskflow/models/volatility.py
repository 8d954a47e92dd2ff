"""GARCH(1,1) by maximum likelihood for every key: variance = omega + alpha * (last squared return) + beta * (last variance).

The variances and their derivatives follow affine recursions, and such maps compose: a series is cut into pieces that all start from
zero at once, what the pieces do is chained, and then every piece runs from its true start. So a long series costs as many steps as
a piece has, whatever its length. Parameters climb by damped Fisher scoring in coordinates in which omega > 0, alpha, beta >= 0 and alpha + beta < 1.

Ordinary keys are read as a sorted stream and fitted where they are read, many at a time. Keys above the row budget lie in segments: each round
two aggregates give what the segments do and the sums of likelihood, gradient and information, one row per segment and key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators import ordered as od
from riskflow.session import cut

PIECE, ROUNDS, GAIN, MOST, BOUND = 512, 500, 1e-8, 0.9999, 16.0
GATHER = 1 << 18  # rows of whole keys that are fitted together
LOG_2PI = float(np.log(2 * np.pi))


def _run(par: np.ndarray, last: np.ndarray, e2: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, first: np.ndarray, var: np.ndarray, sums: bool):
    """All pieces step by step. ``par``: omega, alpha, beta by piece; ``state``: variance and its three derivatives before the piece; ``first``: the
    piece begins its series, whose first variance is ``var``. Returns the states after, and by piece log-likelihood, gradient, information."""
    order = np.argsort(-length, kind="stable")
    om, al, be = par[order].T
    begin, length, s, first, var = begin[order], length[order], state[order].copy(), first[order], var[order]
    out = np.zeros((len(order), 10))
    for i in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -i))
        at = begin[:n] + i
        new = np.empty((n, 4))
        new[:, 0] = om[:n] + al[:n] * last[at] + be[:n] * s[:n, 0]
        new[:, 1:] = be[:n, None] * s[:n, 1:]
        new[:, 1] += 1
        new[:, 2] += last[at]
        new[:, 3] += s[:n, 0]
        if i == 0:
            new[first[:n]] = 0
            new[first[:n], 0] = var[:n][first[:n]]
        s[:n] = new
        if sums:
            v, d = new[:, 0], new[:, 1:]
            out[:n, 0] -= 0.5 * (LOG_2PI + np.log(v) + e2[at] / v)
            out[:n, 1:4] += (0.5 * (e2[at] / v - 1) / v)[:, None] * d
            w = 0.5 / (v * v)
            for k, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                out[:n, 4 + k] += w * d[:, a] * d[:, b]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return s[back], out[back]


def _after(state: np.ndarray, zero: np.ndarray, beta: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The state after a piece that from zero would end in ``zero``, had it begun from ``state``."""
    power = beta**length
    out = zero + power[:, None] * state
    out[:, 3] += length * beta ** np.maximum(length - 1, 0) * state[:, 0]
    return out


class Series:
    """Series of several keys, one after the other, cut into pieces."""

    def __init__(self, e2: np.ndarray, begins: np.ndarray):
        size = np.diff(np.append(begins, len(e2)))
        self.e2, self.size = e2, size
        self.last = np.append(0.0, e2[:-1])
        pieces = -(-size // PIECE)
        self.owner = np.repeat(np.arange(len(size)), pieces)
        self.nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.begin = begins[self.owner] + self.nth * PIECE
        self.length = np.minimum(PIECE, size[self.owner] - self.nth * PIECE)
        self.var = np.add.reduceat(e2, begins) / size if len(size) else np.empty(0)

    def some(self, keys: np.ndarray) -> Series:
        """The series of some keys, in order, over the same rows."""
        out, chosen = copy(self), np.zeros(len(self.size), bool)
        chosen[keys] = True
        mine = chosen[self.owner]
        out.size, out.var = self.size[chosen], self.var[chosen]
        out.owner = (np.cumsum(chosen) - 1)[self.owner[mine]]
        out.nth, out.begin, out.length = self.nth[mine], self.begin[mine], self.length[mine]
        return out

    def evaluate(self, par: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By key: (log-likelihood, gradient, information) as ten columns, and the state after the last row."""
        own, first, var = par[self.owner], self.nth == 0, self.var[self.owner]
        start = np.zeros((len(own), 4))
        if len(own) > len(self.size):
            zero, _ = _run(own, self.last, self.e2, self.begin, self.length, start, first, var, False)
            for i in range(1, int(self.nth.max()) + 1):
                at = np.flatnonzero(self.nth == i)
                start[at] = zero[at - 1] if i == 1 else _after(start[at - 1], zero[at - 1], own[at - 1, 2], self.length[at - 1])
        end, out = _run(own, self.last, self.e2, self.begin, self.length, start, first, var, True)
        total = np.zeros((len(self.size), 10))
        np.add.at(total, self.owner, out)
        return total, end[np.cumsum(np.bincount(self.owner, minlength=len(self.size))) - 1]


def _parameters(theta: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """omega, alpha, beta and their Jacobian from ln (omega / variance) and the logits of the persistence and of alpha's share in it."""
    a, b = 1 / (1 + np.exp(-theta[:, 1])), 1 / (1 + np.exp(-theta[:, 2]))
    p = MOST * a
    jac = np.zeros((len(theta), 3, 3))
    jac[:, 0, 0] = om = var * np.exp(theta[:, 0])
    jac[:, 1, 1], jac[:, 1, 2] = p * (1 - a) * b, p * b * (1 - b)
    jac[:, 2, 1], jac[:, 2, 2] = p * (1 - a) * (1 - b), -p * b * (1 - b)
    return np.stack([om, p * b, p * (1 - b)], axis=1), jac


def climb(var: np.ndarray, evaluate: Callable[[np.ndarray], np.ndarray], starts=((0.9, 0.1), (0.5, 0.3)),
          some: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, log-likelihood, settled) of each key, of the best of the starts (persistence, alpha's share).

    ``evaluate``: ten sums by key. ``some(parameters of all keys, places)`` gives those of some keys only; with it, a key that has settled
    costs nothing more."""
    some = some or (lambda p, at: evaluate(p)[at])
    best = None
    index = np.array([[0, 1, 2], [1, 3, 4], [2, 4, 5]])
    for persistence, share in starts:
        logit = lambda x: np.log(x / (1 - x))
        theta = np.column_stack([np.full(len(var), np.log(1 - persistence)), np.full(len(var), logit(persistence / MOST)), np.full(len(var), logit(share))])
        damp, done = np.full(len(var), 1e-3), np.zeros(len(var), bool)
        par, jac = _parameters(theta, var)
        now = evaluate(par)
        for _ in range(ROUNDS):
            live = np.flatnonzero(~done)
            if not len(live):
                break
            at, own = theta[live], jac[live]
            g = np.einsum("kij,ki->kj", own, now[live, 1:4])
            h = np.einsum("kai,kab,kbj->kij", own, now[live, 4:][:, index], own)
            # a coordinate at its bound that would go beyond stays there
            free = ~(((at >= BOUND) & (g > 0)) | ((at <= -BOUND) & (g < 0)))
            g, h = g * free, h * free[:, :, None] * free[:, None, :] + ~free[:, :, None] * np.eye(3)
            size = np.einsum("kii->ki", h)[:, :, None] * np.eye(3)
            solve = lambda extra, g=g, h=h, size=size: np.linalg.solve(h + size * extra[:, None, None] + 1e-14 * np.eye(3), g[:, :, None])[:, :, 0]
            left = (g * solve(np.full(len(g), 1e-10))).sum(axis=1)  # what a whole step promises
            settled = (left <= GAIN) | (damp[live] > 1e12)
            done[live] = settled
            step = np.clip(solve(damp[live]), -3, 3)[~settled]
            live = live[~settled]
            if not len(live):
                break
            trial = np.clip(theta[live] + step, -BOUND, BOUND)
            new_par, new_jac = _parameters(trial, var[live])
            tried = par.copy()
            tried[live] = new_par
            new = some(tried, live)
            better = new[:, 0] >= now[live, 0]
            for x, y in ((theta, trial), (par, new_par), (jac, new_jac), (now, new)):
                x[live[better]] = y[better]
            damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-9), damp[live] * 5)
        found = par, now[:, 0], done
        best = found if best is None else tuple(np.where((now[:, 0] > best[1]).reshape((-1,) + (1,) * (x.ndim - 1)), x, y) for x, y in zip(found, best))
    return best


def _chosen(given: tuple[float, float] | None, var: np.ndarray, evaluate: Callable[[np.ndarray], np.ndarray], some=None):
    if given is None:
        return climb(var, evaluate, some=some)
    par = np.column_stack([var * (1 - sum(given)), *(np.full(len(var), x) for x in given)])
    return par, evaluate(par)[:, 0], np.ones(len(var), bool)


def _returns(df: DataFrame, key: str, order: list[str], col: str, minimum: int) -> DataFrame:
    """Rows with their squared deviation from the key's mean; keys of fewer rows, and those that never vary, are left out."""
    x = F.col(col).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(key, *order, x.alias("_x"))
    mean = rows.groupBy(key).agg(F.avg("_x").alias("_mean"), F.var_pop("_x").alias("_var"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= minimum) & (F.col("_var") > 0))
    return rows.join(mean, key).select(key, *order, F.pow(F.col("_x") - F.col("_mean"), 2).alias("_e"), "_var", "_n")


def garch_fit(df: DataFrame, key: str, order: Sequence[str], col: str, minimum: int = 30,
              given: tuple[float, float] | None = None) -> DataFrame:
    """(key, n, omega, alpha, beta, log_likelihood, last_volatility, settled) of the keys with ``minimum`` values at least and any variance.

    Returns are taken from their mean and begin at their variance; null and not-a-number ones, and rows of a null key, are left out. ``order`` has
    no nulls and should leave no ties. ``last_volatility`` is that of the last row; ``settled`` is false if the climb was ended first.
    ``given``: alpha and beta, where omega is then what makes the mean variance that of the returns and nothing is fitted.
    """
    order = list(order)
    hot = od.find_hot(df, [key])
    rows = _returns(df, key, order, col, minimum)
    kind = T.StructType([df.schema[key], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("omega", "alpha", "beta", "log_likelihood", "last_volatility")],
                         T.StructField("settled", T.BooleanType())])

    def fitted(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        series = Series(part["_e"].to_numpy(), begins)
        par, value, settled = _chosen(given, series.var, lambda p: series.evaluate(p)[0], lambda p, at: series.some(at).evaluate(p[at])[0])
        return pd.DataFrame({key: part[key].to_numpy()[begins], "n": series.size, "omega": par[:, 0], "alpha": par[:, 1], "beta": par[:, 2], "log_likelihood": value,
                             "last_volatility": np.sqrt(series.evaluate(par)[1][:, 0]), "settled": settled})

    def stream(batches):
        held, waiting = None, []
        for batch in chain(batches, (None,)):
            if batch is not None:
                waiting.append(batch)
                if sum(map(len, waiting)) < GATHER:  # a step of the recursion costs the same for one key as for many
                    continue
            elif not waiting:
                break
            part = pd.concat(waiting if held is None else [held, *waiting], ignore_index=True)
            waiting = []
            k = part[key].to_numpy()
            begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
            if len(begins) > 1:
                yield fitted(part.iloc[: begins[-1]], begins[:-1])
            held = part.iloc[begins[-1] :].reset_index(drop=True) if len(begins) else None
        if held is not None and len(held):
            yield fitted(held, np.zeros(1, np.int64))

    # a fixed number of partitions: by their size alone they would be merged, but the work lies in the climb
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = (od._without(rows, hot) if hot else rows).repartition(tasks, key).sortWithinPartitions(key, *order).select(key, "_e").mapInPandas(stream, kind)
    return plain.unionByName(_fit_hot(cut(od.segment(od._only(rows, hot), hot, order[0])), key, order, kind, given)) if hot else plain


def _fit_hot(rows: DataFrame, key: str, order: list[str], kind: T.StructType, given: tuple[float, float] | None) -> DataFrame:
    """The same climb for keys in segments: the climber's state is one row per hot key, of which there is a bounded number."""
    spark, name = rows.sparkSession, kind[key].dataType.simpleString()
    keys = {r[key]: (r["_var"], r["_n"]) for r in rows.groupBy(key).agg(F.first("_var").alias("_var"), F.first("_n").alias("_n")).collect()}
    if not keys:
        return spark.createDataFrame([], kind)
    names = list(keys)
    ends = rows.groupBy(key, "_seg").agg(F.max_by("_e", F.struct(*order)).alias("_end"))
    rows = cut(rows.join(F.broadcast(ends.select(key, "_seg", F.lag("_end").over(Window.partitionBy(key).orderBy("_seg")).alias("_before"))), [key, "_seg"]))
    columns = ["_v0", "_v1", "_v2", "_v3"]

    def pieces(placed: DataFrame, sums: bool) -> DataFrame:
        def work(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order)
            e, before = part["_e"].to_numpy(), part["_before"].iloc[0]
            first = bool(pd.isna(before))
            last = np.append(0.0 if first else before, e[:-1])
            begin = np.arange(0, len(e), PIECE)
            length = np.minimum(PIECE, len(e) - begin)
            par = np.tile(part[["_om", "_al", "_be"]].iloc[0].to_numpy(float), (len(begin), 1))
            starts, head = np.zeros((len(begin), 4)), np.arange(len(begin)) == 0
            starts[0] = part[columns].iloc[0].to_numpy(float)
            var, none = np.full(len(begin), part["_var"].iloc[0]), np.zeros((len(begin), 4))
            zero, _ = _run(par, last, e, begin, length, none, head & first, var, False)
            for i in range(1, len(begin)):
                fresh = first and i == 1
                starts[i] = zero[0] if fresh else _after(starts[i - 1 : i], zero[i - 1 : i], par[i - 1 : i, 2], length[i - 1 : i])[0]
            end, out = _run(par, last, e, begin, length, starts, head & first, var, sums)
            row = {key: part[key].iloc[0], "_seg": part["_seg"].iloc[0], "_len": len(e), **dict(zip(columns, end[-1])), **{f"_s{i}": x for i, x in enumerate(out.sum(axis=0))}}
            return pd.DataFrame([row])

        shape = ", ".join([f"`{key}` {name}, _seg int, _len bigint", *[f"{c} double" for c in columns], *[f"_s{i} double" for i in range(10)]])
        return placed.groupBy(key, "_seg").applyInPandas(work, shape)

    def evaluate(par: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = dict(zip(names, par.tolist()))
        table = spark.createDataFrame([(k, *p) for k, p in own.items()], f"`{key}` {name}, _om double, _al double, _be double")
        placed = rows.join(F.broadcast(table), key)
        zero = pieces(placed.select("*", *[F.lit(0.0).alias(c) for c in columns]), False).select(key, "_seg", "_len", *columns).collect()
        starts, state, past = [], {}, set()
        for r in sorted(zero, key=lambda r: r["_seg"]):
            k, end = r[key], np.array([[r[c] for c in columns]])
            begin = state.get(k, np.zeros((1, 4)))
            starts.append((k, r["_seg"], *begin[0].tolist()))
            state[k] = _after(begin, end, np.array([own[k][2]]), np.array([r["_len"]])) if k in past else end
            past.add(k)
        begun = spark.createDataFrame(starts, f"`{key}` {name}, _seg int, " + ", ".join(f"{c} double" for c in columns))
        total = {r[key]: r for r in pieces(placed.join(F.broadcast(begun), [key, "_seg"]), True).groupBy(key).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(10)]).collect()}
        return np.array([[total[k][f"_s{i}"] for i in range(10)] for k in names]), np.array([state[k][0] for k in names])

    par, value, settled = _chosen(given, np.array([keys[k][0] for k in names]), lambda p: evaluate(p)[0])
    last = np.sqrt(evaluate(par)[1][:, 0])
    return spark.createDataFrame([(k, int(keys[k][1]), *map(float, par[i]), float(value[i]), float(last[i]), bool(settled[i])) for i, k in enumerate(names)], kind)
