"""Exact k nearest neighbours by pivots: a row is compared only with cells that can hold a neighbour.

Pivots are a bounded number of points chosen by hash, so dense regions get more of them. Every point belongs to the cell of its nearest
pivot. A row is compared with the points of its own cell first: the k nearest of them bound how far its k-th neighbour can be. Where the cell has too few,
the k least distances to the pivot in each cell do, by the triangle inequality. Then the row goes to the other
cells whose ball and whose side of the bisecting plane reach into that distance, which are few. Cells of many points, and of many rows, are
cut into blocks, so a task compares at most ``BLOCK`` rows with as many points, and the k nearest of all blocks are merged.

Of points in exactly the same place only those of the k least ids can be anyone's neighbours; the others are left out beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import cut

PIVOTS, BLOCK = 4096, 4096
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        out += (x[:, None] - y[None, :]) ** 2
    return np.sqrt(out, out=out)


def distinct_points(points: DataFrame, k: int) -> DataFrame:
    """Of (_p, _x) at most k points in each place, those of the least ids."""
    place = F.row_number().over(Window.partitionBy("_x").orderBy("_p"))
    return points.withColumn("_i", place).filter(F.col("_i") <= k).drop("_i")


def nearest(rows: DataFrame, points: DataFrame, k: int, others: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """(_q, _p, _d): of each row (_q, _x) the k nearest points (_p, _x), all if there are fewer; equal distances by least id.

    ``others``: a row is no neighbour of the point of its own id. Ids are longs and not null, ``_x`` arrays of numbers of one length.
    """
    need = k + 1 if others else k
    points = cut(distinct_points(points, need))
    total = points.count()
    kind = "_q long, _p long, _d double"
    if not total:
        return rows.sparkSession.createDataFrame([], kind)
    chosen = points.orderBy(F.xxhash64("_x"), "_p").limit(min(pivots, max(1, math.isqrt(total)))).select("_x").collect()
    centre = np.unique(np.array([r[0] for r in chosen], float), axis=0)

    def assign(batches):
        for part in batches:
            d = _distances(_matrix(part["_x"]), centre) if len(part) else np.empty((0, len(centre)))
            cell = d.argmin(axis=1)
            yield part.assign(_cell=cell.astype(np.int32), _r=d[np.arange(len(d)), cell])

    placed = cut(points.mapInPandas(assign, "_p long, _x array<double>, _cell int, _r double"))
    near = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_cell").orderBy("_r"))).filter(F.col("_i") <= need)
    inner = {r["_cell"]: sorted(r["_rs"]) for r in near.groupBy("_cell").agg(F.collect_list("_r").alias("_rs")).collect()}
    sizes = {r["_cell"]: (r["_n"], r["_far"]) for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_far")).collect()}
    full = np.array(sorted(sizes))
    far = np.array([sizes[j][1] for j in full])
    reach = np.full(len(centre), np.inf)  # how far beyond its own pivot's distance the k-th neighbour of a row can be
    if total >= need:
        close = np.full((len(full), need), np.inf)
        for i, j in enumerate(full):
            close[i, : len(inner[j])] = inner[j]
        for i in range(len(centre)):
            reach[i] = np.partition((_distances(centre[full], centre[i : i + 1]) + close).ravel(), need - 1)[need - 1]
    blocks = {int(j): -(-sizes[j][0] // BLOCK) for j in full}

    def home(batches):
        for part in batches:
            for i in range(0, len(part), 1024):
                some = part.iloc[i : i + 1024]
                yield some.assign(_cell=_distances(_matrix(some["_x"]), centre).argmin(axis=1).astype(np.int32))

    def route(batches):
        for part in batches:
            for i in range(0, len(part), 1024):
                some = part.iloc[i : i + 1024]
                d, own = _distances(_matrix(some["_x"]), centre), some["_cell"].to_numpy()
                least = d[np.arange(len(d)), own][:, None]
                limit = np.fmin(least[:, 0] + reach[own], some["_far"].to_numpy(float))[:, None] * (1 + SLACK) + SLACK
                apart = _distances(centre[own], centre[full])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(apart > 0, (d[:, full] ** 2 - least**2) / (2 * apart), 0)
                at, to = np.nonzero((np.maximum(d[:, full] - far, plane) <= limit) & (full[None, :] != own[:, None]))
                yield pd.DataFrame({"_q": some["_q"].to_numpy()[at], "_x": some["_x"].to_numpy()[at], "_cell": full[to].astype(np.int32)})

    def dealt(df: DataFrame, name: str, own: dict, over: dict) -> DataFrame:
        """The rows with their own block of the cell, for each block of the other side."""
        table = df.sparkSession.createDataFrame([(int(j), int(own.get(j, 1)), int(n)) for j, n in over.items()], "_cell int, _own int, _over int")
        mine, each = F.pmod(F.xxhash64(name), F.col("_own")), F.explode(F.sequence(F.lit(0), F.col("_over") - 1))
        out = df.join(F.broadcast(table), "_cell").select(name, "_x", "_cell", mine.cast("int").alias("_mine"), each.alias("_other"))
        return out if name == "_p" else out.select(name, "_x", "_cell", F.col("_other").alias("_mine"), F.col("_mine").alias("_other"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_q": [], "_p": [], "_d": []})
        right = right.sort_values("_p")
        ids, there, q = right["_p"].to_numpy(), _matrix(right["_x"]), left["_q"].to_numpy()
        here, out = _matrix(left["_x"]), []
        for i in range(0, len(q), 512):
            d = _distances(here[i : i + 512], there)
            if others:
                d[q[i : i + 512, None] == ids[None, :]] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1, None] if k < d.shape[1] else np.inf
            row, at = np.nonzero((d <= most) & np.isfinite(d))  # ids ascend in a row, and sorting leaves equal distances so
            order = np.lexsort((d[row, at], row))
            row, at = row[order], at[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[nth < k], at[nth < k]
            out.append(pd.DataFrame({"_q": q[i + row], "_p": ids[at], "_d": d[row, at]}))
        return pd.concat(out)

    keys = ["_cell", "_mine", "_other"]

    def searched(routed: DataFrame) -> DataFrame:
        asked = {r["_cell"]: -(-r["_n"] // BLOCK) for r in routed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).collect()}
        left = dealt(routed, "_q", asked, {j: blocks[j] for j in asked})
        right = dealt(placed, "_p", blocks, asked)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, kind)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("_i", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_p"))).filter(F.col("_i") <= k).drop("_i")

    at_home = cut(rows.select("_q", "_x").mapInPandas(home, "_q long, _x array<double>, _cell int"))
    first = cut(best(searched(at_home)))
    bound = first.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_far")).filter(F.col("_n") == k).drop("_n")
    away = cut(at_home.join(bound, "_q", "left").mapInPandas(route, "_q long, _x array<double>, _cell int"))
    return best(first.unionByName(searched(away)))
