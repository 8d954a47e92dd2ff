"""Exact components of similar weighted token sets by a token-group matrix.

Similar sets are put into groups: each joins the group of the most frequent of its stored tokens. The matrix holds the union of the
stored tokens of each group's members. A set is held against it: how many of its stored tokens a group has bounds what it can share
with any member, and only groups that reach the bound are opened for it. Sets in similarity t share enough stored tokens, so for each
such pair one of the two has opened the group of the other.

In an open group not all pairs are compared. Its centre is what most of (a sample of) its sets have, and each set is described by how it differs from
the centre: weight ``m`` is missing from it and ``r`` beyond it. With ``e = m / (1 + t) + r t / (1 + t)`` and ``b = weight of the centre (1 - t) / (1 + t)``
two sets are similar just if the differences that they share weigh at least ``e1 + e2 - b``. So:

* The set with the least e, the hub, is compared with all others. Every pair that is similar without a shared difference is linked to it.
* Any other similar pair shares differences of that weight. All but a part too light for it are stored, as before.
  Sets of different components that share enough of them are compared in pairs where few sets have a difference; where many do, those
  sets become the next level, with groups and centres of their own.
* Nearly all sets have to share something beyond the centre. Of a centre of weight c, sets of sizes s have in common c - max(m1, m2) at most and need
  (s1 + s2) t / (1 + t). So if 2 s t / (1 + t) exceeds c - m, a set can only be similar to one of its size or more by what both have beyond the centre;
  sets for which it does not are light, and mostly those that the hub has linked. What is missing from many sets is shared by many, but only
  pairs with a light set are looked for by it: of light sets in different components, and of a light set with one that is large
  enough to have room for it.

Two sets that both have only opened a group need not be compared in it: they meet in a group of their own.

Each level takes what many sets share into the centre, so a large group of near copies costs as much as its differences and not the square of its
size. Any choice of groups, centres and samples gives the same components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.graph import components
from riskflow.session import cut, sweep

CENTRE, LEVELS = 32, 60
PAIRED, WIDER = 1024, 8  # pairs of a token that are compared as pairs, and how many times more on each further level
MEET = 1 / 6  # of what two similar sets share at least, the part that they have to share in stored tokens
NEAR = 1e-6
VECTOR = "_node binary, _tokens binary, _weights binary"
_VECTOR = pa.schema([("_node", pa.binary()), ("_tokens", pa.binary()), ("_weights", pa.binary())])


def packed(tokens: np.ndarray, weights: np.ndarray | None = None) -> tuple[bytes, bytes | None]:
    """Sorted distinct tokens (unsigned 64 bits) and their weights as columns of a vector; no weights: each weighs 1."""
    return tokens.astype("<u8").tobytes(), None if weights is None else zlib.compress(weights.astype("<f8").tobytes(), 1)


def unpacked(tokens: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(tokens, "<u8")
    return t, np.ones(len(t)) if weights is None else np.frombuffer(zlib.decompress(weights), "<f8")


def matched(rows: DataFrame, component: str) -> DataFrame:
    """(_scope, _beyond, _node, _component, _need, _lead, _own = tokens with their numbers of sets and of leads) of the sets that share ``_need`` of
    their stored tokens' weight with sets of other components. rows: (_scope, _beyond, _token, _node, _need, _w, _lead)."""
    alike = Window.partitionBy("_scope", "_beyond", "_token")  # one shuffle of the rows; what a token is counted over stays with them
    counted = rows.select("*", F.count(F.lit(1)).over(alike).alias("_n"), F.count_if("_lead").over(alike).alias("_l"),
                          F.min(component).over(alike).alias("_a"), F.max(component).over(alike).alias("_b"))
    shared = counted.filter("_a <> _b and _l > 0")
    sets = shared.groupBy("_scope", "_beyond", "_node").agg(F.first(component).alias("_component"), F.max("_need").alias("_need"), F.max("_lead").alias("_lead"),
                                                 F.collect_set(F.struct("_n", "_token", "_l", "_w")).alias("_own"))
    return cut(sets.filter(_weighs("_own") >= F.col("_need")))


def _weighs(own: str):
    return F.aggregate(own, F.lit(0.0), lambda total, x: total + x["_w"])


def placed(sets: DataFrame, gathered: bool = False) -> DataFrame:
    """(_group, _node, _lead): the groups that each set is in (as a lead) or has opened. Leads make up the matrix; what isn't a lead has
    no group of its own, as it need not be compared with its like. ``gathered``: a set joins the group of the most frequent token of all sets
    that it shares a token with, so that near copies with few tokens in common are in one group and not each in those of all others."""
    sets = sets.withColumn("_top", F.array_max("_own").getField("_token"))
    if gathered:
        tokens = sets.select("_scope", "_beyond", "_node", F.array_max("_own").alias("_best"), F.explode("_own").alias("_x")).select("*", "_x._token")
        best = tokens.groupBy("_scope", "_beyond", "_token").agg(F.max(F.struct("_best._n", F.col("_best._token").alias("_t"))).alias("_far"))
        tops = tokens.join(best, ["_scope", "_beyond", "_token"]).groupBy("_scope", "_beyond", "_node").agg(F.max("_far").getField("_t").alias("_top"))
        sets = sets.drop("_top").join(tops, ["_scope", "_beyond", "_node"])
    homes = sets.withColumn("_home", F.when(F.col("_lead"), F.xxhash64("_scope", "_beyond", "_top")).otherwise(F.lit(0)))
    each = homes.select("_scope", "_beyond", "_node", "_need", "_lead", "_home", F.explode("_own").alias("_x")).select("*", "_x._token", "_x._w").drop("_x")
    matrix = each.filter("_lead").select("_scope", "_beyond", "_token", F.col("_home").alias("_group")).distinct()
    met = each.join(matrix, ["_scope", "_beyond", "_token"]).groupBy("_scope", "_beyond", "_node", "_lead", "_home", "_group").agg(F.sum("_w").alias("_hits"), F.first("_need").alias("_need"))
    own = F.col("_lead") & (F.col("_group") == F.col("_home"))
    return met.filter(own | (F.col("_hits") >= F.col("_need"))).groupBy("_group", "_node").agg(F.max(own).alias("_lead"))


def centres(members: DataFrame, vectors: DataFrame, on: str) -> DataFrame:
    """(_group, _ct, _cw): tokens that more than half of a sample of about ``CENTRE`` members have. members: (_group, _node, _lead, _n)."""
    spot = F.pmod(F.xxhash64("_group", "_node"), F.lit(1 << 30))
    chosen = members.filter(spot * F.col("_n") < F.lit(CENTRE << 30)).select("_group", F.col("_node").alias(on)).join(vectors, on)

    def centre(part: pd.DataFrame) -> pd.DataFrame:
        found = [unpacked(t, w) for t, w in zip(part["_tokens"], part["_weights"])]
        tokens, first, n = np.unique(np.concatenate([t for t, _ in found]), return_index=True, return_counts=True)
        most = 2 * n > len(found)
        weights = np.concatenate([w for _, w in found])[first[most]]
        t, w = packed(tokens[most], None if part["_weights"].isna().all() else weights)
        return pd.DataFrame({"_group": part["_group"].iloc[:1], "_ct": [t], "_cw": [w]})

    return chosen.select("_group", "_tokens", "_weights").groupBy("_group").applyInPandas(centre, "_group long, _ct binary, _cw binary")


_DIFFERENCE = "_group long, _node binary, _lead boolean, _m double, _r double, _c double, _e double, _k long, _dt binary, _dw binary"


def differences(members: DataFrame, vectors: DataFrame, on: str, threshold: float) -> DataFrame:
    """How each member differs from its group's centre: weights missing and beyond, the centre's weight, e, and the differences as a vector, of which
    the first _k are missing."""
    t = threshold
    joined = members.select("_group", F.col("_node").alias(on), "_lead").join(vectors, on).join(centres(members, vectors, on), "_group", "left")
    schema = pa.schema([("_group", pa.int64()), ("_node", pa.binary()), ("_lead", pa.bool_()), *[(c, pa.float64()) for c in ("_m", "_r", "_c", "_e")], ("_k", pa.int64()), ("_dt", pa.binary()), ("_dw", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for group, node, lead, tokens, weights, ct, cw in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)):
                    (own, w), (mid, v) = unpacked(tokens, weights), unpacked(ct or b"", cw)  # no sample, no centre
                    missing, beyond = ~np.isin(mid, own, assume_unique=True), ~np.isin(own, mid, assume_unique=True)
                    diff, worth = np.concatenate([~mid[missing][::-1], own[beyond]]), np.concatenate([v[missing][::-1], w[beyond]])
                    m, r = float(v[missing].sum()), float(w[beyond].sum())
                    out.append((group, node, lead, m, r, float(v.sum()), m / (1 + t) + r * t / (1 + t), int(missing.sum()), *packed(diff, None if weights is None else worth)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined.select("_group", "_node", "_lead", "_tokens", "_weights", "_ct", "_cw").mapInArrow(work, _DIFFERENCE)


def _linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) of the pairs of one group, given as u and v with columns _m, _r, _c, _dt, _dw of each, that are similar."""
    sides = [f"{c}{s}" for s in "uv" for c in ("_node", "_m", "_r", "_dt", "_dw")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                out = []
                for c, u, mu, ru, tu, wu, v, mv, rv, tv, wv in zip(*(x.to_pylist() for x in b.slice(i, 1024).columns)):
                    (du, eu), (dv, _) = unpacked(tu, wu), unpacked(tv, wv)
                    _, at, _ = np.intersect1d(du, dv, assume_unique=True, return_indices=True)
                    both = c - mu - mv + float(eu[at].sum())
                    if both >= threshold * (2 * c - mu - mv + ru + rv - both) - 1e-9:
                        out.append((u, v))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["src", "dst"])

    return pairs.select("_c", *sides).mapInArrow(work, "src binary, dst binary")


def _bounds(parted: DataFrame, threshold: float) -> DataFrame:
    """The members of the groups that hold several components, each with whether it is light and what its group's pairs can be.

    _low: least e; _small: least size; _light_small: least size of a light set; _several: light sets lie in several components; _room: size of
    the largest light set that a set has room for, _most of it in the group.
    """
    t = threshold / (1 + threshold)
    slack = NEAR * (1 + F.col("_c") + F.col("_size"))
    sized = parted.withColumn("_size", F.col("_c") - F.col("_m") + F.col("_r"))
    rated = sized.withColumn("_light", 2 * t * F.col("_size") - (F.col("_c") - F.col("_m")) <= slack).withColumn(
        "_room", F.when(~F.col("_light"), (F.col("_c") - F.col("_m") + slack) / t - F.col("_size")))
    roomy = F.col("_room") >= threshold * F.col("_size")
    groups = rated.groupBy("_group").agg(
        F.min("_component").alias("_a"), F.max("_component").alias("_b"), F.min("_e").alias("_low"), F.min("_size").alias("_small"),
        F.min(F.when(F.col("_light"), F.col("_size"))).alias("_light_small"), F.max(F.when(roomy, F.col("_room"))).alias("_most"),
        (F.min(F.when(F.col("_light"), F.col("_component"))) < F.max(F.when(F.col("_light"), F.col("_component")))).alias("_several"))
    out = rated.join(groups.filter("_a <> _b").drop("_a", "_b"), "_group")
    paired = F.when(F.col("_light"), F.col("_several") | (F.col("_size") <= F.col("_most"))).otherwise(roomy & (F.col("_room") >= F.col("_light_small")))
    return out.withColumn("_both", F.coalesce(paired, F.lit(False)))


def _stored(apart: DataFrame, threshold: float) -> DataFrame:
    """(_scope = group, _beyond, _token, _node, _component, _lead, _need, _w): of each member's differences those that it may have to share with another
    set of its group, in the order of their numbers. apart: differences with their ``_bounds``.

    ``_beyond``: what is beyond the centre, of all sets. Else all differences of the sets that may be similar without that; leads are light there.
    Two similar sets share ``least`` of either at least, so beyond what either stores they share under (1 - MEET) of the greater one.
    """
    t = threshold
    names = ("_scope", "_beyond", "_token", "_node", "_component", "_lead", "_need", "_w")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.float64(), pa.float64()))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, at, beyond, leads, tokens, weights, needs = b.slice(i, 256), [], [], [], [], [], []
                for j, (lead, light, both, m, c, e, low, size, small, k, dt, dw) in enumerate(zip(*(x.to_pylist() for x in part.columns[3:]))):
                    own, w = unpacked(dt, dw)
                    slack = NEAR * (1 + c + size)
                    out = (size + max(t * size, small)) * t / (1 + t) - (c - m)
                    other = max(low, (t * size - c) * t / (1 + t), (c - size / t) / (1 + t))
                    kinds = [(True, k, out, lead), (False, 0, e + other - c * (1 - t) / (1 + t), light)]
                    for kind, start, least, leads_here in kinds if both else kinds[:1]:
                        least = max(0.0, least - slack)
                        rest = np.cumsum(w[start:][::-1])[::-1]  # of a token and those after it
                        keep = rest >= least * (1 - MEET)
                        at.append(j), beyond.append(kind), leads.append(leads_here), needs.append(least * MEET * (1 - NEAR))
                        tokens.append(own[start:][keep].view(np.int64)), weights.append(w[start:][keep])
                each = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in tokens]))
                from_ = pa.array(at).take(each)
                yield pa.RecordBatch.from_arrays([part.column(0).take(from_), pa.array(beyond).take(each), pa.array(np.concatenate(tokens)), part.column(1).take(from_),
                                                  part.column(2).take(from_), pa.array(leads).take(each), pa.array(needs, pa.float64()).take(each), pa.array(np.concatenate(weights))], schema=schema)

    return apart.select("_group", "_node", "_component", "_lead", "_light", "_both", "_m", "_c", "_e", "_low", "_size", "_small", "_k", "_dt", "_dw").mapInArrow(
        work, "_scope long, _beyond boolean, _token long, _node binary, _component binary, _lead boolean, _need double, _w double")


def _side(found: DataFrame, s: str) -> DataFrame:
    return found.select("_group", *[F.col(c).alias(f"{c}{s}") for c in ("_node", "_m", "_r", "_dt", "_dw")])


def similar_components(rows: DataFrame, vectors, threshold: float, on: str = "_node", gathered: bool = False) -> DataFrame:
    """(_node, _component) of the sets that are linked to another, by weighted Jaccard similarity of ``threshold`` at least.

    ``rows``: (_token, _node, _need), such that any similar pair shares as many tokens at least as either needs; its _node is the
    vectors' column ``on``, which may stand for several vectors. ``vectors``: from the sets that are in groups, as (_group, _node, _lead), to
    their (_node, _tokens, _weights), see ``packed``; where sets share a token it weighs the same in each. ``gathered``: see ``placed``, for tokens that only similar sets share. No rows, no components.
    """
    t, links = threshold, None
    first = rows.select(F.lit(0).cast("long").alias("_scope"), F.lit(False).alias("_beyond"), "_token", "_node", F.col("_need").cast("double").alias("_need"), F.lit(1.0).alias("_w"), F.lit(True).alias("_lead"))
    members = cut(placed(matched(first, "_node"), gathered))
    vectors = vectors(members)
    for level in range(LEVELS):
        sizes = members.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
        several = members.join(sizes.filter("_n > 1") if on == "_node" else sizes, "_group")
        found = cut(differences(several, vectors, on, t))
        sweep(found.sparkSession)  # of each step, so that their shuffle files don't add up over a level
        new = cut(_linked(_led(found), t))
        links = new if links is None else cut(links.unionByName(new))
        label = _named(links)
        parted = found.join(label, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))
        sets = matched(_stored(_bounds(parted, t), t), "_component")
        # what a pair shares lies half in tokens of few sets or half in those of many
        few, many = (sets.withColumn("_own", F.filter("_own", _in_few(few, PAIRED * WIDER**min(level, 6)))).withColumn("_need", F.col("_need") / 2)
                     .filter((F.size("_own") > 0) & (_weighs("_own") >= F.col("_need"))) for few in (True, False))
        new = cut(_linked(_paired(few, found), t))
        found_more = not new.isEmpty()
        if found_more:  # the next level's components know of them
            links = cut(links.unionByName(new))
        if many.isEmpty():
            return _named(links) if found_more else label
        members, on = cut(placed(many)), "_node"
        sweep(members.sparkSession)
    raise RuntimeError(f"groups of sets that differ alike in {LEVELS} levels")


def _in_few(wanted: bool, most: int):
    return lambda x: (x["_n"] * x["_l"] <= most) == F.lit(wanted)


def _led(found: DataFrame) -> DataFrame:
    """Each member with the hub of its group."""
    hub = found.groupBy("_group").agg(F.min(F.struct("_e", "_node")).alias("_h"), F.first("_c").alias("_c")).select("_group", "_c", F.col("_h._node").alias("_hub"))
    return _side(found, "u").join(hub, "_group").filter("_nodeu <> _hub").join(_side(found.join(hub.drop("_c"), "_group").filter("_node = _hub"), "v"), "_group")


def _paired(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of a lead and another set of the same scope, in different components, that share in ``_own`` what both need."""
    each = sets.select(F.col("_scope").alias("_group"), "_beyond", "_node", "_component", "_need", "_lead", F.explode("_own").alias("_x")).select("*", "_x._token", "_x._w").drop("_x")
    one, two = (each.select("_group", "_beyond", "_token", *[F.col(c).alias(f"{c}{s}") for c in ("_node", "_component", "_need", "_lead", "_w")]) for s in "uv")
    met = one.filter("_leadu").join(two.drop("_wv"), ["_group", "_beyond", "_token"]).filter("_componentu <> _componentv and (not _leadv or _nodeu < _nodev)")
    met = met.groupBy("_group", "_beyond", "_nodeu", "_nodev").agg(F.sum("_wu").alias("_w"), F.first(F.greatest("_needu", "_needv")).alias("_need")).filter("_w >= _need")
    centre = found.groupBy("_group").agg(F.first("_c").alias("_c"))
    return met.select("_group", "_nodeu", "_nodev").distinct().join(_side(found, "u"), ["_group", "_nodeu"]).join(_side(found, "v"), ["_group", "_nodev"]).join(centre, "_group")


def _named(links: DataFrame) -> DataFrame:
    out = cut(components(links).select(F.col("id").alias("_node"), F.col("component").alias("_component")))
    sweep(links.sparkSession)
    return out
