"""Ordered computations that survive hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The operators here keep that plan for
ordinary keys and split the few keys that hold too many rows ("hot" keys):

* ``find_hot`` counts rows per key (map-side combined) and returns the keys above a row budget. The list is advice:
  results do not depend on it, so it may be reused or out of date.
* ``segment`` cuts the order axis of each hot key at its own quantiles.
* ``running`` is a running sum: a window inside each segment plus the totals of the earlier segments.
* ``row_frames`` makes ROWS frames and lag/lead possible: hot keys are cut into chunks and each chunk
  receives copies of the few neighbouring rows that its frames reach.
* ``trailing`` turns trailing RANGE frames into running sums of entry and expiry events: linear in the rows, where a
  sliding window frame costs rows x frame length.
* ``ranked_totals`` / ``quantiles`` do the same for one global order.

What is broadcast or collected is bounded whatever the number of rows: a hot key holds over 1/``MAX_HOT`` of them, so
there are at most ``MAX_HOT`` hot keys, and a key has about one segment per budget of rows, so a few ``MAX_HOT`` segments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_ROWS = 4_000_000
MAX_HOT = 10_000
_CUT_CLASSES = (15, 255, 4095)
_memo: dict = {}


@dataclass
class Hot:
    """Keys with more rows than one task should take, with their counts."""

    keys: list[str]
    rows: list = field(default_factory=list)
    budget: int = SEGMENT_ROWS
    schema: T.StructType | None = None
    source: DataFrame | None = None
    cuts: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.rows)

    def frame(self, df: DataFrame) -> DataFrame:
        data = [tuple(r[k] for k in self.keys) for r in self.rows]
        return df.sparkSession.createDataFrame(data, self.schema)


def segment_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.riskflow.segmentRows", str(SEGMENT_ROWS)))


def find_hot(df: DataFrame, keys: Sequence[str], budget: int | None = None, within: Hot | None = None) -> Hot:
    """Keys holding more than ``max(budget, rows / MAX_HOT)`` rows: at most ``MAX_HOT`` of them.

    ``within``: what was found for some of these keys in the same rows. If none is hot, no finer key is, and nothing is counted.
    """
    keys = list(keys)
    if within is not None and not within and set(within.keys) <= set(keys):
        return Hot(keys, [], within.budget, T.StructType([df.schema[k] for k in keys]), df)
    budget = budget or segment_rows(df)
    slot = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), budget)
    if slot not in _memo:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
        # fewer than MAX_HOT keys can exceed the limit, and only those leave the aggregate
        limit = max(budget, math.ceil((total or 0) / MAX_HOT))
        hot = counts.filter(F.col("_n") > limit).collect() if (most or 0) > limit else []
        rows = [r for r in hot if all(r[k] is not None for k in keys)]
        _memo[slot] = Hot(keys, rows, limit, T.StructType([df.schema[k] for k in keys]), df)
    return _memo[slot]


def gathered(df: DataFrame, hot: Hot) -> DataFrame:
    """The rows dealt by key once, if none is hot: windows over these keys, with or without further ones, then need no other shuffle."""
    if hot:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *hot.keys)


def _only(df: DataFrame, hot: Hot) -> DataFrame:
    return df.join(F.broadcast(hot.frame(df)), hot.keys, "left_semi").select(*df.columns)


def _without(df: DataFrame, hot: Hot) -> DataFrame:
    return df.join(F.broadcast(hot.frame(df)), hot.keys, "left_anti").select(*df.columns)


def segment(df: DataFrame, hot: Hot, by: str) -> DataFrame:
    """Add ``_seg``: 0 for ordinary keys, a position along ``by`` for hot ones. Equal values share a segment."""
    if not hot:
        return df.withColumn("_seg", F.lit(0))
    cuts = hot.cuts.get(by) or _find_cuts(df, hot, by)
    hot.cuts[by] = cuts
    element = df.schema[by].dataType
    schema = T.StructType(hot.schema.fields + [
        T.StructField("_outer", T.ArrayType(element)),
        T.StructField("_inner", T.ArrayType(T.ArrayType(element)))])
    table = df.sparkSession.createDataFrame(cuts, schema)
    stride = 1 + max((len(g) for c in cuts for g in c[-1]), default=0)
    joined = df.join(F.broadcast(table), hot.keys, "left")
    outer = F.size(F.filter("_outer", lambda c: c <= F.col(by)))
    inner = F.size(F.filter(F.element_at("_inner", outer + 1), lambda c: c <= F.col(by)))
    seg = F.when(F.col("_outer").isNull(), 0).otherwise(outer * stride + inner)
    return joined.select(*df.columns, seg.cast("int").alias("_seg"))


def _find_cuts(df: DataFrame, hot: Hot, by: str) -> list[tuple]:
    """Quantiles of ``by`` for each hot key, as two levels of lists. Any cuts give right results."""
    base = hot.source if hot.source is not None and by in hot.source.columns else df
    cuts = []
    for lower, size in zip((0,) + _CUT_CLASSES, _CUT_CLASSES):
        rows = [
            r for r in hot.rows
            if lower < math.ceil(r["_n"] / hot.budget) and (math.ceil(r["_n"] / hot.budget) <= size or size == _CUT_CLASSES[-1])
        ]
        if not rows:
            continue
        part = Hot(hot.keys, rows, hot.budget, hot.schema)
        grid = F.array(*[F.lit((i + 1) / (size + 1)) for i in range(size)])
        found = _only(base.select(*hot.keys, by), part).groupBy(*hot.keys).agg(
            F.percentile_approx(by, grid, 10 * (size + 1)).alias("_c"))
        want = {tuple(r[k] for k in hot.keys): math.ceil(r["_n"] / hot.budget) for r in rows}
        for r in found.collect():
            key = tuple(r[k] for k in hot.keys)
            step = max(1, (size + 1) // (want[key] + 1))
            values = sorted(set(r["_c"][step - 1::step]))
            width = max(1, math.isqrt(len(values)))
            groups = [values[i:i + width] for i in range(0, len(values), width)]
            cuts.append(key + ([g[0] for g in groups[1:]], groups))
    return cuts


def _carry(segmented: DataFrame, hot: Hot, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier segments, one row per key and segment of the hot keys."""
    totals = _only(segmented, hot).groupBy(*keys, "_seg").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_seg", *[F.sum(n).over(before).alias(f"_carry_{n}") for n in sums])


def running(df: DataFrame, keys: Sequence[str], by: str, sums: dict[str, Column], hot: Hot | None = None,
            tie: Sequence[str] = ()) -> DataFrame:
    """Running sums per key in order of ``by``. Equal values of ``by`` count together unless ``tie`` breaks them.

    ``hot`` may list hot prefixes of the key: hot payers also serve payer-payee pairs.
    """
    keys = list(keys)
    hot = find_hot(df, keys) if hot is None else hot
    parts = segment(df, hot, by)
    frame = Window.partitionBy(*keys, "_seg").orderBy(by, *tie)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0) if tie else frame.rangeBetween(Window.unboundedPreceding, 0)
    if not hot:
        return parts.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()]).drop("_seg")
    local = parts.select("*", *[F.sum(c).over(frame).alias(f"_local_{n}") for n, c in sums.items()])
    carry = _carry(parts, hot, keys, sums)
    # one row per segment when the key itself is hot; finer keys may have many, so Spark picks the join by size
    joined = local.join(F.broadcast(carry) if keys == hot.keys else carry, keys + ["_seg"], "left")
    out = [F.when(F.col(f"_carry_{n}").isNull(), F.col(f"_local_{n}"))
           .otherwise(F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.col(f"_carry_{n}")).alias(n) for n in sums]
    return joined.select(*df.columns, *out)


def row_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0,
               hot: Hot | None = None) -> DataFrame:
    """Prepare ROWS frames reaching ``before`` rows back and ``after`` rows on.

    Adds ``_chunk`` (add it to the window's partition keys), ``_halo`` (drop these rows after the window) and ``_pos``
    (place within the key, known for hot keys only). Rows with equal ``order[0]`` share a chunk.
    """
    keys, order = list(keys), list(order)
    hot = find_hot(df, keys) if hot is None else hot
    whole = ["*", F.lit(0).alias("_chunk"), F.lit(False).alias("_halo"), F.lit(None).cast("long").alias("_pos")]
    if not hot:
        return df.select(*whole)
    parts = segment(_only(df, hot), hot, order[0])
    # one entry per segment of a hot key: where it starts, and which segments need copies of which of its rows
    sizes = parts.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n")).collect()
    spans: dict[tuple, list] = {}
    for r in sorted(sizes, key=lambda r: r["_seg"]):
        line = spans.setdefault(tuple(r[k] for k in keys), [])
        start = line[-1][2] + 1 if line else 1
        line.append((r["_seg"], start, start + r["_n"] - 1))
    table = []
    for key, line in spans.items():
        for i, (seg, first, last) in enumerate(line):
            targets = [(seg, 0, last, False)]
            for other, start, _ in line[i + 1:]:
                if start - before > last:
                    break
                targets.append((other, start - before, last, True))
            for other, _, end in reversed(line[:i]):
                if end + after < first:
                    break
                targets.append((other, first, end + after, True))
            table.append(key + (seg, first - 1, targets))
    schema = T.StructType(hot.schema.fields + T._parse_datatype_string(
        "_seg int, _base bigint, _to array<struct<chunk:int,lo:bigint,hi:bigint,halo:boolean>>").fields)
    homes = df.sparkSession.createDataFrame(table, schema)
    place = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
    numbered = parts.withColumn("_pos", place).join(F.broadcast(homes), keys + ["_seg"]).withColumn(
        "_pos", F.col("_pos") + F.col("_base"))
    sent = numbered.withColumn("_copy", F.explode(
        F.filter("_to", lambda t: (F.col("_pos") >= t.lo) & (F.col("_pos") <= t.hi))))
    hot_rows = sent.select(*df.columns, F.col("_copy.chunk").alias("_chunk"), F.col("_copy.halo").alias("_halo"), "_pos")
    return _without(df, hot).select(*whole).unionByName(hot_rows)


def chunk_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def shed(df: DataFrame) -> DataFrame:
    """Drop the halo rows and helper columns that ``row_frames`` added."""
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk", "_pos")


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: dict[str, tuple[str, int]],
            hot: Hot | None = None) -> DataFrame:
    """Lag (positive offset) and lead (negative) columns: ``{new: (column, offset)}``."""
    back = max([o for _, o in exprs.values() if o > 0], default=0)
    on = max([-o for _, o in exprs.values() if o < 0], default=0)
    win = chunk_window(keys, order)
    framed = row_frames(df, keys, order, back, on, hot)
    return shed(framed.select("*", *[F.lag(c, o).over(win).alias(n) for n, (c, o) in exprs.items()]))


def trailing(df: DataFrame, keys: Sequence[str], at: str, measures: dict[str, tuple[Column, Column | None]],
             hot: Hot | None = None, inclusive: bool = True) -> DataFrame:
    """Trailing-frame sums. ``measures = {name: (value, last)}``.

    A row with order value ``t`` adds ``value`` to every query point in ``[t, last]`` (``(t, last]`` when not
    inclusive), so ``last = t + width`` gives a trailing sum, ``last = least(next - 1, t + width)`` over the same item a
    trailing distinct count, and ``last = None`` an all-time total.
    """
    keys = list(keys)
    hot = find_hot(df, keys) if hot is None else hot
    start = F.col(at) if inclusive else F.col(at) + 1
    by_last: dict[str, list[str]] = {}
    ends = {n: str(e) for n, (_, e) in measures.items() if e is not None}
    for n, text in ends.items():
        by_last.setdefault(text, []).append(n)
    payload = F.struct(*df.columns)

    def event(when: Column, signs: dict[str, int], row: Column) -> Column:
        deltas = [(F.col(f"_v_{n}") * signs[n] if n in signs else F.lit(None)).cast(types[n]).alias(n) for n in measures]
        return F.struct(when.cast("long").alias("_at"), row.alias("_row"), *deltas)

    values = df.select("*", *[v.alias(f"_v_{n}") for n, (v, _) in measures.items()])
    # decimals that fit a long are summed as whole ticks: the window then stays on primitive values
    ticks = {n: t.scale for n in measures if isinstance(t := values.schema[f"_v_{n}"].dataType, T.DecimalType) and t.precision <= 18}
    values = values.withColumns({f"_v_{n}": (F.col(f"_v_{n}") * 10 ** s).cast("long") for n, s in ticks.items()}) if ticks else values
    types = {n: _wide(values.schema[f"_v_{n}"].dataType) for n in measures}
    nothing = F.lit(None).cast(df.schema)
    if inclusive:
        events = [event(start, {n: 1 for n in measures}, payload)]
    else:
        events = [event(F.col(at), {}, payload), event(start, {n: 1 for n in measures}, nothing)]
    for names in by_last.values():
        events.append(event(measures[names[0]][1] + 1, {n: -1 for n in names}, nothing))
    flat = values.select(*keys, F.explode(F.array(*events)).alias("_e")).select(
        *keys, "_e._at", "_e._row", *[F.col(f"_e.{n}").alias(f"_d_{n}") for n in measures])
    summed = running(flat, keys, "_at", {n: F.col(f"_d_{n}") for n in measures}, hot)
    def shown(n: str) -> Column:
        total = F.coalesce(F.col(n), F.lit(0).cast(types[n]))
        if n in ticks:
            total = (total.cast("decimal(20,0)") / F.lit(10 ** ticks[n])).cast(T.DecimalType(28, ticks[n]))
        return total.alias(n)

    return summed.filter(F.col("_row").isNotNull()).select("_row.*", *[shown(n) for n in measures])


def trailing_peak(df: DataFrame, keys: Sequence[str], item: str, at: str, width: int, name: str,
                  hot: Hot | None = None) -> DataFrame:
    """Per row, the largest number of rows of one ``item`` of the key with ``t - width <= at < t``.

    An item whose live count is n holds levels 1..n. The peak is the number of levels held by at least one item, so it
    is a running sum of the moments at which a level of the key becomes held or free.
    """
    keys = list(keys)
    hot = find_hot(df, keys) if hot is None else hot
    steps = df.select(*keys, item, F.explode(F.array(
        F.struct((F.col(at) + 1).alias("_at"), F.lit(1).cast("long").alias("_d")),
        F.struct((F.col(at) + width + 1).alias("_at"), F.lit(-1).cast("long").alias("_d")))).alias("_e")).groupBy(
        *keys, item, F.col("_e._at").alias("_at")).agg(F.sum("_e._d").alias("_d"))
    live = running(steps, [*keys, item], "_at", {"_n": F.col("_d")}, hot)
    was = F.col("_n") - F.col("_d")
    levels = live.filter(F.col("_d") != 0).select(
        *keys, "_at", F.signum("_d").cast("long").alias("_d"),
        F.explode(F.sequence(F.least(was, F.col("_n")) + 1, F.greatest(was, F.col("_n")))).alias("_level")).groupBy(
        *keys, "_level", "_at").agg(F.sum("_d").alias("_d"))
    held = running(levels, [*keys, "_level"], "_at", {"_n": F.col("_d")}, hot)
    flips = held.select(*keys, "_at", ((F.col("_n") > 0).cast("long") - (F.col("_n") - F.col("_d") > 0).cast("long")).alias("_d"))
    flips = flips.filter(F.col("_d") != 0).select(*keys, "_at", "_d", F.lit(None).cast(df.schema).alias("_row"))
    asks = df.select(*keys, F.col(at).alias("_at"), F.lit(0).cast("long").alias("_d"), F.struct(*df.columns).alias("_row"))
    out = running(asks.unionByName(flips), keys, "_at", {"_peak": F.col("_d")}, hot)
    return out.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_peak").alias(name))


def _wide(t: T.DataType) -> T.DataType:
    if isinstance(t, T.DecimalType):
        return T.DecimalType(28, t.scale)
    return T.LongType() if isinstance(t, T.IntegralType) else t


def ranked_totals(df: DataFrame, by: str, sums: dict[str, Column], per_task: int | None = None,
                  distinct_rows: int | None = None) -> DataFrame:
    """One row per distinct ``by`` with its totals and ``<name>_cum``, the running totals up to and including it.

    ``distinct_rows`` tells that ``df`` already has one row per value, and how many.
    """
    per_task = per_task or segment_rows(df)
    order = Window.partitionBy("_part").orderBy(by)
    if distinct_rows is None:
        table = df.groupBy(by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    else:
        table = df.select(by, *[c.alias(n) for n, c in sums.items()])
    rows, grid = distinct_rows, None
    if rows is None:
        rows = table.filter(F.col(by).isNotNull()).count()
    parts = math.ceil(rows / per_task) if rows else 1
    if parts > 1:  # as many ranges as the values need
        grid = table.agg(F.percentile_approx(by, F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), 20 * parts)).first()[0]
    if parts <= 1:
        # fewer than per_task distinct values: one task takes them all
        done = table.withColumn("_part", F.lit(0))
        return done.select(by, *sums, *[F.sum(n).over(order).alias(f"{n}_cum") for n in sums])
    cuts = sorted(set(grid))
    marks = F.array(*[F.lit(c).cast(df.schema[by].dataType) for c in cuts])
    split = table.withColumn("_part", F.size(F.filter(marks, lambda c: c <= F.col(by))))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = split.groupBy("_part").agg(*[F.sum(n).alias(n) for n in sums]).select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    joined = split.join(F.broadcast(carry), "_part")
    return joined.select(by, *sums, *[(F.sum(n).over(order) + F.col(f"_c_{n}")).alias(f"{n}_cum") for n in sums])


def quantiles(df: DataFrame, column: str, ps: Sequence[float]) -> list[float]:
    """Exact interpolated quantiles of a column, without holding its values in one task.

    The counts per distinct value are kept while the ranks are looked up, so ``df`` runs once.
    """
    known = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    table = df.filter(known).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        rows, total = table.agg(F.count(F.lit(1)), F.sum("_n")).first()
        if not rows:
            return [float("nan")] * len(ps)
        spots = sorted({i for p in ps for i in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
        ranks = ranked_totals(table, column, {"_n": F.col("_n")}, distinct_rows=rows)
        hit = F.filter(F.array(*[F.lit(i).cast("long") for i in spots]),
                       lambda i: (i < F.col("_n_cum")) & (i >= F.col("_n_cum") - F.col("_n")))
        got = ranks.select(F.col(column).cast("double").alias("v"), hit.alias("at")).filter(F.size("at") > 0).collect()
    finally:
        table.unpersist()
    found = {i: r["v"] for r in got for i in r["at"]}
    out = []
    for p in ps:
        x = p * (total - 1)
        a, b = found[math.floor(x)], found[math.ceil(x)]
        out.append(a + (b - a) * (x - math.floor(x)))
    return out


def group_quantile(df: DataFrame, keys: Sequence[str], column: str, p: float, name: str) -> DataFrame:
    """Exact interpolated quantile per key: distinct values are counted first, hot keys are segmented."""
    keys = list(keys)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    hot = find_hot(df, keys)
    ranks = running(counts, keys, column, {"_cum": F.col("_n")}, hot)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    spot = (F.col("_total") - 1) * F.lit(p)
    low, high = F.floor(spot), F.ceil(spot)
    inside = lambda i: (i < F.col("_cum")) & (i >= F.col("_cum") - F.col("_n"))
    value = F.col(column).cast("double")
    picked = ranks.join(totals, keys).filter(inside(low) | inside(high)).groupBy(*keys).agg(
        F.max(F.when(inside(low), value)).alias("_a"), F.max(F.when(inside(high), value)).alias("_b"),
        F.max(spot - low).alias("_f"))
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))
