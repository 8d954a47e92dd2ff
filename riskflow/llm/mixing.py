"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source queues its documents in a shuffled order. A document's virtual finish time is the number of words its source has
queued up to its end, divided by the source's target; a source whose target exceeds its size queues its documents again, up
to ``repeats`` times. Sorting all copies by finish time serves the sources in proportion to their targets at every point,
and the mix ends where the budget is used up.

Neither a hot source nor the whole queue is ever one task's work: both running sums are taken over ranges (of the shuffle
key within a source, of virtual time over all) whose number follows the number of rows, with the totals of earlier ranges added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import WORD, buckets, fresh

HEX = 4  # hex digits of the shuffle key that choose a range: up to 65,536 ranges


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(cycle: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights for sources numbered by ``_rank`` from 0: the cycle, repeating."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.col("_rank"), F.lit(len(cycle))) + 1).cast("int"))


def source_targets(sizes: DataFrame, source: str, weight: Column, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    ``weight`` is an expression over the source column and ``_rank``, its place by code point with null last. Together the
    sources get ``share`` of all words. A target stops at ``repeats`` times its source's size and the excess goes to the
    others by weight: sources are filled in the order of size per weight, so one pass over the list of sources solves it.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1).withColumn("_weight", weight)
    cap = F.col("source_size") * F.lit(float(repeats))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    open_level = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.col("_level"))).over(Window.partitionBy())
    return (ranked.withColumn("_cap", cap).withColumn("_level", level).withColumn("_level", open_level)
            .select(source, "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap"))).alias("target")))


def _running(rows: DataFrame, keys: list[str], cell: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` up to and with each row, per ``keys``, over consecutive cells that are summed on their own."""
    totals = rows.groupBy(*keys, cell).agg(F.sum(value).alias("_cell_total"))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_at_{k}") for k in keys], F.col(cell).alias("_at_cell"),
                           F.coalesce(F.sum("_cell_total").over(earlier), F.lit(0)).alias("_start"))
    same = F.col(cell) == F.col("_at_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    within = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_sum", F.sum(value).over(within))
    return summed.join(starts, same).withColumn(out, F.col("_start") + F.col("_sum")).drop(
        "_sum", "_start", "_at_cell", *[f"_at_{k}" for k in keys])


@dataclass
class Mix:
    """What a mix decides. ``queued``: a row per document with _shuffle, size, source_size, target, _end (words of its source
    up to its end) and ``copies``; ``schedule``: a row per copy that may be served, with its finish time and the words served
    up to its end; the mix is the part of it up to ``budget`` words."""

    queued: DataFrame
    schedule: DataFrame


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
             share: float = 1.0, repeats: int = 3) -> Mix:
    """Queue all documents and decide how often each is taken.

    The shuffle is by md5 of the key, so reruns agree. Null texts and texts without words have size 0 and are never taken;
    null sources are one source. Rows that repeat a key are separate documents with the same place in the shuffle. No rows
    in, no rows out.
    """
    weight = cyclic_weights() if weight is None else weight
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(text).alias("size"))
    ranges = min(16**HEX, buckets(docs.count()))
    place = F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("_shuffle", place).withColumn(
        "_range", F.floor(F.conv(F.substring("_shuffle", 1, HEX), 16, 10).cast("long") * ranges / 16**HEX))
    targets = source_targets(rows.select("_source", "size"), "_source", weight, share, repeats)
    budget = targets.agg(F.floor(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share))).alias("_budget"))
    queued = _running(rows, ["_source"], "_range", [F.col("_shuffle"), F.col("size"), F.col("_key")], "size", "_end").drop("_range")
    named = targets.select(F.col("_source").alias("_of"), "source_size", "target")
    queued = queued.join(named, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")

    finish = F.col("_round") * F.col("source_size") + F.col("_end")
    rounds = F.sequence(F.lit(0), F.least(F.lit(repeats - 1), F.floor(F.col("target") / F.col("source_size")).cast("int")))
    copies = (queued.filter("size > 0").withColumn("_round", F.explode(rounds))
              .withColumn("finish", finish / F.col("target")).withColumn("_name", F.coalesce("_source", F.lit("")))
              .withColumn("_tick", F.floor(F.col("finish") * ranges)))
    order = [F.col(c) for c in ("finish", "_shuffle", "_name", "_round", "_key")]
    served = _running(copies, [], "_tick", order, "size", "served")
    last = (served.crossJoin(F.broadcast(budget)).filter("served <= _budget")  # one row
            .agg(F.max(F.struct("finish", "_shuffle", "_name", "_round")).alias("_last")))
    taken = F.size(F.filter(rounds, lambda r: F.struct(
        ((r * F.col("source_size") + F.col("_end")) / F.col("target")).alias("finish"), F.col("_shuffle"),
        F.coalesce("_source", F.lit("")).alias("_name"), r.alias("_round")) <= F.col("_last")))
    decided = queued.crossJoin(F.broadcast(last)).withColumn(
        "copies", F.when((F.col("size") > 0) & F.col("_last").isNotNull(), taken).otherwise(0)).drop("_last")
    return Mix(decided, served)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
                share: float = 1.0, repeats: int = 3) -> DataFrame:
    """Per document: (key, size, source_size, target of its source, copies, taken = words the mix takes of it)."""
    mix = plan_mix(docs, key, text, source, weight, share, repeats)
    return mix.queued.select(F.col("_key").alias(key), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
                             (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
                    share: float = 1.0, repeats: int = 3) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they were. Rows that repeat key and size all get the
    mean of their copies, rounded up."""
    n, k, words, of = fresh(docs, "_copies", "_mix_key", "_mix_size", "_mix_rows")
    per_key = (mix_sources(docs, key, text, source, weight, share, repeats)
               .groupBy(F.col(key).alias(k), F.col("size").alias(words)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(of))
               .filter(F.col(n) > 0))
    joined = docs.join(per_key, F.col(key).eqNullSafe(F.col(k)) & (word_count(text) == F.col(words)))
    times = F.ceil(F.col(n) / F.col(of)).cast("int")
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
