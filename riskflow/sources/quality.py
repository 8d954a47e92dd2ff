"""Row validation, profiling, history, entity resolution, screening and request de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators import ordered as od
from riskflow.sources.transactions import REQUIRED


def failed_rules(tx: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Add ``failed``: names of the rules a row breaks."""
    rules = [F.when(F.col(c).isNull(), f"{c}_missing") for c in required if c in tx.columns]
    rules.append(F.when(F.col("amount") <= 0, "amount_not_positive"))
    for c, limit in (("geo_lat", 90), ("geo_lng", 180)):
        if c in tx.columns:
            rules.append(F.when(~F.col(c).between(-limit, limit), f"{c}_out_of_range"))
    return tx.withColumn("failed", F.filter(F.array(*rules), lambda r: r.isNotNull()))


def validate(tx: DataFrame, required: Sequence[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Good rows, and quarantined rows with the rules they break."""
    checked = failed_rules(tx, required)
    return checked.filter(F.size("failed") == 0).drop("failed"), checked.filter(F.size("failed") > 0)


def dq_profile(df: DataFrame, limit: float = 0.05, exact: bool = True) -> DataFrame:
    """Per column: null share, distinct values, minimum and maximum (as text), and whether the share is acceptable.

    ``exact=False`` sketches the distinct counts, which avoids expanding the rows once per column.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"),
                 F.max(c).cast("string").alias(f"hi{i}")]
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("distinct_values"),
                               F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum")) for i, c in enumerate(cols)])
    long = df.agg(*aggs).select("_rows", F.explode(items).alias("i")).select("_rows", "i.*")
    share = 1 - F.col("n") / F.col("_rows")
    return long.select("column", share.alias("null_rate"), "distinct_values", "minimum", "maximum",
                       (share < limit).alias("acceptable"))


def scd2(snapshots: DataFrame, key: str, attrs: Sequence[str], ts: str, tie: str) -> DataFrame:
    """History rows with validity intervals: one per run of unchanged attributes."""
    state = F.to_json(F.struct(*attrs), {"ignoreNullFields": "false"})
    base = snapshots.withColumn("_state", state)
    hot = od.find_hot(snapshots, [key])
    seen = od.shifted(base, [key], [ts, tie], {"_old": ("_state", 1)}, hot)
    changed = seen.filter(F.col("_old").isNull() | (F.col("_old") != F.col("_state"))).drop("_old", "_state")
    out = od.shifted(changed, [key], [ts, tie], {"valid_to": (ts, -1)}, hot)
    return out.select(key, *attrs, F.col(ts).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def normalise(col) -> F.Column:
    """Identifier with case, punctuation and blanks removed; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(col)), "[^A-Z0-9]", ""), F.lit(""))


def resolve_entities(df: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """Give rows that share any normalised key, directly or through others, one ``entity_id``."""
    from riskflow.operators.graph import components

    keyed = F.array(*[F.when(normalise(F.col(k)).isNotNull(), F.concat(F.lit(f"key:{k}:"), normalise(F.col(k)))) for k in keys])
    links = df.select(F.concat(F.lit("id:"), F.col(ident).cast("string")).alias("src"),
                      F.explode(F.filter(keyed, lambda x: x.isNotNull())).alias("dst")).distinct()
    groups = components(links).filter(F.col("id").startswith("id:"))
    named = groups.groupBy("component").agg(F.min("id").alias("entity_id")).join(groups, "component")
    out = df.join(named.select(F.substring("id", 4, 1 << 30).alias("_id"), F.substring("entity_id", 4, 1 << 30).alias("entity_id")),
                  F.col(ident).cast("string") == F.col("_id"), "left").drop("_id")
    return out.withColumn("entity_id", F.coalesce("entity_id", F.col(ident).cast("string")))


def screen(tx: DataFrame, watchlist: DataFrame, ident: str = "entity_id", kind: str = "list_type") -> DataFrame:
    """Flag transactions whose payer or payee is listed. Spark broadcasts the list when its size allows."""
    listed = watchlist.groupBy(F.col(ident).alias("_id")).agg(F.min(kind).alias("_kind"))
    payer, payee = (listed.select(F.col("_id").alias(c), F.col("_kind").alias(f"{c[:5]}_list")) for c in ("payer_id", "payee_id"))
    out = tx.join(payer, "payer_id", "left").join(payee, "payee_id", "left")
    return out.withColumn("watchlist_hit", F.col("payer_list").isNotNull() | F.col("payee_list").isNotNull())


def request_hash(columns: Sequence[str]):
    """Hash of the request as JSON: NULL, an empty text and texts with separators are all told apart."""
    return F.md5(F.to_json(F.struct(*columns)))


def dedup_requests(df: DataFrame, columns: Sequence[str], ts: str, ttl: int, tie: str) -> DataFrame:
    """Mark requests whose content was computed at most ``ttl`` ago: those reuse that result, and don't prolong its life.

    Requests further apart than ``ttl`` start afresh, so the rows of a content are first cut into spells at such gaps. A spell is read
    in order of time, with the time of the last computed result as the only state.
    """
    hashed = df.withColumn("request_hash", request_hash(columns))
    gaps = od.shifted(hashed, ["request_hash"], [ts, tie], {"_last": (ts, 1)})
    starts = F.when(F.col(ts) - F.col("_last") <= ttl, 0).otherwise(1).cast("long")
    spells = od.running(gaps.withColumn("_starts", starts), ["request_hash"], ts, {"_spell": F.col("_starts")}, tie=[tie]).drop("_last", "_starts")
    out = T.StructType([*df.schema.fields, T.StructField("request_hash", T.StringType()), T.StructField("reused", T.BooleanType())])

    def read(batches):
        spell, computed = None, None
        for pdf in batches:
            reused = []
            for own, at in zip(zip(pdf["request_hash"], pdf["_spell"]), pdf[ts]):
                if own != spell or at - computed > ttl:
                    spell, computed = own, at
                    reused.append(False)
                else:
                    reused.append(True)
            yield pdf.drop(columns="_spell").assign(reused=reused)

    return spells.repartition("request_hash", "_spell").sortWithinPartitions("request_hash", "_spell", ts, tie).mapInPandas(read, out)
