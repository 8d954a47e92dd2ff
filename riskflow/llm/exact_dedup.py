"""Exact de-duplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space. Rows are combined
three times, and every time the whole normalised text is part of the grouping key:

1. within each input task (the map side of the first aggregate), so a group that holds a third of all rows leaves a task
   as one row;
2. within each (digest, salt), after the first shuffle;
3. over the salts of a digest, after the second shuffle.

Rows are then labelled by digest alone, but only for digests that stage 3 has seen with exactly one content; the contents of
any other digest are compared again, row by row. So no result rests on a digest being free of collisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import SPACE, fresh, told_apart
from riskflow.session import cut

SALTS = 32


def normalised(text: str = "text") -> Column:
    """The text with white space collapsed; a null text counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _labelled(rows: DataFrame, classes: DataFrame, collided: DataFrame | None) -> DataFrame:
    """``rows`` (with _digest, _content) and their class's _keep and _size."""
    out = rows.drop("_content").join(classes, "_digest")
    if collided is None:
        return out
    return out.unionByName(rows.join(collided, ["_digest", "_content"]).drop("_content"))


def content_classes(rows: DataFrame, key: str, salts: int = SALTS) -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal ``_content`` as (_digest, _keep = smallest key, _size), and those of colliding digests with _content."""
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64(key), F.lit(salts)).alias("_salt"), "_content").agg(
        F.min(key).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    whole = salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    per_digest = cut(whole.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents"), F.min("_keep").alias("_keep"),
                                                 F.sum("_size").alias("_size")))
    classes = per_digest.filter("_contents = 1").drop("_contents")
    several = per_digest.filter("_contents > 1").select("_digest")
    return classes, None if several.isEmpty() else whole.join(several, "_digest", "left_semi")


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: (key, keep_id, group_size, kept, digest).

    The row with the smallest key of its group stays. Null texts are empty texts. A null key is larger than any other; of
    rows that repeat key and content, one stays. Other columns of ``docs`` are not read. No rows in, no rows out.
    """
    rows = docs.select(F.col(key).alias("_key"), normalised(text).alias("_content")).withColumn("_digest", digest(F.col("_content")))
    classes, collided = content_classes(rows, "_key", salts)
    if collided is None:  # rows that repeat key and digest are alike: count them, and write them out again at the end
        members = rows.groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("_times"))
        out = members.join(classes, "_digest")
    else:
        members = rows.groupBy("_key", "_digest", "_content").agg(F.count(F.lit(1)).alias("_times"))
        out = _labelled(members, classes, collided)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(
        F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_key").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"), F.col("_digest").alias("digest"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """``docs`` without the rows that repeat an earlier content; columns as they were. Same rules as ``duplicate_groups``."""
    d, c, k, of, keep, content = fresh(docs, "_row_digest", "_row_content", "_row_key", "_of_digest", "_of_key", "_of_content")
    rows = docs.withColumn(c, normalised(text)).withColumn(d, digest(F.col(c))).withColumn(k, told_apart(key))
    classes, collided = content_classes(rows.select(F.col(key).alias("_key"), F.col(c).alias("_content"), F.col(d).alias("_digest")), "_key", salts)
    same = (F.col(d) == F.col(of)) & (F.col(k) == F.col(keep))
    one = classes.select(F.col("_digest").alias(of), told_apart("_keep").alias(keep))
    kept = rows.drop(c).join(one, same, "left_semi").dropDuplicates([d, k])  # where the join has put them
    if collided is not None:
        one = collided.select(F.col("_digest").alias(of), told_apart("_keep").alias(keep), F.col("_content").alias(content))
        more = rows.join(one, same & (F.col(c) == F.col(content)), "left_semi")
        kept = kept.unionByName(more.dropDuplicates([d, c, k]).drop(c))
    return kept.drop(d, k)
