import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from riskflow.llm import exact_dedup


def expected(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    out = []
    for content, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        first = known[0] if known else None
        left = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = left and i == first
            left = left and not kept
            out.append((i, first, len(ids), kept, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force_and_keeps_columns(spark, odd, none):
    got = exact_dedup.duplicate_groups(odd, salts=3)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(odd)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r[3] for r in expected(odd))
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_colliding_digests_are_told_apart_by_content(odd):
    weak = lambda c: (F.length(c) % 3).cast("string")
    drop = lambda rows: sorted([r[:4] for r in rows], key=repr)
    assert drop(map(tuple, exact_dedup.duplicate_groups(odd, digest=weak).collect())) == drop(expected(odd))
    assert exact_dedup.drop_copies(odd, digest=weak).count() == sum(r[3] for r in expected(odd))


def test_large_group_of_copies(spark):
    docs = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("doc_id"), F.when(F.col("id") % 3 > 0, "same  text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = exact_dedup.duplicate_groups(docs)
    assert out.filter("kept").count() == docs.select("text").distinct().count()
    assert out.agg(F.max("group_size")).first()[0] == docs.filter("text = 'same  text'").count()
