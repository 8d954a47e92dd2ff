import hashlib
import re

from pyspark.sql import functions as F

from riskflow.llm import mixing


def brute(rows, cycle=(1, 2, 3), repeats=3):
    """Targets by iterated resharing, the mix by one sort."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = [(k, s, size(t), hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()) for k, t, s in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {n: sum(d[2] for d in docs if d[1] == n) for n in names}
    weight = {n: cycle[i % len(cycle)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if repeats * total[n] < level * weight[n]]
        for n in full or open_:
            target[n] = float(repeats * total[n]) if full else level * weight[n]
        left -= sum(target[n] for n in full)
        open_ = open_ - set(full) if full else set()
    copies, served = [], 0
    for n in names:
        at = 0
        for d in sorted((d for d in docs if d[1] == n), key=lambda d: (d[3], d[2])):
            at += d[2]
            copies += [((r * total[n] + at) / target[n], d[3], n or "", r, d) for r in range(repeats) if d[2] and r <= target[n] // total[n]]
    taken = []
    for c in sorted(copies, key=lambda c: c[:4]):
        served += c[4][2]
        if served <= sum(total.values()):
            taken.append((c[4][0], c[4][2]))
    return target, total, sorted(taken, key=repr)


def test_matches_brute_force(spark, odd, none):
    got = mixing.mix_sources(odd).collect()
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    target, total, taken = brute(rows)
    assert sorted([(r.doc_id, r.size) for r in got for _ in range(r.copies)], key=repr) == taken
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()} and all(r.taken == r.size * r.copies for r in got)
    assert len(got) == len(rows) and mixing.mix_sources(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and mixing.mixed_documents(none).count() == 0


def test_hot_source_gets_its_share_and_reruns_agree(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"),
                                      F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    out = mixing.mix_sources(docs).join(docs.drop("text"), "doc_id").cache()
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= 200 and r.g <= 3 * r.s for r in per)
    assert out.filter("taken > 3 * size").count() == 0
    again = mixing.mix_sources(docs.repartition(13))
    assert again.select("doc_id", "taken").exceptAll(out.select("doc_id", "taken")).count() == 0
    assert "Python" not in again._jdf.queryExecution().toString()
