import numpy as np
from pyspark.sql import functions as F

from riskflow.llm import toxicity
from riskflow.llm.common import remainder, table


def random_index(rng, n=500, near=7):
    names = [b"w%d" % i for i in range(300)]
    rows = [(i, int(i % 3 == 0), [names[j] for j in np.unique(rng.integers(0, 300, 20))]) for i in range(n)]
    rows = [(*r, rng.integers(1, 4, len(r[2])).tolist()) for r in rows]
    return rows, toxicity.build(rows, ({w: float(rng.random() + 0.1) for w in names}, {0: 0.6, 1: 0.4}), near)


def test_nearest_are_exact():
    rows, index = random_index(np.random.default_rng(1))
    queries = index.vectors([(r[2], r[3]) for r in rows][:200] + [([], []), ([b"other"], [1])])
    who, cos = index.nearest(queries, 7)
    every = queries @ np.hstack(index.lists)
    for i, row in enumerate(every):
        want = np.lexsort((np.arange(len(row)), -row))[:7]
        assert np.allclose(row[want], cos[i], atol=1e-6)
    assert (who[-2:] == -1).all() and ((0 <= index.score(queries)[0]) & (index.score(queries)[0] <= 1)).all()


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)).join(labels.select("doc_id", "toxic"), "doc_id")
    held = out.filter(remainder("doc_id", 4) == 2).select("score", "toxic").toPandas()
    rank = held["score"].rank().to_numpy()
    toxic = held["toxic"].to_numpy() == 1
    n = toxic.sum()
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * (~toxic).sum()) > 0.93


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 0), (9, 1), (7, None), (None, 1), (8, None)], "doc_id long, toxic int")
    index = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, index).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.fit(none, labels, F.lit(True)) is None and toxicity.score(none, index).count() == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
