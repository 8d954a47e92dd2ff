"""Ranked search against scoring every pair, and the defined edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np

from riskflow.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def said(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(key, Counter(said(text))) for key, text in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    own = {}
    for item, text in items:
        own.setdefault(item, set()).update(said(text))
    out = set()
    for item, terms in own.items():
        scores = []
        for key, c, n in counts:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out |= {(item, i + 1, None if null else key, -s) for i, (s, null, key) in enumerate(sorted(scores)[:k])}
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_equals_all_pairs_in_many_trees_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÜNDER", "a1"]
    zipf = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, zipf, k=rng.randrange(1, 60)))) for i in range(900)]
    docs += [(900 + i, docs[i % 7][1]) for i in range(60)]  # ties
    items = [(i, ", ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(45)]
    monkeypatch.setattr(dual_tree, "BATCH", 150)
    got = dual_tree.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                           spark.createDataFrame(items, "item_id long, text string"), block=80)
    assert rows(got) == brute(docs, items)


def test_bounds_spare_most_pairs_of_leaves():
    rng = np.random.default_rng(1)
    vocabulary, docs = 640, 4096
    topic = rng.integers(0, 64, docs)
    owner = np.repeat(np.arange(docs), 8)
    term = (np.repeat(topic, 8) * 10 + np.tile(np.arange(8), docs)).astype(np.int64)
    value = rng.integers(1, 90_000, len(owner))
    items = dual_tree.Items([list(range(t * 10, t * 10 + 8)) for t in range(64)], [5000 + i for i in range(vocabulary)])
    best = dual_tree.Best(items, 10)
    scored = dual_tree.search(items, best, list(range(docs)), owner, term, value)
    assert scored < 0.3 * (docs // dual_tree.LEAF) * items.leaves
    w = np.array([5000 + i for i in range(vocabulary)])
    score = np.add.reduceat(value * w[term], np.arange(0, len(owner), 8))
    for place, mine in enumerate(best.found):
        t = items.order[place]
        want = sorted((-int(score[d]), d) for d in np.flatnonzero(topic == t))[:10]
        assert [(s, d) for s, _, d in mine] == want


def test_edge_cases(spark):
    docs = [(5, "same words here"), (3, "SAME words, here!"), (None, "same words here"), (4, None), (6, ""), (7, " ,;\n"), (3, "same words here"),
            (8, "long " * 60_000 + "words"), (9, "nothing in common")]
    items = [(1, "same words"), (1, "HERE"), (2, None), (3, ""), (None, "words"), (4, "absent"), (1, "same")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    found = dual_tree.ranked(d, i).collect()
    assert {tuple(r) for r in found} == brute(docs, items)
    assert [(r["doc_id"], r["rank"]) for r in sorted((r for r in found if r["item_id"] == 1), key=lambda r: r["rank"])][:4] == [(3, 1), (3, 2), (5, 3), (None, 4)]
    assert dual_tree.ranked(d.limit(0), i).count() == 0 == dual_tree.ranked(d, i.limit(0)).count()
    assert dual_tree.ranked(d, i, k=1).groupBy("item_id").count().filter("count > 1").count() == 0


def test_terms():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x3000)])) for _ in range(40))
        assert [t.decode() for t in dual_tree.terms(text.encode())] == said(text)
