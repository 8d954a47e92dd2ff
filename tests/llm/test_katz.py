import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import katz

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.c = Counter(w for t in texts for w in t)
        self.pairs = Counter((a, b) for t in texts for a, b in zip([END] + t, t))
        seen = lambda cc: [0.0] + [float(sum(v == r for v in cc.values())) for r in range(1, katz.KATZ + 2)]
        self.words, self.d = katz.Words(sum(self.c.values()), len(self.c), seen(self.c)), katz.discounts(seen(self.pairs))
        self.after = defaultdict(dict)
        for (a, b), n in self.pairs.items():
            self.after[a][b] = n

    def alone(self, w):
        return float(self.words.of(np.array([self.c.get(w, 0)]))[0])

    def probability(self, w, h):
        own = self.after.get(h)
        if not own:
            return self.alone(w)
        d = lambda n: self.d[n] if n < len(self.d) else 1.0
        total, factor = sum(own.values()), 1.0
        share = sum(d(n) * n for n in own.values()) / total
        if share > 1 - 1e-12:
            factor = share = total / (total + 1)
        if w in own:
            return factor * d(own[w]) * own[w] / total
        return (1 - share) / (1 - sum(self.alone(x) for x in own)) * self.alone(w)


def words(text):
    return (text or "").encode().translate(LOWER).split() + [END]


def compare(docs, learn, keep):
    rows = docs.select("doc_id", "text").collect()
    model = Plain([words(r.text) for r in rows if keep(r)])
    tokens, distinct = sum(model.c.values()), len(model.c)
    want = []
    for r in rows:
        own = words(r.text)
        want.append((r.doc_id or 0, len(own), sum(w in model.c for w in own), tokens,
                     sum(math.log10((model.c.get(w, 0) + 0.5) / (tokens + 0.5 * (distinct + 1))) for w in own),
                     sum(math.log10(model.probability(w, h)) for h, w in zip([END] + own, own))))
    got = sorted((r.doc_id or 0, *r[1:]) for r in katz.score(docs, learn).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 and abs(g[5] - w[5]) < 1e-6
    return model


def test_matches_dictionaries_and_sums_to_one(spark, odd, none, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 60)  # many chunks and partitions
    model = compare(odd, F.col("doc_id") < 9, lambda r: r.doc_id is not None and r.doc_id < 9)
    for h in (END, b"the", b"never"):
        assert abs(sum(model.probability(w, h) for w in model.c) + model.probability(b"unseen!", h) - 1) < 1e-9
    assert katz.score(none, F.lit(True)).count() == 0


def test_without_training_rows(odd):
    got = katz.score(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in got)


def test_hot_histories(spark, monkeypatch):
    monkeypatch.setattr(katz, "HOT", 0.01)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), (F.col("id") % 37).cast("string"), F.lit("the"),
                                                                            (F.col("id") % 11).cast("string"), F.lit("of")).alias("text"))
    compare(docs, F.col("doc_id") % 5 != 1, lambda r: r.doc_id % 5 != 1)


def test_discounts_fall_back():
    assert np.allclose(katz.discounts([0, 0, 0, 0, 0, 0, 0]), [1, 0.5])
    assert all(0 < x <= 1 for x in katz.discounts([0, 100, 40, 20, 12, 8, 6]))


class Longer(Plain):
    """The model of any order by dictionaries, one recursion per word."""

    def __init__(self, texts, order):
        super().__init__(texts)
        self.grams = {n: Counter(tuple(([END] + t)[i : i + n]) for t in texts for i in range(len(t) + 2 - n)) for n in range(2, order + 1)}
        self.cut = {n: katz.discounts([0.0] + [float(sum(v == r for v in c.values())) for r in range(1, katz.KATZ + 2)]) for n, c in self.grams.items()}
        self.following = defaultdict(dict)
        for c in self.grams.values():
            for g, times in c.items():
                self.following[g[:-1]][g[-1]] = times

    def after_history(self, w, h):
        own = self.following.get(h)
        if not h:
            return self.alone(w)
        if not own:
            return self.after_history(w, h[1:])
        d = lambda n: self.cut[len(h) + 1][n] if n < len(self.cut[len(h) + 1]) else 1.0
        total, factor = sum(own.values()), 1.0
        share = sum(d(n) * n for n in own.values()) / total
        if share > 1 - 1e-12:
            factor = share = total / (total + 1)
        if w in own:
            return factor * d(own[w]) * own[w] / total
        return (1 - share) / (1 - sum(self.after_history(x, h[1:]) for x in own)) * self.after_history(w, h[1:])


@pytest.mark.parametrize("order", [3, 4])
def test_longer_histories_back_off_word_by_word(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "CHUNK", 300)  # many chunks
    monkeypatch.setattr(katz, "HOT", 0.01)  # some histories of two words are dealt by n-gram
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["the", "cat"] * int(rng.integers(0, 3)) + [f"w{int(x)}" for x in rng.geometric(0.15, int(rng.integers(0, 25)))])) for i in range(150)]
    docs = spark.createDataFrame(rows + [(150, None)], "doc_id long, text string")
    texts = {i: words(t) for i, t in rows + [(150, None)]}
    model = Longer([t for i, t in texts.items() if i % 5 != 1], order)
    got = {r.doc_id: r.score for r in katz.score(docs, F.col("doc_id") % 5 != 1, order=order).collect()}
    for i, t in texts.items():
        full = [END] + t
        want = sum(math.log10(model.after_history(w, tuple(full[max(0, j + 2 - order) : j + 1]))) for j, w in enumerate(t))
        assert abs(got[i] - want) < 1e-6, i
    for h in ((END, b"the"), (b"the", b"cat"), (b"w1", b"w2")):
        assert abs(sum(model.after_history(w, h) for w in model.c) + model.after_history(b"unseen!", h) - 1) < 1e-9


def test_query_uses_more_than_one_word_of_history(spark, monkeypatch):
    from riskflow.llm import queries

    seen = {}
    monkeypatch.setattr(katz, "score", lambda docs, learn, **more: seen.update(more) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.op5_katz(spark, "/root/testdata/sf0.001")
    assert seen["order"] >= 3
