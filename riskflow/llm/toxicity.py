"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts is the collection of examples, as TF-IDF vectors over the words that tell the labels apart
best in it (by the chi-squared statistic); document frequencies are counted over all documents. Examples are kept in blocks, each with inverted
lists of its own and, per word, the largest weight in the block. Those give an upper bound of the cosine with anything in the
block, so a batch of texts looks into its best blocks first and only into those others whose bound beats its k-th similarity so
far: the k nearest are exact. Their votes, weighted by closeness, are calibrated on the examples' own votes with each left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskflow.llm.sampling import label_counts, sample_by_label

EXAMPLES, TERMS, NEIGHBOURS, BLOCK, LEAST, STEM = 4000, 1000, 25, 64, 8, 4
#: Letters, digits, the apostrophe and all bytes beyond ASCII make words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def words(data: bytes | None) -> list[bytes]:
    """The words of a text in lower case and, as words of their own, the stems (first ``STEM`` letters) of longer ones."""
    found = (data or b"").decode("utf-8", "replace").lower().encode().translate(_TABLE).decode().split(" ")
    return [w.encode() for w in found if w] + [b"~" + w[:STEM].encode() for w in found if len(w) > STEM]


def informative(sets: list[set], labels: np.ndarray, terms: int = TERMS, least: int = LEAST) -> list[bytes]:
    """The ``terms`` words, found in ``least`` examples at least, whose presence depends most on the label."""
    inside, outside = (Counter(w for s, y in zip(sets, labels) if y == side for w in s) for side in (1, 0))
    n, p = len(labels), int(labels.sum())
    names = sorted(w for w in inside.keys() | outside.keys() if inside[w] + outside[w] >= least)
    a = np.array([inside[w] for w in names], float)
    have = a + np.array([outside[w] for w in names], float)
    expected = have * p / n
    spread = expected * (1 - p / n) * (1 - have / n)
    order = np.argsort(-((a - expected) ** 2 / np.maximum(spread, 1e-9)), kind="stable")[:terms]
    return sorted(names[i] for i in order)


@dataclass
class Index:
    """Examples in blocks. ``lists[b]``: their weights by word (words x examples of the block); ``bound``: words x blocks."""

    place: dict
    idf: np.ndarray
    keys: list
    labels: np.ndarray
    lists: list[np.ndarray]
    bound: np.ndarray
    near: int
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def vectors(self, counted: list[tuple[list[bytes], list[int]]]) -> np.ndarray:
        """Unit TF-IDF vectors (or zeros) of texts given as words and how often each occurs."""
        out = np.zeros((len(counted), len(self.idf)), np.float32)
        for i, (names, times) in enumerate(counted):
            got = [(self.place[w], n) for w, n in zip(names, times) if w in self.place]
            if got:
                at, n = np.array(got).T
                out[i, at] = (1 + np.log(n)) * self.idf[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def nearest(self, queries: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples of each query and their cosines, exactly; ties go to the earlier example.

        ``without``: an example that each query doesn't see.
        """
        bounds = queries @ self.bound
        best = np.zeros((len(queries), k), np.float32)
        who = np.full((len(queries), k), -1)

        def look(b: int, q: np.ndarray) -> None:
            cos = queries[q] @ self.lists[b]
            ids = np.broadcast_to(np.arange(cos.shape[1]) + b * BLOCK, cos.shape)
            if without is not None:
                cos = np.where(ids == without[q][:, None], 0, cos)
            both, names = np.hstack([best[q], cos]), np.hstack([who[q], np.where(cos > 0, ids, -1)])
            first = np.lexsort((np.where(names < 0, 1 << 30, names), -both), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)

        own = bounds.argmax(axis=1) if bounds.shape[1] else np.empty(0, np.int64)
        for b in np.unique(own):  # each query's best block first
            look(b, np.flatnonzero((own == b) & (bounds[:, b] > 0)))
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            q = np.flatnonzero((own != b) & (bounds[:, b] > 0) & (bounds[:, b] + 1e-6 >= best[:, -1]))
            if len(q):
                look(b, q)
        return who, best

    def votes(self, who: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Share of label 1 among neighbours, each weighted by its cosine to the fourth; 0 without neighbours."""
        weight = np.where(who >= 0, cos.astype(float) ** 4, 0)
        return (weight * self.labels[who]).sum(1) / np.maximum(weight.sum(1), 1e-12)

    def score(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, cos = self.nearest(queries, self.near)
        raw = self.votes(who, cos)
        return 0.99 * np.interp(raw, *self.curve) + 0.01 * raw, who, cos


def _monotone(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on votes by pooling neighbours, as points to interpolate between."""
    pools: list[list[float]] = []
    for x, y, w in sorted(zip(raw.tolist(), label.tolist(), weight.tolist())):
        pools.append([x * w, y * w, w, x, x])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][4] == pools[-1][3]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2], pools[-1][3], last[4]]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def build(examples: list[tuple], shares: dict, near: int = NEIGHBOURS) -> Index:
    """Index of examples (key, label, words, times) over the words of ``shares``, their idf, calibrated to the labels' ``shares['']``."""
    idf, population = shares
    place = {w: i for i, w in enumerate(sorted(idf))}
    index = Index(place, np.array([idf[w] for w in sorted(idf)]), [], np.array([]), [], np.array([]), near)
    vectors = index.vectors([(e[2], e[3]) for e in examples])
    order = np.lexsort((np.arange(len(examples)), vectors.argmax(axis=1) if vectors.shape[1] else np.zeros(len(examples))))  # alike ones share blocks
    vectors = vectors[order]
    index.keys = [examples[i][0] for i in order]
    index.labels = np.array([examples[i][1] for i in order])
    index.lists = [np.ascontiguousarray(vectors[i : i + BLOCK].T) for i in range(0, len(vectors), BLOCK)]
    index.bound = np.stack([block.max(axis=1) for block in index.lists], axis=1) if len(idf) else np.zeros((0, len(index.lists)), np.float32)
    who, cos = index.nearest(vectors, near, np.arange(len(vectors)))
    own = {y: max(1, int((index.labels == y).sum())) for y in (0, 1)}
    index.curve = _monotone(index.votes(who, cos), index.labels, np.array([population[y] / own[y] for y in index.labels]))
    return index


def _counted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the distinct words of ``_data`` with their counts."""
    ddl = T.StructType([rows.schema[c] for c in keep] + [T.StructField("_words", T.BinaryType()), T.StructField("_times", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(ddl)

    def work(batches):
        for b in batches:
            found = [Counter(words(x.as_py())) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [
                pa.array([b" ".join(c) for c in found], pa.binary()), pa.array([list(c.values()) for c in found], schema.field(len(keep) + 1).type)], schema=schema)

    return rows.select(*keep, "_data").mapInArrow(work, ddl)


def document_frequency(docs: DataFrame, terms: list[bytes], text: str = "text") -> tuple[int, dict]:
    """Rows of ``docs``, and how many of them have each of the ``terms``: each task adds up its own, then tasks are summed."""
    place = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(terms)})
    schema = pa.schema([("_term", pa.int64()), ("_docs", pa.int64())])

    def work(batches):
        place_of, total, rows = place.value, np.zeros(len(place.value), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for x in b.column(0):
                at = [place_of[w] for w in set(words(x.as_py())) if w in place_of]
                total[at] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], schema=schema)

    counts = docs.select(F.col(text).cast("binary")).mapInArrow(work, "_term long, _docs long").groupBy("_term").agg(F.sum("_docs").alias("n")).collect()
    found = {r["_term"]: r["n"] for r in counts}
    return found.get(-1, 0), {w: found.get(i, 0) for i, w in enumerate(terms)}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
        examples: int = EXAMPLES, terms: int = TERMS, near: int = NEIGHBOURS) -> Index | None:
    """Index of up to ``examples`` labelled rows that ``learn`` (over the key) selects, half of each label if there are so many.

    A key's label is its largest in ``labels``; null labels and null keys don't count. None without both labels.
    """
    told = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_of")).agg(
        F.when(F.max(label) > 0, 1).otherwise(0).alias("_label"))
    known = docs.filter(learn).select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_data"))
    keyed = known.select("_key").join(told, F.col("_key") == F.col("_of")).drop("_of")
    counts = label_counts(keyed, "_label")
    if len(counts) < 2:
        return None
    few = min(counts.values())
    most = {y: (examples // 2 if n > few else min(n, examples // 2)) for y, n in counts.items()}
    picked = sample_by_label(keyed, "_key", "_label", most, counts).dropDuplicates(["_key"])
    sample = known.join(F.broadcast(picked), "_key").dropDuplicates(["_key"])  # at most ``examples`` keys
    rows = sorted(((r["_key"], r["_label"], bytes(r["_words"]).split(), r["_times"]) for r in _counted(sample, ["_key", "_label"]).collect()), key=lambda r: str(r[0]))
    chosen = informative([set(r[2]) for r in rows], np.array([r[1] for r in rows]), terms)
    total, frequency = document_frequency(docs, chosen, text)
    idf = {w: float(np.log((1 + total) / (1 + n)) + 1e-3) for w, n in frequency.items()}
    return build(rows, (idf, {y: n / sum(counts.values()) for y, n in counts.items()}), near)


def score(docs: DataFrame, index: Index | None, key: str = "doc_id", text: str = "text", threshold: float = 0.3, shown: int = 5) -> DataFrame:
    """One row per row of ``docs``: (key, score from 0 to 1, predicted, evidence = ``shown`` nearest examples with cosine and label).

    Texts without any of the index's words, empty and null ones among them, have the score of examples without neighbours and no
    evidence; without an index all scores are 0. Rows that repeat are scored alike.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_data"))
    kind = rows.schema["_key"].dataType
    evidence = T.ArrayType(T.StructType([T.StructField("key", kind), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    ddl = T.StructType([T.StructField("_key", kind), T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    schema = to_arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if index is None:
                    value, proof = np.zeros(part.num_rows), [[]] * part.num_rows
                else:
                    place = index.place
                    counted = []
                    for x in part.column(1):
                        own = Counter(w for w in words(x.as_py()) if w in place)
                        counted.append((list(own), list(own.values())))
                    value, who, cos = index.score(index.vectors(counted))
                    proof = [[{"key": index.keys[j], "cosine": float(c), "label": int(index.labels[j])} for j, c in zip(w[:shown], s[:shown]) if j >= 0]
                             for w, s in zip(who, cos)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(value, 0, 1), pa.float64()), pa.array(proof, schema.field(2).type)], schema=schema)

    return (rows.mapInArrow(work, ddl).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
            .withColumnRenamed("_key", key))
