"""Ranked lexical search by two trees: one over the items, one over each batch of documents, searched in pairs of nodes.

A document is the impacts of its terms, an item the weights of its terms, and a score their inner product in whole numbers. A node holds for each
term the greatest impact (or weight) below it, so the product of two nodes' maxima bounds every score between them. A pair of nodes is
left, with all items and documents below, if its bound is under the weakest kth score that its items have so far; nothing else
is ever left out, so results are exact. Pairs with greater bounds come first, because they raise the kth scores.

Items come in blocks of bounded size (``BLOCK`` terms), the only thing that is sent to all tasks. A task reads its documents as a stream, makes
a tree of every ``BATCH`` of them, keeps its best k of each item over all its batches, and the k best of all tasks are merged.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskflow.session import cut

K = 10
BLOCK = 20_000
BATCH, ENTRIES = 8192, 1 << 21  # documents and (document, term) entries of a tree at most
LEAF, ITEM_LEAF, FAN = 32, 8, 4
LENGTH, SCALE = 90, 1_000_000_000
#: Letters, digits and all that isn't ASCII make up terms; A to Z in lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def weight(total: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * docs + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, per unit of weight; whole numbers below 10^6."""
    m = 100 - LENGTH + (LENGTH * n * total) // max(1, length)
    return (SCALE * tf) // (1000 * tf + 8 * m)


class Maxima:
    """A level of a tree: for each node its terms, sorted, and their maxima."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, nodes: int):
        order = np.lexsort((term, node))
        node, term, value = node[order], term[order], value[order]
        new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (term[1:] != term[:-1]))) if len(node) else np.empty(0, np.int64)
        self.node, self.term = node[new], term[new]
        self.value = np.maximum.reduceat(value, new) if len(new) else value
        self.start = np.searchsorted(self.node, np.arange(nodes + 1))
        self.nodes = nodes

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[i], self.start[i + 1])
        return self.term[at], self.value[at]

    def above(self) -> Maxima:
        return Maxima(self.node // FAN, self.term, self.value, -(-self.nodes // FAN))


def levels(leaf: np.ndarray, term: np.ndarray, value: np.ndarray, leaves: int) -> list[Maxima]:
    """From the leaves to the root."""
    out = [Maxima(leaf, term, value, leaves)]
    while out[-1].nodes > 1:
        out.append(out[-1].above())
    return out


class Items:
    """The hierarchy over a block of items: weights by term, items of similar frequent terms side by side."""

    def __init__(self, item_terms: list[list[int]], weights: list[int]):
        w = np.array(weights, np.int64)
        self.size = len(weights)
        exact = max(map(len, item_terms), default=0) * int(w.max(initial=1)) * 1_000_000 < 1 << 53
        self.kind = np.float64 if exact else np.int64  # sums of whole numbers are exact in either
        frequent = [sorted(t, key=lambda x: (weights[x], x)) for t in item_terms]
        self.order = sorted(range(len(item_terms)), key=lambda i: [(weights[x], x) for x in frequent[i][:8]])
        place = np.concatenate([np.full(len(item_terms[i]), p) for p, i in enumerate(self.order)] or [np.empty(0)]).astype(np.int64)
        term = np.concatenate([item_terms[i] for i in self.order] or [np.empty(0)]).astype(np.int64)
        value = w[term].astype(self.kind)
        self.leaves = -(-len(item_terms) // ITEM_LEAF)
        self.levels = []
        for level in levels(place // ITEM_LEAF, term, value, self.leaves):
            dense = np.zeros((level.nodes, self.size), self.kind)
            dense[level.node, level.term] = level.value
            self.levels.append(dense)
        self.rows = np.zeros((len(item_terms), self.size), self.kind)
        self.rows[place, term] = value
        self.weights = w


class Best:
    """The k best (score, document) of each item so far, and what the weakest of a node's items still needs."""

    def __init__(self, items: Items, k: int):
        self.k, self.items = k, items
        self.found: list[list[tuple]] = [[] for _ in items.order]
        self.kth = [np.zeros(len(level)) for level in items.levels]
        self.least = np.zeros(len(items.order))

    def offer(self, leaf: int, scores: np.ndarray, names: list) -> None:
        """scores: by item of the leaf and document."""
        first, changed = leaf * ITEM_LEAF, False
        top = scores.max(axis=1)
        for row in np.flatnonzero((top > 0) & (top >= self.least[first : first + len(scores)])):
            at, mine = first + int(row), self.found[first + int(row)]
            for j in np.flatnonzero(scores[row] >= max(1, self.least[at])):
                entry = (-int(scores[row, j]), names[j] is None, names[j] if names[j] is not None else 0)
                if len(mine) < self.k or entry < mine[-1]:
                    bisect.insort(mine, entry)
                    del mine[self.k :]
            if len(mine) == self.k and -mine[-1][0] > self.least[at]:
                self.least[at], changed = -mine[-1][0], True
        if changed:
            self.kth[0][leaf] = self.least[first : first + len(scores)].min()
            for i in range(1, len(self.kth)):
                leaf //= FAN
                self.kth[i][leaf] = self.kth[i - 1][leaf * FAN : (leaf + 1) * FAN].min()


def search(items: Items, best: Best, names: list, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> int:
    """Bring ``best`` up to date with a batch of documents, given as (document, term, impact) entries. Returns how many pairs of leaves
    were scored."""
    if not len(owner):
        return 0
    worth = value * items.weights[term]
    heavy = np.lexsort((-worth, owner))
    docs, first = np.unique(owner[heavy], return_index=True)
    lead = heavy[first]  # of each document the entry that is worth most
    order = docs[np.lexsort((-worth[lead], term[lead]))]
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(order))
    spot = place[owner]
    tree = levels(spot // LEAF, term, value.astype(items.kind), -(-len(order) // LEAF))
    by_leaf = np.argsort(spot, kind="stable")
    spot, term, value = spot[by_leaf], term[by_leaf], value[by_leaf].astype(items.kind)
    starts = np.searchsorted(spot // LEAF, np.arange(tree[0].nodes + 1))
    dense: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}

    def block(leaf: int) -> tuple[np.ndarray, np.ndarray, list]:
        if leaf not in dense:
            own, at = tree[0].of(leaf)[0], slice(starts[leaf], starts[leaf + 1])
            matrix = np.zeros((len(own), min(LEAF, len(order) - leaf * LEAF)), items.kind)
            matrix[np.searchsorted(own, term[at]), spot[at] - leaf * LEAF] = value[at]
            dense[leaf] = own, matrix, [names[d] for d in order[leaf * LEAF : (leaf + 1) * LEAF]]
        return dense[leaf]

    scored = 0
    stack = [(math.inf, len(items.levels) - 1, 0, len(tree) - 1, 0)]
    while stack:
        bound, up, item, level, node = stack.pop()
        if bound < max(1, best.kth[up][item]):
            continue
        if up == 0 and level == 0:
            own, matrix, who = block(node)
            best.offer(item, items.rows[item * ITEM_LEAF : (item + 1) * ITEM_LEAF][:, own] @ matrix, who)
            scored += 1
            continue
        if level >= up and level > 0:  # split the higher node
            below = [(up, item, level - 1, n) for n in range(node * FAN, min((node + 1) * FAN, tree[level - 1].nodes))]
        else:
            below = [(up - 1, i, level, node) for i in range(item * FAN, min((item + 1) * FAN, len(items.levels[up - 1])))]
        bounded = []
        for u, i, v, n in below:
            own, most = tree[v].of(n)
            bounded.append((float(items.levels[u][i][own] @ most), u, i, v, n))
        stack.extend(sorted(bounded))
    return scored


def _blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple]]:
    """[(item, its distinct terms)] in blocks of about ``most`` terms; an item is never split. Rows of one item are united."""
    size = items.agg(F.sum(F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + 1)).first()[0] or 0
    n = -(-int(size) // most)
    for i in range(n):
        found: dict = {}
        for row in items.filter(F.pmod(F.xxhash64(item), F.lit(n)) == i).select(item, F.col(text).cast("binary")).toLocalIterator():
            found.setdefault(row[0], set()).update(terms(row[1]))
        if block := [(name, sorted(own)) for name, own in found.items() if own]:
            yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block: int = BLOCK) -> DataFrame:
    """(item, rank from 1, key, score) of each item's k best documents with a score above 0, all if there are fewer.

    Equal scores come by ascending key, null keys last. Null texts have no terms; documents without terms count nowhere. Rows that repeat a
    key are documents of their own, rows that repeat an item add their terms to it, each once. Whole texts are read, of any
    length. No documents or no items give no rows; other columns are left out.
    """
    kind = T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
    parts = [_search_block(docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")), part, k, kind)
             for part in _blocks(items, item, item_text, block)]
    if not parts:
        return docs.sparkSession.createDataFrame([], kind).select(item, F.lit(0).alias("rank"), key, "score")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(item, "rank", key, "score")


def _search_block(docs: DataFrame, block: list[tuple], k: int, kind: T.StructType) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    counted = T.StructType([docs.schema["_key"], T.StructField("_n", T.LongType()), T.StructField("_terms", T.ArrayType(T.IntegerType())),
                            T.StructField("_tf", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, times = [], [], []
            for x in batch.column(1):
                said = terms(x.as_py())
                found = Counter(map(vocabulary.get, said))
                found.pop(None, None)
                n.append(len(said))
                own.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, schema.field(2).type) for x in (own, times))], schema=schema)

    rows = cut(docs.mapInArrow(count, counted).filter("_n > 0"))
    total, length = rows.agg(F.count(F.lit(1)), F.sum("_n")).first()
    df = {r[0]: r[1] for r in rows.select(F.explode("_terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect()}
    names = [name for name, _ in block]
    weights = [weight(total, df.get(i, 0)) for i in range(len(vocabulary))]
    own = [[vocabulary[t] for t in said] for _, said in block]
    out_schema = to_arrow_schema(kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(own, weights)
        best = Best(items, k)
        keys, held, entries = [], [], 0

        def flush() -> None:
            who = np.concatenate([h[0] for h in held])
            term, tf, n = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            search(items, best, keys, who, term, impacts(tf, n, total, length))

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = [part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3)]
                where = np.repeat(np.arange(part.num_rows), size)
                held.append((where + len(keys), *flat, part.column(1).to_numpy()[where]))
                keys += part.column(0).to_pylist()
                entries += len(where)
                if len(keys) >= BATCH or entries >= ENTRIES:
                    flush()
                    keys, held, entries = [], [], 0
        if keys:
            flush()
        out = [(names[items.order[p]], None if null else name, -score) for p, mine in enumerate(best.found) for score, null, name in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    return rows.filter(F.size("_terms") > 0).mapInArrow(find, kind)
