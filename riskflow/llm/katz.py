"""Word language model: Katz backoff over n-grams with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) is the discounted share of w after h if the n-gram hw was seen, else the backoff weight of h times P(w | h'), h' being h without its first
word; after an unseen h it is P(w | h'). P(w) is the discounted share of w, and all unseen words together have what the discounts leave. The weight of h is the
mass its seen n-grams leave, over the mass that P(. | h') gives to words not seen after h, so the probabilities of all words and the unseen one sum to 1
after every h. The first word of a text follows one end token, so the second has two words before it, and so on up to the order.

Tables are partitioned by word and by history and never leave their partitions. Documents are packed into chunks of about
``CHUNK`` tokens; a chunk asks each partition once for its distinct words, and then once for its distinct n-grams of each order, and gets an answer
in the same order. So what is shuffled are packed columns of distinct items, and hot words count once a chunk:

1. words: counts are summed, and each word gets a number; numbers of frequent words are small;
2. n-grams of 2 words, then of 3, ..., dealt by history: counts are summed; per history, whole numbers from which its weight follows: how many of its n-grams
   were seen r times, how many of them occur r times without their first word, and the occurrences of the others. The n-grams of the at most ``1 / HOT`` most
   frequent histories are dealt by n-gram, and their sums are added up over partitions;
3. a chunk evaluates its tokens from the answers, order by order, and sums them by document.

Chunks are a table in the shared folder, bucketed by chunk: answers are shuffled to it, it isn't shuffled to them.
To the driver come counts of counts, and the sums of those hot histories.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskflow.session import checkpoint_dir, cut, sweep

CHUNK, HOT, KATZ = 1 << 20, 0.001, 5
STATS = 2 * KATZ + 2
END = b"\n"  # no word has white space
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pack(values: np.ndarray, kind: str) -> bytes:
    """Integers or floats as compressed byte planes."""
    data = np.ascontiguousarray(values, kind)
    return zstandard.ZstdCompressor(3).compress(data.view(np.uint8).reshape(len(data), -1).T.tobytes()) if len(data) else b""


def unpack(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# ---- discounts

def discounts(seen: list[float]) -> np.ndarray:
    """Factors d[1..k] (d[0] unused) from counts of counts ``seen[r]``, r up to k + 1, for the largest k up to ``KATZ`` that gives
    factors in (0, 1); failing that, one factor for single counts by absolute discounting."""
    for k in range(KATZ, 0, -1):
        n = seen[: k + 2]
        if min(n[1:]) <= 0:
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest != 1 else 0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d])
    return np.array([1.0, 1 - seen[1] / (seen[1] + 2 * seen[2])]) if seen[1] > 0 and seen[2] > 0 else np.array([1.0, 0.5])


class Words:
    """P(w) by count."""

    def __init__(self, tokens: int, distinct: int, seen: list[float]):
        self.tokens, self.distinct, self.d = tokens, distinct, discounts(seen)
        kept = 1 - sum((1 - self.d[r]) * r * seen[r] for r in range(1, len(self.d))) / max(1, tokens)
        self.unseen = max(1 - kept, 0.5 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unseen) / kept if tokens else 0.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        small = np.minimum(counts, len(self.d) - 1).astype(int)
        d = np.where(counts < len(self.d), self.d[small], 1.0)
        return np.where(counts > 0, self.scale * d * c / max(1, self.tokens), self.unseen)


def history_model(stats: np.ndarray, d: np.ndarray, lower: np.ndarray, under: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(factor of the seen n-grams' discounted shares, backoff weight) of histories.

    ``stats``: columns count, n-grams seen 1 to KATZ times, occurrences of those without their first word where they are more than
    KATZ, how many have 1 to KATZ. Such an n-gram occurring c times has the probability ``under`` times c, discounted by ``lower``. Where no n-gram is
    discounted, the seen ones share count / (count + 1).
    """
    count = np.maximum(stats[:, 0], 1)
    off = sum((1 - d[r]) * r * stats[:, r] for r in range(1, len(d))) / count
    factor = np.where(off > 1e-12, 1.0, count / (count + 1))
    left = np.where(off > 1e-12, off, 1 / (count + 1))
    never = stats[:, 0] == 0
    mass = stats[:, KATZ + 1] + sum((lower[r] if r < len(lower) else 1.0) * r * stats[:, KATZ + 1 + r] for r in range(1, KATZ + 1))
    return factor, np.where(never, 1.0, left / np.maximum(1 - under * mass, 1e-12))


# ---- chunks

def _chunks(docs: DataFrame, learn: Column, key: str, text: str) -> DataFrame:
    """(chunk, keys, learn and length per document, tokens as places in the list of words, words)."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    ddl = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["_key"].dataType)), *[
        T.StructField(n, T.BinaryType()) for n in ("learn", "lengths", "stream", "words")], T.StructField("n", T.LongType())])
    schema = to_arrow_schema(ddl)

    def made(n: int, keys: list, flags: list, lengths: list, stream: list, place: dict) -> pa.RecordBatch:
        tokens = np.concatenate([np.array(s, np.int64) for s in stream])
        own = list(place)
        order = np.argsort(-np.bincount(tokens, minlength=len(own)), kind="stable")  # frequent words have small numbers
        words = [own[i] for i in order]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        tokens = rank[tokens]
        values = [(TaskContext.get().partitionId() << 32) + n, keys, pack(np.array(flags), "u1"), pack(np.array(lengths), "<u4"),
                  pack(tokens, "<u4"), zstandard.ZstdCompressor(3).compress(b" ".join(words)), len(tokens)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, much = 0, 0
        keys, flags, lengths, stream, place = [], [], [], [], {END: 0}
        for batch in batches:
            for k, flag, x in zip(*batch.columns):
                own = x.as_py().translate(_LOWER).split()
                keys.append(k.as_py()), flags.append(flag.as_py()), lengths.append(len(own) + 1)
                stream.append([place.setdefault(w, len(place)) for w in own] + [0])
                much += len(own) + 1
                if much >= CHUNK:
                    yield made(n, keys, flags, lengths, stream, place)
                    n, much = n + 1, 0
                    keys, flags, lengths, stream, place = [], [], [], [], {END: 0}
        if keys:
            yield made(n, keys, flags, lengths, stream, place)

    return rows.mapInArrow(work, ddl)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    if not len(columns[0]):
        return np.zeros(1, int)
    return np.concatenate([[0], 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)), [len(columns[0])]])


class Chunk:
    """A chunk's tokens, and what it asks: words by partition, then, order by order, n-grams by partition, history and word."""

    def __init__(self, row: dict, parts: int):
        self.flags, self.lengths = unpack(row["learn"], "u1").astype(bool), unpack(row["lengths"], "<u4").astype(np.int64)
        self.stream = unpack(row["stream"], "<u4").astype(np.int64)
        self.words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        self.learn = np.repeat(self.flags, self.lengths)
        self.part = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % parts
        self.order = np.argsort(self.part, kind="stable")
        self.parts = parts

    def told(self, answers: list[dict]) -> None:
        """Numbers and counts of the words, from the partitions' answers; each word is a history of n-grams of two words."""
        answers = sorted(answers, key=lambda a: a["part"])
        self.number, self.count = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
        self.number[self.order] = np.concatenate([unpack(a["first"], "<i8") for a in answers])
        self.count[self.order] = np.concatenate([unpack(a["second"], "<i8") for a in answers])
        start = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.offset = np.arange(len(self.stream)) - np.repeat(start, self.lengths)
        before = np.concatenate([[0], self.stream[:-1]])
        before[start] = self.words.index(END)
        self.number, self.count = np.append(self.number, -1), np.append(self.count, 0)  # one place for all words not seen
        self.after = np.where(self.count[self.stream] > 0, self.stream, len(self.words))
        # the history before each token, -1 if it was not seen; words of each history; how often it and the token's n-gram without its first word were seen
        self.history, self.spelt, self.seen, self.shorter = np.where(self.count[before] > 0, before, -1), [np.arange(len(self.count))], self.count, self.count[self.stream]
        self.n = 2

    def grams(self, hot: float) -> None:
        """The distinct n-grams with a known history, in the order in which partitions are asked for them."""
        self.at = np.flatnonzero(self.history >= 0)
        local, self.which = np.unique(self.history[self.at] * len(self.count) + self.after[self.at], return_inverse=True)
        h, w = np.divmod(local, len(self.count))
        self.heavy = self.seen >= hot
        keys = [self.number[x[h]] for x in self.spelt]
        spread = np.where(self.heavy[h], self.number[w] * 0x85EBCA77, 0)
        for x in keys:
            spread = (spread + x) * 0x9E3779B1
            spread ^= spread >> 17
        q = (spread ^ (spread >> 29)) % self.parts
        order = np.lexsort((self.number[w], *keys[::-1], q))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which, self.h, self.w, self.q = place[self.which], h[order], w[order], q[order]
        self.keys = [x[order] for x in keys]
        self.trained = np.bincount(self.which, weights=self.learn[self.at], minlength=len(order)).astype(np.int64)
        self.lower = np.zeros(len(order), np.int64)
        self.lower[self.which] = self.shorter[self.at]

    def longer(self, times: np.ndarray) -> None:
        """What ``grams`` asked for was seen so many times; now each of them is a history of n-grams of one word more."""
        mine = np.full(len(self.stream), -1)
        mine[self.at] = self.which
        self.spelt = [*[x[self.h] for x in self.spelt], self.w]
        self.seen, self.shorter, self.n = times, np.where(mine >= 0, np.append(times, 0)[mine], 0), self.n + 1
        last = np.concatenate([[-1], mine[:-1]])
        self.history = np.where((self.offset >= self.n - 2) & (last >= 0) & (np.append(times, 0)[last] > 0), last, -1)


def _times(answers: list[dict] | None) -> tuple[np.ndarray, list[dict]]:
    answers = sorted(answers or [], key=lambda a: a["part"])
    return np.concatenate([unpack(a["first"], "<u4") for a in answers] or [np.empty(0)]).astype(np.int64), answers


ASK = T.StructType([T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType())] + [
    T.StructField(n, T.BinaryType()) for n in ("first", "second", "third", "fourth")])
ANSWER = T.StructType([T.StructField("kind", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.LongType()),
                       T.StructField("first", T.BinaryType()), T.StructField("second", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
_ask, _answer = to_arrow_schema(ASK), to_arrow_schema(ANSWER)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _ask_words(chunks: DataFrame, parts: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, parts)
                counts = np.bincount(c.stream, weights=c.learn, minlength=len(c.words)).astype(np.int64)
                part = c.part[c.order]
                cuts = _runs(part)
                yield _table([(int(part[a]), row["chunk"], zstandard.ZstdCompressor(3).compress(b" ".join(c.words[i] for i in c.order[a:b])),
                               pack(counts[c.order[a:b]], "<i8"), None, None) for a, b in zip(cuts, cuts[1:])], _ask)

    return chunks.mapInArrow(work, ASK)


def _count_words(parts: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        total, asked = {}, []
        for data, counts in zip(group["first"], group["second"]):
            words = zstandard.ZstdDecompressor().decompress(data).split(b" ")
            asked.append(words)
            for w, n in zip(words, unpack(counts, "<i8").tolist()):
                total[w] = total.get(w, 0) + n
        part = int(group["part"].iloc[0])
        ranked = sorted((w for w, n in total.items() if n), key=lambda w: (-total[w], w))
        number = {w: part + parts * i for i, w in enumerate(ranked)}
        counts = np.array([total[w] for w in ranked], np.int64)
        seen = np.bincount(np.minimum(counts, KATZ + 2), minlength=KATZ + 3)[: KATZ + 2] if len(counts) else np.zeros(KATZ + 2)
        out = [(0, chunk, part, pack(np.array([number.get(w, 0) for w in words]), "<i8"), pack(np.array([total[w] for w in words]), "<i8"), None)
               for chunk, words in zip(group["chunk"], asked)]
        out.append((1, -1, part, None, None, [float(counts.sum()), float(len(counts)), *map(float, seen)]))
        return pd.DataFrame(out, columns=ANSWER.names)

    return work


def _ask_grams(told: DataFrame, parts: int, hot: float, n: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, parts)
                c.told(row["answers"])
                for m in range(2, n):
                    c.grams(hot)
                    c.longer(_times(row[f"grams{m}"])[0])
                c.grams(hot)
                cuts = _runs(c.q)
                if len(c.q):
                    yield _table([(int(c.q[a]), row["chunk"], pack(np.concatenate([x[a:b] for x in c.keys]), "<i8"), pack(c.number[c.w[a:b]], "<i8"), pack(c.trained[a:b], "<u4"),
                                   pack(np.concatenate([np.where(c.trained[a:b] > 0, c.lower[a:b], 0), c.heavy[c.h[a:b]]]), "<i8")) for a, b in zip(cuts, cuts[1:])], _ask)

    return told.mapInArrow(work, ASK)


def _count_grams(n: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        asked = [(np.vstack([unpack(a, "<i8").reshape(n - 1, -1), unpack(b, "<i8")]), unpack(t, "<u4").astype(np.int64), unpack(x, "<i8").reshape(2, -1).T)
                 for a, b, t, x in zip(group["first"], group["second"], group["third"], group["fourth"])]
        keys, trained, x = np.concatenate([a[0] for a in asked], axis=1), np.concatenate([a[1] for a in asked]), np.concatenate([a[2] for a in asked])
        order = np.lexsort(keys[::-1])
        heads = _runs(*keys[:, order])[:-1]
        new = np.zeros(len(order), np.int64)
        new[heads] = 1
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        times = np.bincount(kind, weights=trained).astype(np.int64)
        first = order[heads]
        hist, hot = keys[:-1, first], x[first, 1] > 0
        lower = np.maximum.reduceat(x[order, 0], heads) * (times > 0)  # occurrences without the first word, where the n-gram was seen
        cuts = _runs(*hist)
        row_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        stats = np.zeros((len(cuts) - 1, STATS), np.int64)
        stats[:, 0] = np.bincount(row_of, weights=times)
        for r in range(1, KATZ + 1):
            stats[:, r] = np.bincount(row_of, weights=times == r)
            stats[:, KATZ + 1 + r] = np.bincount(row_of, weights=lower == r)
        stats[:, KATZ + 1] = np.bincount(row_of, weights=np.where(lower > KATZ, lower, 0))
        part, at, out = int(group["part"].iloc[0]), 0, []
        for chunk, (own, *_) in zip(group["chunk"], asked):
            mine = kind[at : at + own.shape[1]]
            at += own.shape[1]
            rows = row_of[mine[_runs(*own[:-1])[:-1]]]
            out.append((0, chunk, part, pack(times[mine], "<u4"), pack(stats[rows, 1:].T.ravel(), "<i8"), None))
        seen = np.bincount(np.minimum(times, KATZ + 2), minlength=KATZ + 3)[: KATZ + 2]
        out.append((1, -1, part, None, None, [float(v) for v in seen]))
        out += [(2, -1, part, hist[:, a].astype("<i8").tobytes(), None, [float(v) for v in stats[i]]) for i, a in enumerate(cuts[:-1]) if hot[a]]
        return pd.DataFrame(out, columns=ANSWER.names)

    return work


def _sums(answers: DataFrame, kind: int) -> dict[bytes | None, np.ndarray]:
    """The answers' statistics of one kind, summed over partitions, by ``first`` (there, the numbers of a hot history's words)."""
    each = answers.filter(F.col("kind") == kind).select("first", F.posexplode("stats").alias("i", "v")).groupBy("first", "i").agg(F.sum("v").alias("v"))
    out: dict[bytes | None, dict] = {}
    for r in each.collect():
        out.setdefault(r["first"] and bytes(r["first"]), {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _stored(chunks: DataFrame) -> DataFrame:
    """``chunks`` written once, bucketed by chunk, to the folder that all executors share."""
    spark = chunks.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.format("parquet").bucketBy(buckets, "chunk").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    own = answers.filter("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "first", "second")).alias(name))
    return chunks.join(own, "chunk", "left")


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """One row per row of ``docs``: (key, n_tokens, n_known, train_tokens, base_score, score), learning n-grams of up to ``order`` words from the rows that ``learn`` selects.

    Words are runs without ASCII white space, A to Z in lower case, and each text ends with one more token; a null text is
    that token alone. ``n_known``: tokens that occur in the training texts; ``base_score``: log10 of the text's probability by counts
    plus a half; ``score``: by the model. Rows that repeat are scored, and learned from, like any other. Without training rows all words are unseen.
    """
    if order < 2:
        raise ValueError("an order of 2 words or more")
    chunks = _stored(_chunks(docs, learn, key, text))
    parts = max(16, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // CHUNK))
    words = cut(_ask_words(chunks, parts).groupBy("part").applyInPandas(_count_words(parts), ANSWER))
    sweep(docs.sparkSession)  # what was asked is on disk until then
    total = _sums(words, 1).get(None, np.zeros(KATZ + 4))
    tokens, distinct = int(total[0]), int(total[1])
    model, hot = Words(tokens, distinct, total[2:].tolist()), max(1.0, HOT * tokens)
    told, d, hot_stats = _with_answers(chunks, words, "answers"), {}, {}
    for n in range(2, order + 1):
        grams = cut(_ask_grams(told, parts, hot, n).groupBy("part").applyInPandas(_count_grams(n), ANSWER))
        sweep(docs.sparkSession)
        d[n], hot_stats[n] = discounts(_sums(grams, 1).get(None, np.zeros(KATZ + 2)).tolist()), _sums(grams, 2)
        told = _with_answers(told, grams, f"grams{n}")

    ddl = T.StructType([T.StructField("_key", chunks.schema["keys"].dataType.elementType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(ddl)

    def evaluate(row: dict) -> pa.RecordBatch:
        c = Chunk(row, parts)
        c.told(row["answers"])
        value, lower, under, histories = np.log10(model.of(c.count))[c.stream], model.d, model.scale / max(1, tokens), None
        for n in range(2, order + 1):
            c.grams(hot)
            times, answers = _times(row[f"grams{n}"])
            stats = np.concatenate([unpack(a["second"], "<i8").reshape(STATS - 1, -1).T for a in answers] or [np.empty((0, STATS - 1))])
            own = np.zeros((len(c.seen), STATS))
            own[:, 0] = c.seen
            own[c.h[_runs(c.q, c.h)[:-1]], 1:] = stats
            for i in np.flatnonzero(c.heavy):
                name = np.array([c.number[x[i]] for x in c.spelt], "<i8").tobytes()
                if name in hot_stats[n]:
                    own[i] = hot_stats[n][name]
            if histories is not None:  # of the histories without their first word
                known = np.zeros(len(own))
                known[c.history[c.at]] = under[histories[c.at]]
                under = known
            factor, back = history_model(own, d[n], lower, under)
            under, lower, histories = factor / np.maximum(own[:, 0], 1), d[n], c.history
            small = np.minimum(times, len(lower) - 1)
            shares = under[c.h] * np.where(times < len(lower), lower[small], 1.0) * times
            shares, backed = np.log10(np.where(times > 0, shares, 1)), np.log10(back[c.h])
            value[c.at] = np.where(times[c.which] > 0, shares[c.which], backed[c.which] + value[c.at])
            c.longer(times)
        at = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        base = np.log10((c.count[c.stream] + 0.5) / (tokens + 0.5 * (distinct + 1)))
        known = (c.count[c.stream] > 0).astype(np.int64)
        cols = [c.lengths, np.add.reduceat(known, at), np.full(len(at), tokens), np.add.reduceat(base, at), np.add.reduceat(value, at)]
        return pa.RecordBatch.from_arrays([pa.array(row["keys"], schema.field(0).type)] + [pa.array(v, f.type) for v, f in zip(cols, list(schema)[1:])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield evaluate(batch.slice(i, 1).to_pylist()[0])

    return told.mapInArrow(work, ddl).withColumnRenamed("_key", key)
