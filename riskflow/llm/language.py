"""Language identification by a string kernel.

Two texts are compared by the character n-grams (n = 1, 2, 3, the blended spectrum) that are present in both: the kernel is the
number of shared n-grams over the geometric mean of the numbers each text has. A bounded sample of labelled texts is mapped by its
kernel values to a set of landmarks (Nyström), and kernel ridge regression is solved for each language against the rest.

As the kernel is a product of presence vectors, landmarks and ridge weights fold into one matrix of n-grams by languages, as long
as the list of n-grams that the landmarks have; a batch of texts is scored by multiplying its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskflow.llm.common import fresh
from riskflow.llm.sampling import label_counts, sample_by_label

SAMPLE, LANDMARKS, RIDGE = 2000, 256, 1e-3  # labelled rows and landmarks at most, over all languages
BITS = 21
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, and a space for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: bytes | None) -> np.ndarray:
    """The sorted distinct n-grams of a text's letters, packed into integers; none if it has no letters."""
    text = (data or b"").decode("utf-8", "replace")
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = c == 32
    if gap.all():
        return np.empty(0, np.uint64)
    c = c[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint64)  # one space between words
    shift = np.uint64(BITS)
    two = (c[:-1] << shift) | c[1:]
    three = (two[:-1] << shift) | c[2:]
    return np.unique(np.concatenate([c[c != 32], two | np.uint64(1 << 62), three | np.uint64(1 << 63)]))


@dataclass
class Model:
    languages: list
    known: np.ndarray  # n-grams of the landmarks, sorted
    weights: np.ndarray  # those x languages

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        """Regression values of texts given by their n-grams."""
        present = np.zeros((len(batch), len(self.known)), np.float32)
        for i, g in enumerate(batch):
            at = np.searchsorted(self.known, g)
            at[at == len(self.known)] = 0
            present[i, at[self.known[at] == g]] = 1
        size = np.sqrt(np.array([max(1, len(g)) for g in batch]))
        return (present @ self.weights) / size[:, None]


def _presence(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), np.float32)
    for i, g in enumerate(sets):
        out[i, np.searchsorted(known, g[np.isin(g, known, assume_unique=True)])] = 1
    return out / np.sqrt(np.array([max(1, len(g)) for g in sets], np.float32))[:, None]


def solve(sets: list[np.ndarray], labels: list, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit to n-gram sets in an order that doesn't depend on their labels; landmarks are dealt over the languages in turn."""
    languages = sorted(set(labels))
    own = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    turns = [own[x][k] for k in range(max(map(len, own.values()))) for x in languages if k < len(own[x])]
    chosen = [sets[i] for i in turns[:landmarks]]
    known = np.unique(np.concatenate(chosen))
    mark, rows = _presence(chosen, known).astype(np.float64), _presence(sets, known).astype(np.float64)
    value, vector = np.linalg.eigh(mark @ mark.T)
    good = value > 1e-9 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    phi = rows @ mark.T @ whiten
    target = np.array([[1.0 if y == x else -1.0 for x in languages] for y in labels])
    balance = np.array([1 / len(own[y]) for y in labels])[:, None]  # each language weighs the same
    beta = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]), phi.T @ (target * balance))
    return Model(languages, known, (mark.T @ (whiten @ beta)).astype(np.float32))


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        landmarks: int = LANDMARKS) -> Model | None:
    """Fit to up to ``sample`` of the rows that ``learn`` selects, the same number of each language; None if there is none.

    Only their distinct n-grams come to the driver.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    counts = label_counts(rows, "_lang")
    if not counts:
        return None
    most = {x: max(1, sample // len(counts)) for x in counts}
    picked = sample_by_label(rows, "_key", "_lang", most, counts).select("_key", "_lang", F.col("_text").cast("binary").alias("_data"))
    ddl = T.StructType([T.StructField("_key", picked.schema["_key"].dataType), T.StructField("_lang", T.StringType()), T.StructField("_grams", T.BinaryType())])
    schema = to_arrow_schema(ddl)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([grams(x.as_py()).tobytes() for x in b.column(2)], pa.binary())], schema=schema)

    found = sorted(((r["_lang"], str(r["_key"]), np.frombuffer(bytes(r["_grams"]), np.uint64)) for r in picked.mapInArrow(work, ddl).collect()),
                   key=lambda r: r[:2])
    found = [r for r in found if len(r[2])]
    return solve([r[2] for r in found], [r[0] for r in found], landmarks) if found else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None,
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and, under ``names``, the language and how far the best regression value is
    towards 1, from 0 to 1; a row per row, and nothing is shuffled.

    Texts without letters, null texts and all texts without a model are ``und`` with score 0. Ties go to the first language by
    name. Only the whole text is looked at.
    """
    keep = docs.columns if keep is None else keep
    data, = fresh(docs, "_data")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(data))
    ddl = T.StructType([rows.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    schema = to_arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [grams(x.as_py()) for x in part.columns[-1]]
                found, sure = [UNDETERMINED] * len(sets), [0.0] * len(sets)
                if model is not None:
                    value = model.scores(sets)
                    best = value.argmax(axis=1)
                    for i, g in enumerate(sets):
                        if len(g):
                            found[i], sure[i] = model.languages[best[i]], float(min(1.0, max(0.0, (value[i, best[i]] + 1) / 2)))
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(found, pa.string()), pa.array(sure, pa.float64())], schema=schema)

    return rows.mapInArrow(work, ddl)
