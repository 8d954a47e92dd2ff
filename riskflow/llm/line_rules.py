"""Quality rules, lines first.

Every line of a text is judged on its own: by punctuation, as navigation, as boilerplate. Lines that fail are removed, and a
document is rejected if it loses more than ``max_lost`` of its words with them, or fails the counts over its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\x0b\x0c\r "
#: A line should end with one of these; a line of LONG words may break off, if it has punctuation elsewhere.
ENDINGS = tuple(x.encode() for x in (".", "!", "?", "…", '"', "”", "’", "'", ")", "»", ":", ";", "。", "！", "？"))
LONG = 12
#: Words that only divide the entries of a menu.
DIVIDERS = frozenset(x.encode() for x in ("|", ">", ">>", "»", "«", "·", "•", "/", "::"))
#: In lower case; a line that has one of them is boilerplate.
PHRASES = ("all rights reserved", "is licensed under", "spdx-license-identifier", "terms of use", "terms of service", "privacy policy",
           "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our", "share this article")
_PHRASES = tuple(p.encode() for p in PHRASES)


def failed_rule(line: bytes, words: list[bytes], seen: bool, suspect: bool) -> str | None:
    """The first rule that a line with words fails. ``seen``: an earlier line is equal; ``suspect``: it may hold a phrase."""
    if 5 * sum(w in DIVIDERS for w in words) > len(words):
        return "navigation"
    if not words[-1].endswith(ENDINGS) and (len(words) < LONG or not any(w.endswith((b",", *ENDINGS)) for w in words)):
        return "punctuation"
    marked = sum(1 for w in words if w.endswith(b"!!") or w[-1] in SYMBOLS)
    if 10 * marked > 3 * len(words):
        return "punctuation"
    if seen or suspect and any(p in line.lower() for p in _PHRASES):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that is found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    count, upto = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            count += i + 3 - max(i, upto)
            upto = i + 3
    return count


def judge(data: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, lines lost by rule, kept text) of UTF-8."""
    words = data.split()
    bare = data.translate(None, SPACES)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    low = data.lower()
    suspect = any(p in low for p in _PHRASES)
    seen, kept, lost, dup, why = set(), [], 0, 0, Counter()
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        rule = failed_rule(line, own, again, suspect)
        if rule:
            why[rule] += 1
            lost += len(own)
        else:
            kept.append(line)
    return (len(words), chars, symbols, dup, repeated_words(words), lost, why["navigation"], why["punctuation"], why["boilerplate"],
            b"\n".join(kept))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "navigation_lines", "punctuation_lines",
          "boilerplate_lines")


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, max_repeated: float = 0.5,
                max_lost: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: (key, counts over the whole text, lines lost by each rule, clean_text, base_failed, kept).

    A null text has no words, and any text with under ``min_words`` is rejected. Lines without words are neither kept nor
    lost. Rows that repeat are judged alike. Bytes that aren't UTF-8 count as one character each run. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    ddl = T.StructType([T.StructField("_key", rows.schema["_key"].dataType)] + [T.StructField(c, T.LongType()) for c in COUNTS]
                       + [T.StructField("clean_text", T.StringType())])
    schema = to_arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [judge(x.as_py()) for x in part.column(1)]
                texts = pa.array([f[-1].decode("utf-8", "replace") for f in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS))] + [texts], schema=schema)

    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return (rows.mapInArrow(work, ddl).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))
            .withColumnRenamed("_key", key))
