import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskflow.llm import bpe, token_counts
from riskflow.llm.common import vocabulary_file


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(vocabulary_file())


def encoded(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_joins_give_the_whole_texts_encoding(reference):
    random.seed(3)
    v = bpe.load(vocabulary_file())
    for alphabet in ("ab", "a", "aAbB'stre  \n\t12", "éèa àçê", "☃😀a  ", "'s'#", " \n", "aab ", "0123", "  a　"):
        for n in (40, 900):
            for leaf in (8, 50):
                text = "".join(random.choice(alphabet) for _ in range(n))
                text = text[: n // 3] + "<|endoftext|>" + text[n // 3 :] if n % 3 == 0 else text
                parts = [np.array([v.special[s]]) if special else v.concatenate([np.array(v.encode(h.decode()), np.uint32) for h in bpe.halves(s.encode(), leaf)])
                         for special, s in v.segments(text)]
                assert np.concatenate(parts).tolist() == encoded(reference, text) == v.encode(text)


def test_round_trip_of_odd_documents(odd, none, reference):
    for leaf in (1 << 15, 20):
        got = sorted((r.doc_id or 0, bpe.unpack(bytes(r.ids)), r.decoded) for r in bpe.round_trip(odd, vocabulary_file(), leaf=leaf).collect())
        assert got == sorted((r.doc_id or 0, encoded(reference, r.text), r.text or "") for r in odd.collect())
    assert bpe.round_trip(none, vocabulary_file()).count() == 0


def test_decode_and_counts(odd, none, reference):
    coded = bpe.encode(odd, vocabulary_file())
    assert bpe.decode(coded, vocabulary_file()).filter(F.col("decoded") == "five words are in here").count() == 1
    lengths = sorted(len(encoded(reference, r.text)) for r in odd.collect())
    rows = token_counts.limits(token_counts.length_histogram(coded.select(bpe.token_count().alias("n_tokens")))).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.docs == lengths.count(r.n_tokens) and r.docs_over == sum(n > r.n_tokens for n in lengths)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and r.total_tokens == sum(lengths)
        assert abs(r.share_fitting - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    histogram = token_counts.length_histogram(coded.select(bpe.token_count().alias("n_tokens")))
    assert token_counts.quantile(histogram, 0.5).first()[0] == lengths[(len(lengths) - 1) // 2]
    assert token_counts.limits(token_counts.length_histogram(bpe.encode(none, vocabulary_file()).select(bpe.token_count().alias("n_tokens")))).count() == 0
