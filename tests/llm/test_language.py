from pyspark.sql import functions as F

from riskflow.llm import language
from riskflow.llm.common import remainder, table

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    out = language.predict(docs, language.fit(docs, remainder("doc_id", 4) != 2))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    held = out.filter(remainder("doc_id", 4) == 2)
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_odd_documents(odd, none):
    model = language.fit(odd, F.lit(True))
    got = {r.doc_id: r for r in language.predict(odd, model, keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 10)) and all(got[i].lang_pred != "und" for i in (1, 5, 6, 11))
    assert language.fit(none, F.lit(True)) is None and language.predict(none, model, keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None, keep=["doc_id"]).collect()} == {"und"}


def test_kernel_by_sets():
    texts = [b"the cat and the dog", b"le chat et le chien", b"der hund und die katze", b"the dog and a cat", b"un chien et un chat", b"die katze und der hund"]
    sets = [language.grams(t) for t in texts]
    model = language.solve(sets, ["en", "fr", "de"] * 2, landmarks=4)
    assert [model.languages[i] for i in model.scores(sets).argmax(axis=1)] == ["en", "fr", "de"] * 2
    plain = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "}
    assert [len(s) for s in sets] == [len(plain(t.decode())) for t in texts]
    assert len(language.grams(b"12 34")) == 0 == len(language.grams(None))
