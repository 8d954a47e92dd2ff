import random
import re
from collections import Counter

from riskflow.llm import line_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_counts_match_brute_force(spark, odd, none):
    random.seed(2)
    texts = [" ".join(random.choice(["a", "b", "c d", "c\n", "é", "#x|", "end.", "\n"]) for _ in range(random.randint(0, 60))) for _ in range(200)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), odd.select("doc_id", "text").schema))
    rows = line_rules.apply_rules(docs).collect()
    got = sorted((r.doc_id or 0, *r[1:6]) for r in rows)
    assert got == sorted((r.doc_id or 0, *brute(r.text)) for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed) for r in rows)
    assert line_rules.apply_rules(none).count() == 0


def test_lines(spark):
    prose = "\n".join(f"Sentence number {i} has words {i + 1} and {i + 2} that nobody has said before it, {i * 7}." for i in range(8))
    menu = "Home | News | Sport | Weather | Contact"
    cases = {"clean": (prose, True), "menu": (prose + "\n" + "\n".join(menu + str(i) for i in range(30)), False), "licence": (prose + "\nAll rights reserved.", True),
             "symbols": (prose.replace(" ", "### "), False), "shouting": ("\n".join(line.replace(" ", "!! ") for line in prose.split("\n")), False),
             "cut off": (prose[:-20], True)}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in line_rules.apply_rules(docs).collect()}
    assert {k: r.kept for k, r in got.items()} == {k: kept for k, (_, kept) in cases.items()}
    assert got["licence"].clean_text == prose and got["menu"].clean_text == prose and got["menu"].navigation_lines == 30
