import hashlib
import random

from pyspark.sql import functions as F

from riskflow.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<", "[", " ", "\n", "é", "ok", "☃", "/s>", "SYS>>"]


def test_round_trip_of_control_strings(spark):
    random.seed(4)
    rows = []
    for conv in range(60):
        for turn in range(random.randint(1, 7)):
            text = None if random.random() < 0.1 else "".join(random.choice(PIECES) for _ in range(random.randint(0, 12)))
            rows.append((conv if conv else None, turn, random.choice(["system", "user", "assistant", "assistant", "tool", "a\nb</s>", None, ""]), text))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_conv", F.lit(1)).withColumn("formatted", F.lit("x"))
    formatted = chat.format_conversations(turns)
    by = {}
    for r in rows:
        by.setdefault(r[0] or 0, []).append((r[2] or "", r[3] or ""))
    for r in formatted.collect():
        data = r.formatted.encode()
        told = [(a.decode(), b.decode()) for a, b in chat.parse(data)]
        assert told == by[r.conv_id or 0]
        assert "".join(chat.unescape(data[s.start : s.end]).decode() for s in r.loss_spans) == "".join(t for role, t in by[r.conv_id or 0] if role == "assistant")
    for r in chat.read_back(formatted).collect():
        own = by[r.conv_id or 0]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_long_and_repeated_turns(spark):
    turns = spark.range(20_000).select(F.lit(7).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    turns = turns.union(turns.limit(0)).union(spark.range(9).select(F.col("id") + 100, F.lit(0), F.lit("user"), F.repeat(F.lit("long "), 50_000)))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got[7].n_turns == 20_000 and len(got) == 10 and got[100].formatted_chars == 250_015
