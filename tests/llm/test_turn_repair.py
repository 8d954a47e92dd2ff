"""Turn repair against all edit sequences of small conversations, and the defined edge cases."""

import hashlib
import itertools
import random

import pytest

from riskflow.llm import turn_repair as tr

EMPTY = hashlib.sha256(b"").hexdigest()



def _matches(initials):
    rest = initials.removeprefix("s")
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, edits, repaired) over every choice of edits with at most two insertions in a gap."""
    faults, best = fault_of(rows), None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    per_row = [[("D", 3, None)] if f in ("blank", "duplicate") else
               [("D", 3, None)] + [(e, c + (f == "truncated"), r) for e, c, r in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant"))]
               for (role, _), f in zip(rows, faults)]
    for picks in itertools.product(*per_row):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(p[1] for p in picks) + 2 * sum(map(len, gaps))
            if best is not None and cost > best[0]:
                continue
            letters, said = "", []
            for i in range(len(rows) + 1):
                for g in gaps[i]:
                    letters += "I"
                    said.append(("user" if g == "u" else "assistant", ""))
                if i < len(rows):
                    letters += picks[i][0]
                    if picks[i][2] is not None:
                        said.append((picks[i][2], rows[i][1]))
            if _matches("".join(r[:1] or "-" for r, _ in said)) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, said
    return best


def search(rows):
    run, out = tr.Repair(), []
    for (role, text), f in zip(rows, fault_of(rows)):
        out += run.push(role[:1], (role, text), f in ("blank", "duplicate"), f == "truncated")
    edits = out + run.finish()
    return "".join(e.letter for e in edits), [(e.role or e.row[0], e.row[1] if e.row else "") for e in edits if e.letter != "D"]


def test_equals_all_edit_sequences():
    rng = random.Random(5)
    for n in (0, 1, 1, 2, 2, 3, 3, 3):
        for _ in range(60 if n < 3 else 25):
            rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "c", "", "d?"])) for _ in range(n)]
            _, letters, said = brute(rows)
            assert search(rows) == (letters, said), rows


def plain(rows):
    """The same search with whole strings in each state."""
    best = {0: (0, "")}
    for (role, _), f in zip(rows + [(None, None)], fault_of(rows) + [None]):
        for s in (0, 1, 3, 2):
            if s in best:
                to, new = tr.NEXT[s], (best[s][0] + 2, best[s][1] + "I")
                best[to] = min(best.get(to, new), new)
        if role is None:
            return min(best[s] for s in (0, 3) if s in best)
        after = {}
        for s, (c, e) in best.items():
            new = [(s, c + 3, "D")]
            if f not in ("blank", "duplicate"):
                k, to = f == "truncated", tr.NEXT[s]
                new.append((to, c + 2 + k, "R"))
                if role[:1] == "s" and s == 0:
                    new.append((1, c + k, "K"))
                elif role[:1] == tr.ROLE[to][0]:
                    new.append((to, c + k, "K"))
            for to, cost, letter in new:
                after[to] = min(after.get(to, (cost, e + letter)), (cost, e + letter))
        best = after


def test_long_conversations_with_ties_coalesce():
    rng = random.Random(6)
    for roles in (["user", "assistant"], ["user", "assistant", "system"], ["tool"], ["system", "tool", "user"]):
        rows = [(rng.choice(roles), f"{rng.randrange(400)}{rng.choice(['.', ''])}") for _ in range(300)]
        assert search(rows)[0] == plain(rows)[1]
    run, most, rows = tr.Repair(), 0, [("assistant" if i % 2 else "user", f"{i}.") for i in range(2000)]
    waiting = 0
    for r in rows:
        waiting += 1 - len(run.push(r[0][0], r, False, False))
        most = max(most, waiting)
    assert most < 8


def test_edge_cases(spark):
    turns = spark.createDataFrame([
        (1, None, "user", "hi.", True, 1), (1, 3, "assistant", "ok", True, 1), (1, 7, "assistant", "ok", True, 1), (1, 7, "assistant", "ok", True, 1),
        (2, 0, None, None, True, 1), (3, 0, "user", "gone.", False, 1), (None, 1, "user", "x.", True, 1), (None, 2, "assistant", "y.", True, 1),
    ], "conv_id long, turn long, role string, text string, live boolean, audit int")
    edits = tr.repair(turns, live="live")
    got = {r["conv_id"]: r for r in tr.audit(edits).collect()}
    assert len(got) == 4
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"], one["cost"], one["audit"]) == (3, 0, 2, 1, 2, 7, "KKDD")
    assert one["repaired_sha256"] == hashlib.sha256(b"user:hi.\nassistant:ok").hexdigest()
    assert (got[2]["audit"], got[2]["blank"], got[2]["cost"], got[2]["repaired_sha256"]) == ("D", 1, 3, EMPTY)
    assert (got[3]["audit"], got[3]["gaps"], got[3]["cost"], got[3]["repaired_sha256"]) == ("", 0, 0, EMPTY)
    assert (got[None]["audit"], got[None]["gaps"]) == ("KK", 0)
    assert tr.audit(tr.repair(turns.limit(0))).count() == 0
    kept = [(r["role"], r["text"], r["edit"], r["was"]) for r in edits.filter("conv_id = 1 and edit <> 'D'").collect()]
    assert kept == [("user", "hi.", "K", "user"), ("assistant", "ok", "K", "assistant")]


def test_very_long_text_and_batches(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{'x' * 50_000 if t == 0 else t}.") for c in range(20) for t in range(300)]
    got = tr.audit(tr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 20 and {r["audit"] for r in got} == {"K" * 300} and {r["cost"] for r in got} == {0}


@pytest.mark.parametrize("kind", range(5))
def test_damage(spark, kind):
    import zlib

    keys = [(c, t) for c in range(40) for t in range(4)]
    hit = [k for k in keys if zlib.crc32(f"{k[0]}:{k[1]}".encode()) % 20 == kind]
    turns = spark.createDataFrame([(c, t, "assistant", "a.b!c?") for c, t in keys], "conv_id long, turn long, role string, text string")
    got = {}
    for r in tr.damaged(turns).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["live"]))
    want = [[("assistant", "a.b!c?", False)], [("assistant", "", True)], [("assistant", "abc", True)], [("assistant", "a.b!c?", True)] * 2, [("user", "a.b!c?", True)]]
    assert hit and all(got[k] == want[kind] for k in hit)
