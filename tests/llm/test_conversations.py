"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import zlib

import pytest

from barflow.llm import conversations, queries

STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def edits(rows):
    """(cost, audit, repaired) of rows of one conversation, (role, text, fault): the best of each state row by row, whole strings compared."""
    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    to = STEPS[state].get(role[0])
                    if to is not None:
                        best[to] = min(best.get(to, (1 << 30,)), (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return best

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in inserted(dict(best)).items():
            ways = [(state, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in STEPS[state]:
                    ways.append((STEPS[state][role[0]], (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                ways += [(STEPS[state][r[0]], (cost + more + 3, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant") if r[0] in STEPS[state]]
            for to, way in ways:
                after[to] = min(after.get(to, (1 << 30,)), way)
        best = after
    best = inserted(dict(best))
    return min(best[s] for s in (0, 3) if s in best)


def judged(rows):
    """What repair should say of one conversation, rows as (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = edits([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(n, long=False):
    r = random.Random(n)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(60, 90) if long else r.randrange(0, 9)):
            role = r.choices(["user", "assistant", "system", "tool", "", None, "unknown"], [8, 8, 3, 1, 1, 1, 1])[0]
            text = r.choices([f"Said {r.randrange(6)}.", "Open", "Why?\n ", "", " \t", None, f"é {turn}!"], [9, 3, 2, 1, 1, 1, 3])[0]
            out.append((conv, r.choice([turn, turn, turn, turn + 1, None]), role, text))
    return out + out[: len(out) // 9]


def results(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, row string").repartition(partitions)
    repaired = conversations.repair(df)
    replayed = conversations.replay(df, repaired)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    figures = {r.conv: tuple(r[n] for n in names) for r in repaired.conversations.collect()}
    ends = {r.conv: (r.audit, r.sha256) for r in conversations.digests(replayed).collect()}
    assert set(figures) == set(ends)
    lines = {}
    for r in sorted(conversations.repaired_rows(replayed).collect(), key=lambda r: (r.place, r.part)):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv, (_, sha) in ends.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == sha
    return {c: figures[c] + ends[c] for c in figures}


def wanted(rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return {c: judged(r) for c, r in by.items()}


def test_against_plain_search(spark):
    rows = made(300)
    assert results(spark, rows) == wanted(rows)


@pytest.mark.parametrize("block", [1, 7])
def test_conversations_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = made(12, long=True)
    assert results(spark, rows) == wanted(rows)


def test_a_hot_conversation(spark):
    rows = [(5, t // 3, r, x) for t in range(600) for r, x in [("user" if t % 4 else "assistant", f"{t}." if t % 7 else "same.")]] + [(5, 3, "user", "same.")] * 500 + [(6, 0, "user", "a.")]
    assert results(spark, rows, 8) == wanted(rows)


def test_solve_by_halves_and_edges(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 65, 300):
        letters = "".join(r.choice("suaoSUAO") for _ in range(n))
        got, said, cost = conversations.solve(letters, 0, conversations.END)
        audit = "".join(got).translate(str.maketrans(conversations.EDITS, conversations.SHOWN)) + "I" * len(conversations.ending(said))
        want = edits([({"s": "s", "u": "u", "a": "a"}.get(c.lower(), "x"), "", "truncated" if c.isupper() else "") for c in letters])
        assert (cost + 3 * len(conversations.ending(said)), audit) == want[:2]
    assert results(spark, [(1, None, None, None)]) == wanted([(1, None, None, None)])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repaired = conversations.repair(empty)
    assert repaired.conversations.count() == 0 and conversations.digests(conversations.replay(empty, repaired)).count() == 0


def test_query(spark, tmp_path):
    rows = made(60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left, every = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, text, role = zlib.crc32(name.encode()) % 20, text if text is not None else " ", role if role is not None else " "
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        left += [(conv, turn, "user" if fault == 4 else role, text)] * (fault != 0) * (2 if fault == 3 else 1)
    want = wanted(left)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversations(spark, str(tmp_path)).collect()}
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c in every}
