"""Repaired conversations against a search over all edits, and a plain reading of the whole contract."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tickloom.llm import conversations as C

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def after(roles):
    """Grammar state of role initials, None where they are no beginning of a good conversation."""
    return next((s for s, p in enumerate(("", "s", "s?(ua)*u", "s?(ua)+")) if re.fullmatch(p, roles)), None)


def search(rows):
    """(cost, audit, lines) by best-first search over edits; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = after(roles)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        ways = [(2, "I", i, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append((3, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                ways += [(late, "K", i + 1, role, text), *((2 + late, "R", i + 1, r, text) for r in ("user", "assistant"))]
        for more, edit, j, role, text in ways:
            now = roles if role is None else roles + (role[:1] or "?")
            if after(now) is not None:
                heapq.heappush(heap, (cost + more, audit + edit, j, now, lines if role is None else (*lines, f"{role}:{text}")))


def plain(rows):
    damaged, out = plain_damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            shown = text.rstrip(SPACES)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = search(judged)
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def chat(rng, conv, length):
    texts = ["Yes.", "No", "", " \t", "Why?", "Why?", "so it is", "a\nb.", "end.  \n", None, "Ä!", "  \x1c"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "usher"]
    return [(conv, rng.choice([None, *range(-2, length)]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {t}.") for t in range(length)]


@pytest.mark.parametrize("block", [1024, 2])
def test_random_conversations(spark, monkeypatch, block):
    """With blocks of two rows every conversation has seams."""
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rng = random.Random(11)
    rows = [r for conv in [None, *range(120)] for r in chat(rng, conv, rng.randrange(1, 10))]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ck string, copies int").repartition(5)
    assert got(C.repair(frame)) == plain(rows)


def test_signatures_against_search():
    letters = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "o": ("tool", None), "x": ("user", "blank")}
    letters |= {k.upper(): (role, "truncated") for k, (role, _) in letters.items() if k != "x"}
    rng, automaton = random.Random(2), C.SuffixAutomaton()
    every = {"".join(rng.choice(list(letters)) for _ in range(rng.randrange(8))) for _ in range(1500)}
    for signature in sorted(every, key=lambda s: s[::-1]):
        cost, audit, _ = search([(*letters[x][:1], "", letters[x][1]) for x in signature])
        assert automaton.best(signature) == (cost, audit), signature


def test_long_conversation_and_many_copies(spark):
    """A conversation with most rows, over several partitions and blocks, and a row that repeats a thousand times."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 9 else f"turn {t}") for t in range(3000)] + [(7, None, "user", "again.")] * 1000 + [(8, 0, "user", "hi!"), (8, 1, "assistant", "x" * 200_000 + ".")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert got(C.repair(frame)) == plain(rows)


def test_dropped_conversation_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert got(C.repair(frame)) == [repr((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]
    assert C.repair(frame.limit(0)).count() == 0


def test_small_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert got(C.repair(frame)) == plain(rows)
