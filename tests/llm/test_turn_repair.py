"""Turn repair against all edit sequences, and against a plain replay of whole conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from fluvia.llm import queries, turn_repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(symbols):
    """Least (cost, audit) over all edit sequences, without a table of target lengths: a search over prefixes."""
    best, done = None, {}
    heap = [(0, "", 0, "")]  # cost, audit, row, last role
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(symbols) and last in ("", "a"):
            best = min(best, (cost, audit)) if best else (cost, audit)
            continue
        if done.get((i, last), cost) < cost or (len(symbols) > 12 and (i, last) in done):  # all equal ways of short lines
            continue
        done[i, last] = cost
        step = NEXT[last]
        heapq.heappush(heap, (cost + 5, audit + "I", i, step))
        if i < len(symbols):
            c = symbols[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if c != "x":
                extra = 5 * c.isupper()
                if c.lower() == step or (c.lower() == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, c.lower()))
                if c.lower() != step:
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, step))
    return best


def test_alignments():
    rng = random.Random(2)
    lines = ["".join(p) for n in range(4) for p in itertools.product("suaoxSUAO", repeat=n)]
    lines += ["".join(rng.choices("suaoxSUA", (1, 6, 6, 1, 1, 1, 1, 1), k=rng.randint(4, 9))) for _ in range(400)]
    for line in lines:
        want = brute(line)
        assert turn_repair.aligned(line) == want, line
        cost, pieces = turn_repair.folded(line)
        assert (cost, "".join(pieces)) == want, line


def test_long_lines(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(turn_repair, "PIECE", 7)
    for n in (13, 14, 40, 64):
        line = "".join(rng.choices("suaoxUA", (1, 8, 8, 1, 1, 1, 1), k=n))
        cost, pieces = turn_repair.folded(line)
        assert (cost, "".join(pieces)) == turn_repair.aligned(line)


def replay(rows):
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen, line = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), ""
        for _, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if fault:
                faults[fault] += 1
            line += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = brute(line)
        turns, last, at = [], "", 0
        for edit in audit:
            row = own[at] if edit != "I" else (None, "", "")
            at += edit != "I"
            if edit == "D":
                continue
            last = row[1][0] if edit == "K" else NEXT[last]
            turns.append((row[1] if edit == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + row[2])
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        sha = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, sha)
    return out


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_turn_repair(spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == replay(rows) and len(got) == len({r[0] for r in rows})


def test_edges(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "No!", "cut", "", " \n", None, "é?\t ", "x" * 300_000 + ".", "."]
    rows = [(c, rng.choice([*range(6), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += rows[:40] + [(99, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(300)] + [(98, None, "user", "a.")] * 3
    wide = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    got = turn_repair.repair(wide).collect()
    want = replay(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r[0]], r[0]
    assert turn_repair.repair(wide.limit(0)).count() == 0


@pytest.mark.parametrize("n", [turn_repair.WHOLE, turn_repair.WHOLE + 1, 2000])
def test_one_long_conversation(spark, n):
    rng = random.Random(n)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", "!", ""])) for i in range(n)]
    got = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert tuple(got)[1:] == replay(rows)[7]
