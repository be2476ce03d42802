"""Repair of conversations, against a brute-force search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import turn_repair

BLANK = re.compile(r"[\x20\x09-\x0D]*")


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (row, last role), by cost and then audit: (cost, audit, lines)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, lines = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (k, last) in done:
            continue
        done.add((k, last))
        wanted = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", k, wanted, (*lines, ("user" if wanted == "u" else "assistant") + ":")))
        if k == len(rows):
            continue
        role, text, dead, cut = rows[k]
        heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last, lines))
        if not dead:
            if role[:1] == wanted or (role[:1] == "s" and last == ""):
                heapq.heappush(heap, (cost + 5 * cut, audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
            heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", k + 1, wanted, (*lines, ("user" if wanted == "u" else "assistant") + ":" + text)))


def expected(rows):
    """By conversation: the whole answer.  Rows of one turn must be equal."""
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: r[:2])
        seen, marked, faults = set(), [], Counter()
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, *_ in own if known}
        cost, audit, lines = cheapest(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.randint(-2, 3)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "Assistant"])
            text = rng.choice(["Yes.", "No!", "why", "so? ", " \n", "", None, "été", "a longer text\nof lines.", "x " + str(rng.randint(0, 5)) + "."])
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 4])
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (900, None, "user", "Hm."), (900, None, "user", "Hm."), (900, 3, "assistant", "Ha.")]
    rows += [(901, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(40)] + [(902, 5, "user", "a.")] * 7 + [(903, k, "assistant", "same.") for k in range(9)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, copies int, `a.b` string, conv string"


@pytest.mark.parametrize("piece,chunk", [(4096, 1 << 20), (3, 40)])
def test_repair(spark, monkeypatch, piece, chunk):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    rows = table()
    turns = spark.createDataFrame([(*r, 3, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_report(turn_repair.damaged(turns), turns).collect()}
    want = expected(spoiled(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: want.get(conv, nothing) for conv in {r[0] for r in rows}}


def test_undamaged_and_empty(spark):
    rows = [(conv, turn, "user" if role is None else role, text or " ") for conv, turn, role, text in table(3)]
    turns = spark.createDataFrame([(*r, 3, "x", "y") for r in rows], SCHEMA)
    conversations, lines = turn_repair.repair(turns)
    got = {(r.conv.id if r.conv.known else None): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in conversations.collect()}
    assert got == {conv: w[:-1] for conv, w in expected(rows).items()}
    for conv, w in expected(rows).items():
        own = [r for r in lines.collect() if (r.conv.id if r.conv.known else None) == conv] if conv in (None, 0, 1, 901) else None
        if own is not None:
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in sorted(own, key=lambda r: (r.known, r.turn, r.line))).encode()).hexdigest() == w[-1]
    assert turn_repair.repair_report(turns.limit(0), turns.limit(0)).count() == 0


def test_least_paths_rank_by_whole_audits():
    rng = np.random.default_rng(2)
    letter, target = rng.integers(1, 5, 400), np.minimum(np.arange(400) + rng.integers(1, 4, 400), 399)
    letter[399], target[399] = 0, 399
    letter[[50, 200]], target[[50, 200]] = 0, [50, 200]
    starts = np.arange(0, 400, 7)
    number, audits, last = turn_repair.least_paths(letter, target, starts)
    for s, n, end in zip(starts.tolist(), number.tolist(), last.tolist()):
        path = []
        while letter[s]:
            path.append(int(letter[s]))
            s = int(target[s])
        assert audits[n].tolist() == path and end == s
    assert [a.tolist() for a in audits] == sorted(a.tolist() for a in audits)
