"""Conversation repair against a search over all paths by cost and audit."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

CONV = "conv_id long, turn long, role string, text string"
NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn is not None, turn or 0, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return {c: sorted(r) for c, r in out.items()}


def best(rows, faults):
    """Dijkstra over (cost, audit) from the first row on: whole audits are compared."""
    queue, done = [(0, "", 0, "0", ())], set()
    while queue:
        cost, audit, i, state, made = heapq.heappop(queue)
        if i == len(rows) and state in "0a":
            return cost, audit, made
        if (i, state) in done:
            continue
        done.add((i, state))
        for c in "ua":
            if c in NEXT[state]:
                heapq.heappush(queue, (cost + 3, audit + "I", i, c, (*made, f"{NAMES[c]}:")))
        if i == len(rows):
            continue
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, made))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 if faults[i] == "truncated" else 0
            _, _, role, text = rows[i]
            if role[:1] and role[:1] in NEXT[state]:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*made, f"{role}:{text}")))
            for c in "ua":
                if c in NEXT[state]:
                    heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, c, (*made, f"{NAMES[c]}:{text}")))


def expected(table):
    rows, out = damaged(table), []
    for conv in {r[0] for r in table}:
        own, seen, faults = rows.get(conv, []), set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for there, t, _, _ in own if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = best(own, faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def talks(seed, n, longest):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "why?", "so", " ", "", "\t\n", "a b.", "é.  ", "x", "x.\n"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, longest)):
            text = None if rng.random() < 0.03 else rng.choice(words) if rng.random() < 0.6 else f"{rng.random()}."
            rows.append((c, rng.choice([t, t, t, t, t // 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ua", "User"]), text))
    rows += [(None, k, r, f"t{k}.") for k, r in enumerate(["user", "assistant", "assistant"])] + [(10**6, None, "system", "s."), (10**6 + 1, 0, "assistant", "x" * 300_000 + ".")]
    return rows


@pytest.mark.parametrize(("bits", "seed", "n", "longest"), [(12, 1, 150, 9), (2, 2, 60, 14), (1, 3, 8, 60)])
def test_repairs(spark, monkeypatch, bits, seed, n, longest):
    from cytolake.llm import conversation_repair as r

    monkeypatch.setattr(r, "BLOCK_BITS", bits)
    rows = talks(seed, n, longest)
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS conv", "2 AS block", "3 AS at").repartition(4)
    got = r.repair_report(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key = lambda x: (x[0] is not None, x[0] or 0)
    for a, b in zip(sorted((tuple(x) for x in got.collect()), key=key), sorted(expected(rows), key=key), strict=True):
        assert a == b


def test_repaired_turns_and_empty_tables(spark):
    from cytolake.llm import conversation_repair as r

    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes.")], "conv long, turn long, role string, text string")
    turns = r.repaired(rows, rows.select("conv").distinct()).orderBy("position").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Again."), ("K", "assistant", "Yes.")]
    assert r.repair_report(spark.createDataFrame([], CONV)).count() == 0


def test_ranks_order_nodes_by_their_strings():
    from cytolake.llm.conversation_repair import LETTERS, ranked_paths

    rng = np.random.default_rng(5)
    edges = np.full((200, 4), -1)
    for v in range(180):
        for k in rng.choice(4, rng.integers(1, 4), replace=False):
            edges[v, k] = rng.integers(v + 1, min(200, v + 9))
    rank, letter, pointers, length = ranked_paths(edges)
    strings = [""] * 200
    for v in range(199, -1, -1):
        strings[v] = min((LETTERS[k] + strings[edges[v, k]] for k in range(4) if edges[v, k] >= 0), default="")
    assert [len(s) for s in strings] == list(length)
    assert np.array_equal(np.unique(strings, return_inverse=True)[1], rank)
