import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from devicelens.llm import conversation_repair as R
from devicelens.llm.queries import QUERIES

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SAY = {0: 2, 1: 2, 2: 3, 3: 2}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(":".join(name).encode()) % 20
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub(r"[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def brute_audit(initials, faults):
    """The cheapest, then least audit by dynamic programming over (cost, audit) pairs."""
    n = len(initials)
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        found = [[(0, "")] if i == n and s in (0, 3) else [] for s in range(4)]
        if i < n:
            more = 3 if faults[i] == 3 else 0
            for s in range(4):
                ways = [("D", 4, s)]
                if faults[i] not in (1, 2):
                    ways.append(("R", 3 + more, SAY[s]))
                    if (s, initials[i]) in NEXT:
                        ways.append(("K", more, NEXT[s, initials[i]]))
                found[s] += [(cost + best[i + 1][to][0], letter + best[i + 1][to][1]) for letter, cost, to in ways]
        for _ in range(3):
            for s in range(4):
                found[s] += [(3 + c, "I" + a) for c, a in found[SAY[s]]]
                found[s] = [min(found[s])] if found[s] else []
        best[i] = [f[0] for f in found]
    return best[0][0]


def brute_repair(rows):
    """By conversation, of rows after damage."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    result = {}
    for conv, some in groups.items():
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in some:
            shown = VISIBLE.findall(text)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            faults.append(fault)
            seen.add((role, text))
        initials = [r[2][:1] for r in some]
        turns = [r[1] for r in some if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = brute_audit(initials, faults)
        state, lines, i = 0, [], 0
        for letter in audit:
            if letter in "IR":
                state = SAY[state]
                role = {2: "user", 3: "assistant"}[state]
                lines.append(f"{role}:{some[i][3] if letter == 'R' else ''}")
            elif letter == "K":
                state = NEXT[state, initials[i]]
                lines.append(f"{some[i][2]}:{some[i][3]}")
            i += letter != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha)
    return result


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


CODES = st.integers(0, 15)


@given(st.lists(st.lists(CODES, max_size=12), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_paths_equal_brute_force(found):
    lists = [c for c in found if c]
    lengths = np.array([len(c) for c in lists], np.int64)
    codes = np.array([x for c in lists for x in c], np.int64)
    n = len(lists)
    paths = R.least_paths(codes, np.cumsum(lengths) - lengths, lengths, np.tile(R._EDGES, (n, 1)), np.ones(n, bool))
    for c, cost, audits in zip(lists, paths.costs, paths.audits):
        assert (cost[0], audits[0]) == brute_audit(["suax"[x // 4] for x in c], [x % 4 for x in c])


@given(st.lists(CODES, min_size=2, max_size=30), st.data())
@settings(max_examples=100, deadline=None)
def test_segments_fold_to_the_whole(found, data):
    """A conversation cut anywhere gives the audit of the uncut one."""
    cuts = sorted({0, *data.draw(st.lists(st.integers(1, len(found) - 1), max_size=4))})
    codes = np.array(found, np.int64)
    firsts, lengths = np.array(cuts), np.diff([*cuts, len(found)])
    ends, costs = [], R._EDGES
    for matrix in R.matrices(codes, firsts, lengths)[::-1]:
        ends.append(costs)
        costs = (matrix + costs[None, :]).min(axis=1)
    last = np.arange(len(cuts)) == len(cuts) - 1
    paths = R.least_paths(codes, firsts, lengths, np.array(ends[::-1]), last)
    state, audit = 0, ""
    for audits, exits in zip(paths.audits, paths.exits):
        audit += audits[state]
        state = exits[state]
    assert (costs[0], audit) == brute_audit(["suax"[x // 4] for x in found], [x % 4 for x in found])


SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello. "), (1, 2, "assistant", "Hello. "),
    (2, 5, "assistant", "no end"), (2, 5, "user", "?"), (2, None, None, None), (2, 9, "", "x."),
    (3, None, "user", ""), (3, None, "user", " \t\n"), (None, 1, "user", "lost."), (None, None, "tool", "é "),
    (4, 1, "user", "a." * 40_000), (4, 3, "unknown", "b."), (4, 3, "assistant", "b."), (5, 0, "user", "A."),
]


@pytest.mark.parametrize("segment", [1 << 14, 2])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    many = [(7, i // 3, ("user", "assistant", "tool")[i * i % 3], f"t{i % 50}" + ("." if i % 4 else "")) for i in range(300)]
    rows = [*ODD, *many]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS code", "'x' AS digest")
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = R.repair(turns.repartition(5))
    assert collected(found.conversations) == brute_repair(clean)
    said = defaultdict(list)
    for r in found.rows.orderBy("place", "part_order").collect():
        said[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, (*_, sha) in brute_repair(clean).items():
        assert hashlib.sha256("\n".join(said[conv]).encode()).hexdigest() == sha
    assert R.repair(turns.limit(0)).conversations.collect() == []


def test_damage_equals_brute_force(spark):
    rows = [*ODD, *[(c, t, "assistant", "One. Two!") for c in range(12) for t in range(9)]]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, map(tuple, R.damage(turns).collect()))) == sorted(map(str, brute_damage(rows)))


def test_op12_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_repair(brute_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    found = collected(QUERIES["op12_conversation_repair"](spark, sf_dir))
    assert found == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert len(found) >= 20 and len({x[6] for x in found.values()}) > 5


def test_conversations_without_rows_after_damage(spark):
    dropped = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(dropped, 0, "user", "x."), (None, 1, "user", None)], SCHEMA)
    found = collected(R.repaired_all(turns, R.damage(turns)))
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert set(found) == {dropped, None}
