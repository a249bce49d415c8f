import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm import turn_repair as tr

DDL = "conv_id long, turn long, role string, text string"
WANTED = re.compile(r"(s?(ua)+)?")
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Brute force over (row, last initial): all least-cost spellings, kept as whole strings.
    rows: (initial, truncated, must go); -> (cost, letters)."""
    best, queue = {}, [(0, "", 0, "")]
    while queue:
        cost, letters, i, last = heapq.heappop(queue)
        if (i, last) in best and best[i, last] <= (cost, letters):
            continue
        best[i, last] = (cost, letters)
        if i == len(rows) and last in ("", "a"):
            return cost, letters
        for to in FOLLOWS[last].replace("s", ""):
            heapq.heappush(queue, (cost + 2, letters + "I", i, to))
        if i < len(rows):
            initial, truncated, gone = rows[i]
            heapq.heappush(queue, (cost + 3, letters + "D", i + 1, last))
            if not gone:
                if initial and initial in FOLLOWS[last]:
                    heapq.heappush(queue, (cost + truncated, letters + "K", i + 1, initial))
                for to in FOLLOWS[last].replace("s", ""):
                    heapq.heappush(queue, (cost + 2 + truncated, letters + "R", i + 1, to))
    raise AssertionError


def all_ways(rows):
    """Every way with up to three insertions in a place; only for very short conversations."""
    found = []

    def go(i, cost, letters, roles):
        if not WANTED_PREFIX.fullmatch(roles):
            return
        if i == len(rows) and WANTED.fullmatch(roles):
            found.append((cost, letters))
        if not letters.endswith("III"):
            for to in "ua":
                go(i, cost + 2, letters + "I", roles + to)
        if i < len(rows):
            initial, truncated, gone = rows[i]
            go(i + 1, cost + 3, letters + "D", roles)
            if not gone:
                go(i + 1, cost + truncated, letters + "K", roles + (initial or "?"))
                for to in "ua":
                    go(i + 1, cost + 2 + truncated, letters + "R", roles + to)

    go(0, 0, "", "")
    return min(found)


WANTED_PREFIX = re.compile(r"s?(ua)*u?")
ROW = st.tuples(st.sampled_from(["s", "u", "a", ""]), st.integers(0, 1), st.sampled_from([False, False, True]))


def code(row):
    return tr.INITIALS.index(row[0]) | tr.TRUNCATED_BIT * row[1] if not row[2] else tr.GONE_BIT


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, max_size=4))
def test_least_repair_of_all_ways(rows):
    walk = tr.Walk()
    for row in rows:
        walk.add(code(row))
    assert walk.result() == all_ways(rows) == cheapest(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_blocks_change_nothing(block, monkeypatch):
    monkeypatch.setattr(tr, "BLOCK_ROWS", block)
    draw = random.Random(block)
    for n in range(40):
        rows = [(draw.choice(["s", "u", "u", "a", "a", ""]), draw.random() < 0.3, draw.random() < 0.2) for _ in range(n)]
        walk = tr.Walk()
        for row in rows:
            walk.add(code(row))
        assert walk.result() == cheapest(rows)


def test_long_conversation():
    walk, draw = tr.Walk(), random.Random(1)
    for _ in range(20_000):
        walk.add(code((draw.choice("uas"), draw.random() < 0.2, draw.random() < 0.1)))
    cost, letters = walk.result()
    assert cost > 0 and len(letters) - letters.count("I") == 20_000


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    tie = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    return sorted(out, key=tie)


def expected(conv, rows):
    rows = damage(rows)
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marked.append((role[:1] if role[:1] in ("s", "u", "a") else "", int(fault == 2), fault in (0, 1)))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters = cheapest(marked)
    out, i, last = [], 0, ""
    for letter in letters:
        following = "a" if last == "u" else "u"
        if letter == "I":
            out.append(("user" if following == "u" else "assistant") + ":")
            last = following
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "K":
            out.append(f"{role}:{text}")
            last = role[:1]
        elif letter == "R":
            out.append(("user" if following == "u" else "assistant") + f":{text}")
            last = following
    return (conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def talks(seed=3, n=60):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randrange(9)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = draw.choice(["Hi.", "No end", "  \t\n", "", None, "What? ", "é\x0b", "same.", "same.", "x" * 5000])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows + rows[:10] + [(None, 1, "user", "q?"), (None, 2, "assistant", "a.")]


def wanted(rows):
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    return sorted((expected(conv, found) for conv, found in by.items()), key=str)


def test_equals_brute_force(spark):
    rows = talks()
    frame = spark.createDataFrame(rows[::-1], DDL).selectExpr("*", "'x' AS copies", "'x' AS audit", "'x' AS seen")
    assert sorted((tuple(r) for r in tr.repair(frame).collect()), key=str) == wanted(rows)


def test_one_hot_conversation(spark):
    draw = random.Random(9)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["a.", "b", f"{t}!"])) for t in range(1500)]
    rows += [(c, 0, "user", "only.") for c in range(2, 60)]
    frame = spark.createDataFrame(rows, DDL)
    assert sorted((tuple(r) for r in tr.repair(frame).collect()), key=str) == wanted(rows)


def test_repaired_rows_are_well_formed(spark):
    found = {}
    for r in tr.repaired_rows(tr.damaged(spark.createDataFrame(talks(), DDL))).collect():
        found.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for turns in found.values():
        turns.sort()
        assert [p for p, *_ in turns] == list(range(len(turns)))
        assert WANTED.fullmatch("".join(role[:1] for _, role, _ in turns))


def test_conversation_that_is_dropped_whole_and_no_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = tr.repair(spark.createDataFrame([(5, turn, "user", "gone.")], DDL)).collect()
    assert [tuple(r) for r in rows] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert tr.repair(spark.createDataFrame([], DDL)).collect() == []
