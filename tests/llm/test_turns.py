"""Repair of conversations against exhaustive search and a search from the end."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from paperloom.llm import turns

sys.setrecursionlimit(20_000)

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, fault int"


def damaged(rows):
    """(turn, role, text) of a conversation's rows after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def apply(edits, rows, bad):
    """Cost and (role, text) of the result of edits ('I' with its role, 'R' with its role)."""
    cost, out, i = 0, [], 0
    for edit in edits:
        if edit[0] == "I":
            cost, out = cost + 3, [*out, (edit[1], "")]
            continue
        _, role, text = rows[i]
        if edit == "D":
            cost += 4
        elif bad[i] in ("blank", "duplicate"):
            return None
        else:
            cost += (3 if bad[i] == "truncated" else 0) + (3 if edit[0] == "R" else 0)
            out.append((edit[1] if edit[0] == "R" else role, text))
        i += 1
    return cost, out


def exhaustive(rows, inserts=2):
    """The cheapest edits among all with up to so many inserts before each row and at the end."""
    bad = faults(rows)
    new = [("I", "user"), ("I", "assistant")]
    gaps = [g for n in range(inserts + 1) for g in itertools.product(new, repeat=n)]
    best = None
    for own in itertools.product(["D", "K", ("R", "user"), ("R", "assistant")], repeat=len(rows)):
        if any(e != "D" and b in ("blank", "duplicate") for e, b in zip(own, bad, strict=True)):
            continue
        for around in itertools.product(gaps, repeat=len(rows) + 1):
            edits = [x for g, e in itertools.zip_longest(around, own) for x in (*g, *([e] if e else []))]
            cost, out = apply(edits, rows, bad)
            if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                continue
            found = (cost, "".join(e[0] for e in edits), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best or found, found)
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def from_the_end(rows):
    """Cheapest cost and least audit by whole suffixes, for conversations of any length."""
    bad = faults(rows)
    order = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, ""))
        if inserted < 3:
            ways += [(3 + c, "I" + s) for r in order[last] if r != "s" for c, s in best(i, r, inserted + 1)]
        if i < len(rows):
            ways += [(4 + c, "D" + s) for c, s in best(i + 1, last, 0)]
            if bad[i] in ("ok", "truncated"):
                more, initial = 3 if bad[i] == "truncated" else 0, rows[i][1][:1]
                if initial and initial in order[last]:
                    ways += [(more + c, "K" + s) for c, s in best(i + 1, initial, 0)]
                ways += [(more + 3 + c, "R" + s) for r in order[last] if r != "s" for c, s in best(i + 1, r, 0)]
        return (min(ways),) if ways else ()

    return best(0, "", 0)[0]


def expected(conversations):
    """Rows of the result by conversation."""
    groups = {}
    for row in conversations:
        groups.setdefault(row[0], []).append(row)
    out = []
    for conv, rows in groups.items():
        rows = damaged(rows)
        bad, known = faults(rows), [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = from_the_end(rows)
        out.append((conv, gaps, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, repaired(rows, audit)))
    return out


def repaired(rows, audit):
    last, lines, left = "", [], list(rows)
    for edit in audit:
        row = None if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
        last = role[:1]
        lines.append(f"{role}:{row[2] if row else ''}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def rows_of(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()), key=str)


def run(rows):
    """The streaming search on rows after damage."""
    tally, seen = turns.Tally(0), set()
    for (turn, role, text), bad in zip(rows, faults(rows), strict=True):
        kind = ["ok", "blank", "duplicate", "truncated"].index(bad)
        tally.add(turn, role, text, kind, 1)
        seen.add((role, text))
    return tally.row()[-3:]


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    texts = ["a.", "b.", "c?", "d", "e", " ", "f.", "g!", "h"] + [f"t{i}." for i in range(12)]
    return [(i, rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 2, 2, 2, 2, 2):
        for _ in range(4):
            rows = random_rows(rng, n)
            assert run(rows) == exhaustive(rows), rows


@pytest.mark.parametrize("n", [1, 3, 5, 9, 30, 120])
def test_against_search_from_the_end(n):
    rng = random.Random(n)
    for _ in range(60):
        rows = random_rows(rng, n)
        cost, audit = from_the_end(rows)
        assert run(rows) == (cost, audit, repaired(rows, audit)), rows


def test_memory_is_bounded_by_open_edits():
    """A long conversation is emitted on the way, and the released part of the tree is gone."""
    repair, most = turns.Repair(), 0
    for i in range(30_000):
        repair.feed("user" if i % 2 == 0 else "assistant", "Text.", turns.OK if i % 7 else turns.TRUNCATED)
        most = max(most, len(repair.pending))
        nodes, todo = set(), [s[2] for s in repair.survivors if s]
        while todo and i % 5000 == 0:
            node = todo.pop()
            if id(node) not in nodes:
                nodes.add(id(node))
                todo += [node.parent] if node.parent else []
        assert len(nodes) <= 4 * (len(repair.pending) + 1)
    assert most < 20
    assert repair.finish()[1].count("K") > 29_000


def test_given_conversations(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(turns.repair_conversations(given)) == sorted(expected(rows), key=str)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rng, rows = random.Random(5), []
    texts = ["Same.", "Same.", "Other", None, "", " \n", "Last one!", "x" * 50, "é. "]
    for conv in [*range(150), None]:
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", None, "", "tool"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7, -2]), role, rng.choice(texts)))
    rows += rows[:40]  # equal rows
    given = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(5)
    want = sorted(expected(rows), key=str)
    assert rows_of(turns.repair_conversations(given)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(turns.repair_conversations(given)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_long_conversation_and_an_empty_table(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", "Hot text." if i % 4 else f"Turn {i}") for i in range(700)]
    rows.append((2, 0, "user", "long " * 400_000 + "."))
    given = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert rows_of(turns.repair_conversations(given)) == sorted(expected(rows), key=str)
    assert turns.repair_conversations(given.limit(0)).count() == 0


def test_conversation_without_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    given = spark.createDataFrame([(5, turn, "user", "Gone.", None, None)], SCHEMA)
    assert rows_of(turns.repair_conversations(given)) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
