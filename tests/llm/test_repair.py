"""Repair of conversations against a plain search, and its odd cases."""

import hashlib
import random
from itertools import product

import pytest

from factloom.llm import repair

ROLES = {"u": "user", "a": "assistant"}


def plain(rows):
    """All edits of a short conversation, by a table of every state: (cost, audit)."""
    ways = {0: {(0, "")}}
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(ways):
        out = {q: set(x) for q, x in ways.items()}
        for _ in range(3):
            for q, e in product(list(out), "ua"):
                if (q, e) in nxt:
                    out.setdefault(nxt[q, e], set()).update((c + 3, a + "I") for c, a in list(out[q]))
        return {q: sorted(x)[:200] for q, x in out.items()}

    for letter, forced, extra, copies in rows:
        for first in [True] + [False] * (copies - 1):
            new = {}
            for q, found in inserted(ways).items():
                for c, a in found:
                    new.setdefault(q, set()).add((c + 4, a + "D"))
                    if first and not forced:
                        if (q, letter) in nxt:
                            new.setdefault(nxt[q, letter], set()).add((c + extra, a + "K"))
                        for e in "ua":
                            if (q, e) in nxt:
                                new.setdefault(nxt[q, e], set()).add((c + 3 + extra, a + "R"))
            ways = {q: set(sorted(x)[:200]) for q, x in new.items()}
    return min(x for q, found in inserted(ways).items() if q in (0, 3) for x in found)


def some_rows(r, n):
    return [(r.choice("suat"), r.random() < 0.2, 3 * (r.random() < 0.2), r.choice([1, 1, 1, 2])) for _ in range(n)]


def test_search_equals_all_edits():
    for seed in range(400):
        r = random.Random(seed)
        rows = some_rows(r, r.randint(0, 7))
        assert repair.search(rows) == plain(rows), rows


def test_search_in_parts_equals_the_whole():
    for seed in range(40):
        r = random.Random(seed)
        rows = some_rows(r, r.randint(0, 60))
        state = repair.Turns()
        for k, row in enumerate(rows):
            state.rows.append(row)
            if k % 7 == 6:
                state.fold()
        assert state.search(repair.WHOLE) == repair.search(rows)


def test_bounds_are_bounds():
    for seed in range(60):
        r = random.Random(seed)
        rows = some_rows(r, 6)
        for exits in ((0, 3), (2,), (1,)):
            least = repair.bounds(rows, exits)
            for i in range(len(rows) + 1):
                for q in range(4):
                    found = repair.search(rows[i:], q, exits)
                    assert found is None or least[i][q] <= found[0]


SCHEMA = "conv_id long, turn long, role string, text string, copies int, key string, cost int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, 0, "user", "Hi.", 1, "x", 1), (1, 1, "user", "Yes?", 1, "x", 1), (1, 1, "assistant", "cut", 1, "x", 1),
        (2, None, "assistant", "Late.", 1, None, None), (2, 0, None, None, 1, None, None), (2, 3, "system", "S.", 1, None, None),
        (None, 0, "user", "No id.", 1, None, None), (3, 0, "user", "gone", 0, None, None), (4, 5, "user", "Twice!", 2, None, None),
        (5, 0, "", "No role.", 1, None, None), (6, 0, "user", "word. " * 200_000 + "end.", 1, None, None), (6, 1, "assistant", "\x0b\t ", 1, None, None),
    ], SCHEMA)


def test_repair(rows):
    got = {r.conv_id: r for r in repair.repaired(rows).collect()}
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    facts = {k: tuple(r)[1:8] for k, r in got.items()}
    assert facts == {
        # turn 1: the assistant's row comes first, as rows of one turn go by role
        1: (0, 0, 0, 1, 0, 6, "KKKI"), 2: (2, 1, 0, 0, 2, 10, "RDR"), None: (0, 0, 0, 0, 0, 3, "KI"), 3: (0, 0, 0, 0, 0, 0, ""),
        4: (0, 0, 1, 0, 1, 7, "KDI"), 5: (0, 0, 0, 0, 0, 4, "D"), 6: (0, 1, 0, 0, 0, 7, "KDI"),
    }
    assert got[1].repaired_sha256 == sha("user:Hi.", "assistant:cut", "user:Yes?", "assistant:")
    assert got[3].repaired_sha256 == sha() and got[None].repaired_sha256 == sha("user:No id.", "assistant:")
    assert repair.repaired(rows.limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    r = random.Random(5)
    data = [(1, k, r.choice(["user", "assistant", "system"]), r.choice(["A.", f"B{k}", "", f"C{k}!"]), 1, None, None) for k in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    one = repair.repaired(df).collect()
    monkeypatch.setattr(repair, "PART", 10_000)
    seen, whole = set(), []
    for _, _, role, text, *_ in data:
        forced = not text or (role, text) in seen
        seen.add((role, text))
        whole.append((role[0], forced, 3 * (not forced and text[-1] not in ".!?"), 1))
    assert (one[0].cost, one[0].audit) == repair.search(whole)
