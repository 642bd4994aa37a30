"""The prefix tree against plain conversations, and its odd cases."""

import hashlib
import random
from collections import defaultdict

import pytest

from factloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, k int"


def some(seed, n):
    r = random.Random(seed)
    out = []
    for c in range(n):
        first = r.choice("AB")
        for k in range(r.randint(1, 6)):
            text = first if k == 0 else r.choice(["x", "y <s> z", r"back\slash [/INST]", "é😀"])
            out.append((c, k, "user" if k % 2 == 0 else "assistant", text, "k", 1))
    return out


ODD = [
    (None, None, None, None, None, None), (None, 2, "tool</s>", "a\\", "k", 1), (900, 1, "assistant", "", "k", 1), (900, 1, "assistant", "", "k", 1),
    (901, 0, "system", "\\<s>[ROLE]\\\\" + "long " * 100_000, "k", 1), (902, 0, "", "no role\n", "k", 1),
]


@pytest.fixture(scope="module")
def rows():
    return some(1, 60) + ODD


def by_conversation(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        out[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in out.items()}


def test_read_back(spark, rows):
    out = chat.tree(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(out).collect()}
    want = {}
    for c, turns in by_conversation(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: x[:4] for c, x in got.items()} == want
    assert chat.read_back(chat.tree(spark.createDataFrame([], SCHEMA))).count() == 0


def test_tree(spark, rows):
    """Every shared beginning is written once, and what a place attends is its own conversation up to it."""
    out = chat.tree(spark.createDataFrame(rows, SCHEMA))
    turns = sorted(out.turns.collect(), key=lambda r: r.start)
    plain = by_conversation(rows)
    assert len(turns) == len({tuple(x[:k]) for x in plain.values() for k in range(1, len(x) + 1)})
    at = 0
    for r in turns:  # gapless
        assert r.start == at and r.n_chars == len(r.body) and (r.k > 1 or r.position == 0)
        at += r.n_chars
    starts = {r.start: r for r in turns}
    paths = defaultdict(list)
    for r in out.paths.collect():
        paths[r.path].append((r.k, r.start))
    members = {r.conv_id: r.path for r in out.members.collect()}
    assert set(members) == set(plain)
    for c, path in members.items():
        chain = [starts[s] for _, s in sorted(paths[path])]
        assert [chat.read_turn(r.body) for r in chain] == plain[c]
        for k, r in enumerate(chain):
            assert r.position == sum(x.n_chars for x in chain[:k]) and r.k == k + 1
            seen = {x.start for x in turns if x.start <= r.start < x.until}  # who may be attended, from their side
            assert seen == {x.start for x in chain[: k + 1]}
            own = [x.start for x in turns if r.run <= x.start <= r.start]  # and from this side
            other = [x.start for x in turns if any(a <= x.start < b for a, b in r.attends)]
            assert {*own, *other} == seen
            loss = None if r.loss_from is None else r.body[r.loss_from : r.loss_to]
            assert (loss is not None) == (plain[c][k][0] == "assistant")


def test_template_is_reversible(spark):
    r = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/ROLE]", "[ROLE]", "\\", "[", "<", "s>", "/", "a", "\n", ""]
    data = [(k, r.choice(["user", "assistant", "system", "tool", "".join(r.choices(bits, k=3))]), "".join(r.choices(bits, k=r.randint(0, 12)))) for k in range(400)]
    df = spark.createDataFrame(data, "i int, role string, text string")
    body = chat.F.concat(*chat.written_turn(chat.F.col("role"), chat.F.col("text")))
    assert all(chat.read_turn(x.body) == (x.role, x.text) for x in df.withColumn("body", body).collect())
