"""Repair of the turns of conversations by depth-first branch and bound."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import id_of, in_order, key_of, table, written

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\f\r"
#: Rows that are searched at a time; of longer conversations each part is searched for every state before and after it.
PART = 1024
#: States of the role initials: none yet, after s, after u, after a. What may follow each, and where an inserted turn leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = "uuau"
NEVER = 2**60
WHOLE = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def bounds(rows: list[tuple], exits: tuple[int, ...]) -> list[list[int]]:
    """For each suffix, what its rows cost at least from each state on. Which edits come first in the audit is left aside."""

    def with_inserts(least: list[int]) -> list[int]:
        for _ in range(3):
            least = [min(x, INSERT + least[NEXT[q][WANTED[q]]]) for q, x in enumerate(least)]
        return least

    least = with_inserts([0 if q in exits else NEVER for q in range(4)])
    out = [least]
    for letter, forced, extra, copies in reversed(rows):
        gone = DELETE * copies
        if forced:
            least = [gone + x for x in least]
        else:
            stays = extra + gone - DELETE
            least = [
                min(gone + least[q], stays + REROLE + least[NEXT[q][WANTED[q]]], stays + least[NEXT[q][letter]] if letter in NEXT[q] else NEVER)
                for q in range(4)
            ]
        least = with_inserts(least)
        out.append(least)
    return out[::-1]


def search(rows: list[tuple], entry: int = 0, exits: tuple[int, ...] = WHOLE) -> tuple[int, str] | None:
    """The least (cost, audit) of all edits of the rows that lead from state `entry` to one of `exits`.

    rows: (role initial, must go, cost of its truncation, copies in a row; all but one must go).
    A stack holds open nodes (rows done, state, cost, audit); the cheapest child by cost and suffix
    bound is taken first. A node goes when its bound is beyond the incumbent, or as dear with a
    prefix that is no longer least; or when its place was reached at less cost or by a lesser prefix.
    """
    least = bounds(rows, exits)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    n = len(rows)

    def worse(bound: int, audit: str) -> bool:
        return bound >= NEVER or best is not None and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)])

    while stack:
        i, q, cost, audit = stack.pop()
        if table.get((i, q), (cost, audit)) < (cost, audit) or worse(cost + least[i][q], audit):
            continue
        if i == n and q in exits and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [(i, NEXT[q][WANTED[q]], cost + INSERT, audit + "I")]
        if i < n:
            letter, forced, extra, copies = rows[i]
            if forced:
                children.append((i + 1, q, cost + DELETE * copies, audit + "D" * copies))
            else:
                more, rest = DELETE * (copies - 1), "D" * (copies - 1)
                children.append((i + 1, q, cost + DELETE + more, audit + "D" + rest))
                if letter in NEXT[q]:
                    children.append((i + 1, NEXT[q][letter], cost + extra + more, audit + "K" + rest))
                children.append((i + 1, NEXT[q][WANTED[q]], cost + REROLE + extra + more, audit + "R" + rest))
        open_ = []
        for child in children:
            j, p, c, a = child
            bound = c + least[j][p]
            if worse(bound, a) or ((j, p) in table and table[j, p] <= (c, a)):
                continue
            table[j, p] = (c, a)
            open_.append((bound, a, child))
        stack += [x[2] for x in sorted(open_, reverse=True)]
    return best


class Turns:
    """What is known of a conversation after some of its rows."""

    def __init__(self):
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last, self.rows, self.ways = None, [], {0: (0, "")}

    def search(self, exits) -> tuple[int, str] | None:
        """The least way to one of `exits`, over all ways so far."""
        found = [(c + x[0], a + x[1]) for q, (c, a) in self.ways.items() if (x := search(self.rows, q, exits))]
        return min(found, default=None)

    def fold(self):
        self.ways = {q: x for q in range(4) if (x := self.search((q,)))}
        self.rows = []


def take(state: Turns, columns: dict[str, list], a: int, b: int) -> None:
    names = ("copies", "initial", "no_turn", "turn", "blank", "again", "truncated")
    for copies, initial, no_turn, turn, blank, again, truncated in zip(*(columns[c][a:b] for c in names), strict=True):
        if not copies:
            continue
        if not no_turn and (state.turn is None or turn != state.turn):
            state.low = turn if state.low is None else state.low
            state.high = state.turn = turn
            state.turns += 1
        if state.last is not None and state.last + initial not in ("su", "ua", "au"):
            state.illegal += 1
        state.illegal += copies - 1  # a row and its copy have one initial
        state.last = initial
        state.blank += copies * blank
        state.duplicate += 0 if blank else copies - (not again)
        cut = truncated and not blank and not again
        state.truncated += cut
        state.rows.append((initial, blank or again, TRUNCATED * cut, copies))
        if len(state.rows) == PART:
            state.fold()


def end(key: str, state: Turns) -> list[tuple]:
    gaps = 0 if state.low is None else state.high - state.low + 1 - state.turns
    cost, audit = state.search(WHOLE)
    return [(key, gaps, state.blank, state.duplicate, state.truncated, state.illegal, cost, audit)]


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation (key) and its cheapest edits, from rows (key, turn, role, mark, text, copies)."""
    end_ = F.rtrim("text", F.lit(SPACE))
    facts = rows.select(
        "key", "turn", "role", "mark", "copies", F.substring("role", 1, 1).alias("initial"), (end_ == "").alias("blank"),
        (~F.substring(end_, -1, 1).isin(".", "!", "?")).alias("truncated"),
    ).repartition("key")
    once = facts.groupBy("key", "turn", "role", "mark", "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    seen = Window.partitionBy("key", "role", "mark", F.col("copies") > 0).orderBy("turn")
    marked = once.withColumn("again", F.row_number().over(seen) > 1)
    sent = ["copies", "initial", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "blank", "again", "truncated"]
    return in_order(marked, "key", ["turn", "role", "mark"], sent, "key string, " + FACTS, Turns, take, end)


class Text:
    """The repaired text of a conversation so far, as a running hash."""

    def __init__(self):
        self.sha, self.any, self.state, self.at, self.facts = hashlib.sha256(), False, 0, 0, None

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def new(self) -> str:
        """The role that an edit here gives."""
        initial = WANTED[self.state]
        self.state = NEXT[self.state][initial]
        return ROLES[initial]

    def edit(self) -> str:
        """The next edit; turns to insert before it are put."""
        audit = self.facts[-1]
        while self.at < len(audit) and audit[self.at] == "I":
            self.put(self.new(), "")
            self.at += 1
        self.at += 1
        return audit[self.at - 1 : self.at]


def take_text(state: Text, columns: dict[str, list], a: int, b: int) -> None:
    for k in range(a, b):
        if columns["facts"][k] is not None:
            state.facts = json.loads(columns["facts"][k])
            continue
        role, text = columns["role"][k], columns["text"][k]
        for _ in range(columns["copies"][k]):
            edit = state.edit()
            if edit == "K":
                state.state = NEXT[state.state][role[0]]
                state.put(role, text)
            elif edit == "R":
                state.put(state.new(), text)


def end_text(key: str, state: Text) -> list[tuple]:
    state.edit()  # turns inserted after the last row
    *numbers, audit = state.facts
    return [(key, *map(int, numbers), audit, state.sha.hexdigest())]


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of conversations.

    rows: conv_id, turn, role, text and copies (how often the row stands there; with 0 it only names its conversation).
    Nulls: a null conv_id is a conversation of its own; null turns come first; a null role or text is one
    space. Rows of one turn are ordered by role, then by the SHA-256 of role and text. Empty texts are blank;
    texts may have any length and conversations any number of rows: rows stream by in order, and the search takes PART
    of them at a time. Repeated rows are duplicates of the first. An empty table gives no rows;
    further columns are left aside. The audit and the hash of a conversation are made by one task, as SHA-256 is.
    """
    kind = dict(rows.dtypes)["conv_id"]
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(
        key_of("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("mark"), F.col("copies").cast("long").alias("copies"),
    )
    told = written(audits(rows), "audits")
    facts = told.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), F.to_json(F.array(*[F.col(c).cast("string") for c in told.columns[1:]])).alias("facts"))
    both = facts.unionByName(rows.where("copies > 0").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = in_order(
        both, "key", ["kind", "turn", "role", "mark"], ["facts", "role", "text", "copies"],
        f"key string, {FACTS}, repaired_sha256 string", Text, take_text, end_text,
    )
    return out.select(id_of("key", kind).alias("conv_id"), *out.columns[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with copies, as one in five is harmed by crc32(`conv_id:turn`) % 20; nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(told("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text")).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


#: DuckDB SQL for op11: the least (cost, audit) of each state, row by row; at most two turns are worth inserting at a place.
SQL = """
WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS c, coalesce(turn::VARCHAR, ' ') AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_transform(string_split(c || ':' || t, ''), lambda x: ord(x)::BIGINT),
  lambda a, x: list_reduce(range(8), lambda b, k: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)), 4294967295), 4294967295) % 20 AS harm FROM told),
harmed AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER w - 1 AS i, lag(role[1]) OVER w || role[1] AS two, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM harmed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy)),
r AS (SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS extra, blank OR again AS forced FROM placed),
convs AS (SELECT c.conv_id, count(r.i) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps, count(*) FILTER (r.blank) AS blank,
  count(*) FILTER (NOT r.blank AND r.again) AS duplicate, count(*) FILTER (NOT r.blank AND NOT r.again AND r.cut) AS truncated,
  count(*) FILTER (r.two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ins(q, p, a, x) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
nxt(q, e, p, name) AS (VALUES (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
st AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]} AS b FROM convs
  UNION ALL SELECT conv_id, i + 1, q, min(b) FROM (
    SELECT st.conv_id, st.i, ins.p AS q, {'c': st.b.c + 3 * length(ins.a) + 4, 'a': st.b.a || ins.a || 'D', 'x': st.b.x || ins.x} AS b
      FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.i = st.i JOIN ins ON ins.q = st.q
    UNION ALL SELECT st.conv_id, st.i, nxt.p, {'c': st.b.c + 3 * length(ins.a) + r.extra, 'a': st.b.a || ins.a || 'K', 'x': st.b.x || ins.x || [r.role || ':' || r.text]}
      FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.i = st.i AND NOT r.forced JOIN ins ON ins.q = st.q JOIN nxt ON nxt.q = ins.p AND nxt.e = r.role[1]
    UNION ALL SELECT st.conv_id, st.i, nxt.p, {'c': st.b.c + 3 * length(ins.a) + r.extra + 3, 'a': st.b.a || ins.a || 'R', 'x': st.b.x || ins.x || [nxt.name || ':' || r.text]}
      FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.i = st.i AND NOT r.forced JOIN ins ON ins.q = st.q JOIN nxt ON nxt.q = ins.p AND nxt.e <> 's')
  GROUP BY conv_id, i, q),
best AS (SELECT convs.conv_id, min({'c': st.b.c + 3 * length(ins.a), 'a': st.b.a || ins.a, 'x': st.b.x || ins.x}) AS b
  FROM convs JOIN st ON st.conv_id IS NOT DISTINCT FROM convs.conv_id AND st.i = convs.n JOIN ins ON ins.q = st.q AND ins.p IN (0, 3) GROUP BY convs.conv_id)
SELECT convs.conv_id, gaps, blank, duplicate, truncated, illegal, best.b.c AS cost, best.b.a AS audit, sha256(array_to_string(best.b.x, chr(10))) AS repaired_sha256
FROM convs JOIN best ON best.conv_id IS NOT DISTINCT FROM convs.conv_id
"""
