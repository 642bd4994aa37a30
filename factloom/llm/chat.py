"""Conversations in a chat template, with the turns that they share at their beginnings written once."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import id_of, in_order, key_of, table, written

#: The template: how the turn of a role begins and ends. Of any other role: [ROLE]role[/ROLE]text</s>.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: A backslash goes before each control string and each backslash of a text; no control string begins inside another.
CONTROL = r"\[/?(?:SYS|INST|ROLE)\]|</?s>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\|{CONTROL})", r"\\$1")


def written_turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """(before, text, after) of a turn in the template."""
    before, after = F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]")), F.lit("</s>")
    for name, (a, b) in MARKS.items():
        before, after = F.when(role == name, a).otherwise(before), F.when(role == name, b).otherwise(after)
    return before, escaped(text), after


def read_turn(body: str) -> tuple[str, str]:
    """(role, text) of a turn in the template."""
    cuts = [m.span(1) for m in re.finditer(rf"\\.|({CONTROL})", body, re.DOTALL) if m[1]]
    plain = lambda s: re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL) if "\\" in s else s
    inside = [plain(body[a[1] : b[0]]) for a, b in zip(cuts, cuts[1:])]
    opening = body[: cuts[0][1]]
    if opening == "[ROLE]":
        role, text = inside
    else:
        (text,) = inside
        role = next(k for k, (a, _) in MARKS.items() if a == opening)
    return role, text


class Tree(NamedTuple):
    """What tree() gives.

    turns: one row for each turn that is written: start (its place in the whole, in code points), body, n_chars, k (its number
    in a conversation, from 1: a 1 begins a tree), position (position id of its first code point), loss_from and loss_to (the
    learned part of the body, null if none), until and attends. A code point at x may attend one at y if y <= x and x < until of
    y's turn; the same from the other side: it attends its own turn, those written right before it back to `run`, and the
    intervals [from, to) in `attends`.
    paths: (path, k, start), the turns of each different conversation by order.
    members: (conv_id, path).
    """

    turns: DataFrame
    paths: DataFrame
    members: DataFrame


def tree(conversations: DataFrame) -> Tree:
    """Merges conversations by the turns that they share from the first on, in depth-first order.

    A turn's mark is a 128-bit hash of all turns up to it, made by a window over each conversation. One of several equal
    conversations stands for them; these are sorted by the marks that two or more of them share, so that every subtree is a range of
    ranks, over however many tasks. A running sum within the ranges of that sort gives the places.
    Rows go by turn (null first), role and text hash; null roles and texts are empty; a null conv_id is a conversation;
    repeated rows are turns of their own; texts and conversations may have any length; an empty table gives empty
    tables; further columns are left aside.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    before, inner, after = written_turn(F.col("role"), F.col("text"))
    rows = conversations.select(key_of("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).select(
        "key", "turn", "role", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("mark"),
        F.concat(before, inner, after).alias("body"), F.length(before).alias("from"), F.length(inner).alias("inner"),
    )
    by = Window.partitionBy("key").orderBy("turn", "role", "mark")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    learned = F.col("role") == LEARNED
    rows = rows.withColumn("k", F.row_number().over(by)).select(
        "key", "k", "body", F.length("body").cast("long").alias("n_chars"),
        F.when(learned, F.col("from")).alias("loss_from"), F.when(learned, F.col("from") + F.col("inner")).alias("loss_to"),
        *[F.bit_xor(F.xxhash64(F.lit(seed), "k", "mark")).over(so_far).alias(f"m{seed}") for seed in (1, 2)],
        (F.sum(F.length("body")).over(so_far) - F.length("body")).cast("long").alias("position"), F.lead("k").over(by).isNull().alias("last"),
    )
    rows = written(rows, "turns")
    node = ["m1", "m2"]
    ends = rows.where("last").select("key", "k", *node)
    stands = ends.groupBy(node).agg(F.min("key").alias("key"), F.max("k").alias("turns"))
    light = rows.select("key", "k", "n_chars", *node).join(stands.select("key"), "key", "left_semi")
    shared = written(light.groupBy(node).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")  # so Spark can split a turn that very many share
    path = light.join(shared, node).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", *node))).alias("path"))
    ranked = stands.join(path, "key", "left").orderBy(F.col("path").asc_nulls_first(), "turns", "key")
    # ranks grow along the sort: its partition is in the upper 31 bits
    ranked = written(ranked.select("key", *node, F.monotonically_increasing_id().alias("path")), "ranks")
    light = written(light.join(ranked.select("key", "path"), "key"), "light")
    first = F.min_by(F.struct("key", "k", "n_chars"), "path").alias("first")
    new = light.groupBy(node).agg(F.min("path").alias("run"), F.max("path").alias("last"), first)
    new = new.select("first.*", *node, "run", "last", F.shiftright("run", 33).alias("part"))
    sizes = new.groupBy("part").agg(F.sum("n_chars").alias("size"))
    parts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))  # one row for each partition of the sort
    place = F.sum("n_chars").over(Window.partitionBy("part").orderBy("run", "k")) - F.col("n_chars")
    new = written(new.withColumn("start", place).join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base"), "places")
    stop = F.col("start") + F.col("n_chars")
    ending = new.groupBy(F.col("run").alias("last")).agg(F.max(stop).alias("until"))
    paths = written(light.select("path", "k", *node).join(new.select(*node, "run", "start", stop.alias("stop")), node), "paths")
    others = paths.where("run <> path").groupBy("path", "run").agg(F.min("start").alias("from"), F.max("stop").alias("to"))
    attends = others.groupBy(F.col("path").alias("run")).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("attends"))
    begin = new.groupBy("run").agg(F.min("start").alias("first"))
    turns = (
        new.select("key", "k", "run", "last", "start").join(ending, "last").join(begin, "run").join(attends, "run", "left")
        .join(rows.drop(*node, "last"), ["key", "k"])
    )
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    kind = dict(conversations.dtypes)["conv_id"]
    return Tree(
        turns.select("start", "k", "position", "body", "n_chars", "loss_from", "loss_to", "until", F.col("first").alias("run"), F.coalesce("attends", none).alias("attends")),
        paths.select("path", "k", "start"),
        ends.join(ranked.select(*node, "path"), node).select(id_of("key", kind).alias("conv_id"), "path"),
    )


class Read:
    """A conversation as read back so far."""

    def __init__(self):
        self.all, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0


def take(state: Read, columns: dict[str, list], a: int, b: int) -> None:
    for body, masked in zip(columns["body"][a:b], columns["masked"][a:b], strict=True):
        role, text = read_turn(body)
        state.all.update(f"{role}\n{text}\n".encode())
        state.n += 1
        state.chars += len(body)
        if masked is not None:
            learned = re.sub(r"\\(.)", r"\1", masked, flags=re.DOTALL)
            state.loss.update(learned.encode())
            state.loss_chars += len(learned)


def end(key: int, s: Read) -> list[tuple]:
    return [(key, s.n, s.all.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars)]


def read_back(out: Tree) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from the written turns."""
    turns = out.turns.select("start", "body", F.expr("substring(body, loss_from + 1, loss_to - loss_from)").alias("masked"))
    rows = out.paths.join(turns, "start").select("path", "k", "body", "masked")
    schema = "path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = in_order(rows, "path", ["k"], ["body", "masked"], schema, Read, take, end)
    return out.members.join(read, "path").drop("path")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = [conversations.sparkSession.range(1).selectExpr("-7L AS conv_id", f"{k}L AS turn", f"'{r}' AS role", f"'{said}' AS text") for k, r in enumerate(("user", "assistant"))]
    return reduce(DataFrame.unionByName, probe, conversations.select("conv_id", "turn", "role", "text"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(tree(with_probe(table(spark, sf_dir, "conversations"))))


#: DuckDB SQL for op12, without the tree: what must be read back.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, sha256(length(role) || ':' || role || text) AS mark, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 17 + length(regexp_replace(role, '(\\|\[/?(?:SYS|INST|ROLE)\]|</?s>)', '\\\1', 'g')) END
  + length(regexp_replace(text, '(\\|\[/?(?:SYS|INST|ROLE)\]|</?s>)', '\\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, mark)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, mark) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
