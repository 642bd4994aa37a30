"""Byte-level BPE by a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

#: Distinct matches whose ids a task keeps; more start the store anew.
MATCHES_KEPT = 500_000
NONE = 1 << 62
#: White space but single spaces and line ends, and white space after white space.
ODD_SPACE = re.compile(r"[^\S \n]|\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern.

    A leaf of the tree holds, for the live token that begins at that byte, the rank of its pair with
    the next live token, joined with the place so that the minimum is the leftmost of least rank.
    A merge changes three leaves: the pair itself, its left neighbour's and the right token's.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(0, n - 2).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, tree = ranks.get, [NONE] * (2 * size)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            key = a if a < b else b
            if tree[k] == key:
                return
            tree[k] = key

    while (least := tree[1]) != NONE:
        i = least & 0xFFFFFFFF
        gone = after[i]
        j = after[gone]
        after[i] = j
        if j < n:
            before[j] = i
        if gone < n - 1:
            put(gone, NONE)
        r = rank(piece[i : after[j]]) if j < n else None
        put(i, NONE if r is None else r << 32 | i)
        if (h := before[i]) >= 0:
            r = rank(piece[h:j])
            put(h, NONE if r is None else r << 32 | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Words(dict):
    """Ids of words with a space before them, encoded when first asked for."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.tokens[k] = token
        white = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.matches = regex.compile(white).findall
        self.known: dict[str, bytes] = {}
        self.words = Words(self.encode_matches)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers.

        Where all white space of a text is single spaces and line ends, a match begins at every space,
        so the words between spaces are encoded one by one, each distinct one once.
        """
        if ODD_SPACE.search(text):
            return self.encode_matches(text)
        first, *rest = text.split(" ")
        words = self.words
        if len(words) > MATCHES_KEPT:
            words.clear()
        return self.encode_matches(first) + b"".join([words[w] for w in rest])

    def encode_matches(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.matches(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= MATCHES_KEPT:
                    known.clear()
                ids = array("I", merged(piece.encode(), self.ranks)).tobytes()
                if len(piece) < 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One for all tasks of a Python worker."""
    return Codec(read_ranks(ranks_path), pattern)


def with_ids(rows: DataFrame, *columns) -> DataFrame:
    """doc_id as a string, as pandas would round numbers beside a null, and the columns."""
    return rows.select(F.col("doc_id").cast("long").cast("string"), *columns)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each whole text: ids array<int>. Null text has no ids; repeated rows stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), dtype="<u4").astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return with_ids(docs, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id string, ids array<int>").withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def decode_documents(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data) of rows with doc_id and ids: data is the decoded bytes; null ids give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            data = [bpe.decode(np.asarray(i if i is not None else [], dtype="<u4").tobytes()) for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "data": data})

    return with_ids(rows, "ids").mapInPandas(run, "doc_id string, data binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to.

    Null text counts as empty (no ids); every row gives a row, repeated ones too; an empty table
    gives none; further columns are left aside. One pass over the texts, nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, sha = codec(ranks_path, pattern), hashlib.sha256
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [sha(i).hexdigest() for i in ids],
                "decoded_sha256": [sha(bpe.decode(i)).hexdigest() for i in ids],
            })

    rows = with_ids(docs, F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
