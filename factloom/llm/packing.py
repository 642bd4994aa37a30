"""Best-fit packing of token pieces into sequences."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import table, written

CAPACITY = 4096
END_ID = 1
#: Distinct runs whose ids a worker keeps, and as many of those before them.
WORDS_KEPT = 300_000
#: White space in Unicode, and what Python's split takes for it besides.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATOR = re.compile("[\\x1c-\\x1f]")
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printed, else the next from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printed)
    return {b: 256 + k for k, b in enumerate(others)}


class Runs(dict):
    """The bytes of the ids of runs, encoded when first asked for; of earlier runs the last `kept` or more stay."""

    def __init__(self, library, kept: int = WORDS_KEPT) -> None:
        self.encode, self.model, self.kept, self.old = library.encode_batch_fast, library.model.tokenize, kept, {}
        self.letters = byte_letters()

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            word = run[:-1]
            if run.isalpha():  # one match of the file's pattern, so its model can be asked at once
                letters = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model(letters)]).tobytes()
            elif run[-1:] in (",", ".") and word[-1:].isalpha():  # the pattern splits between the two
                ids = self[word] + self[run[-1]]
            else:
                ids = array("I", self.encode([run], add_special_tokens=False)[0].ids).tobytes()
        self[run] = ids
        return ids

    def trimmed(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Texts to the bytes of their ids (little-endian, 32 bits), as the tokenizers library gives them.

    The file's pre-tokenizer drops white space and splits what lies between without a look at its
    neighbours. So each distinct run of other characters is encoded once, by the library, and then
    looked up. A text that holds one of the file's special tokens goes to the library as it stands.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers

        self.whole, library = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.normal = self.whole.normalizer.normalize_str
        library.normalizer = normalizers.Sequence([])  # the runs come from normal text
        self.known = Runs(library)

    def runs(self, text: str) -> list[str]:
        """Python's lower and split are the file's rules but for a few characters, which go to the library."""
        if text.isascii():
            text = text.lower()
        elif "\u03a3" in text:
            text = self.normal(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return SPACE.split(text) if SEPARATOR.search(text) else text.split()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        self.known.trimmed()
        return b"".join(map(self.known.__getitem__, self.runs(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut at the capacity.

    Ids of rows go through Python as strings, as pandas would round them beside a null.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(encode(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """How many of each length go where: rows (length, first rank, first bin, per bin, offset), and the number of bins.

    Lengths above a third of the capacity fit at most twice into a bin. They are matched greedily:
    the longest left with the longest left that fits beside it. Then the others, longest first,
    go where the least room is left that holds them; a new bin opens where none does. Bins with
    the same room left are filled together as ranges, so the work depends on the number of distinct
    lengths (at most the capacity), not on the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    placed: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of bins
    bins = 0

    def put(size: int, first: int, n_bins: int, each: int, offset: int) -> None:
        placed.append((size, ranks[size], first, each, offset))
        ranks[size] += n_bins * each

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = np.searchsorted(large, capacity - a, side="right") - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            n, rest = left[a], capacity - a
            put(a, bins, n, 1, 0)
            left[a] = 0
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # one of this length is left over: its partner is the next shorter
                shorter = [x for x in large[:at] if left[x]]
                put(a, bins, 1, 1, 0)
                n, rest = 1, capacity - a
                left[a] = 0
                if shorter:
                    b = shorter[-1]
                    put(b, bins, 1, 1, a)
                    left[b] -= 1
                    rest -= b
            elif a == b:
                put(a, bins, n, 2, 0)
                left[a] -= 2 * n
                rest = capacity - 2 * a
            else:
                put(a, bins, n, 1, 0)
                put(b, bins, n, 1, a)
                left[a] -= n
                left[b] -= n
                rest = capacity - a - b
        room[rest].append((bins, bins + n))
        bins += n

    levels = np.zeros(capacity + 1, dtype=bool)
    for rest in room:
        levels[rest] = True
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[size]
        while n:
            fits = np.flatnonzero(levels[size:])
            if len(fits):
                rest = size + int(fits[0])
                first, end = room[rest].pop()
                if not room[rest]:
                    levels[rest] = False
            else:
                rest, first = capacity, bins
                end = bins + -(-n // (capacity // size))
                bins = end
            each = rest // size
            full = min(end - first, n // each)
            if full:
                put(size, first, full, each, capacity - rest)
                room[rest - each * size].append((first, first + full))
                levels[rest - each * size] = True
                n -= full * each
                first += full
            if first < end and n:  # the last bin of this length takes what is left
                put(size, first, 1, n, capacity - rest)
                room[rest - n * size].append((first, first + 1))
                levels[rest - n * size] = True
                first, n = first + 1, 0
            if first < end:
                room[rest].append((first, end))
                levels[rest] = True
    rows = np.array(placed, dtype=np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens.

    Null text counts as empty; an empty document is its end id alone. Only the counts of each length,
    at most `capacity` rows, go to the driver; `plan` turns them into ranges of ranks, and each piece
    finds its place by its rank among the pieces of its length. Ranks come from buckets of about the
    square root of a length's count, so that one very common length is spread. Repeated rows are
    pieces of their own; an empty table gives no rows; further columns are left aside.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, _ = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(ranges)

    spread = spark.createDataFrame([(k, max(1, int(v**0.5))) for k, v in counts.items()], "length long, n_buckets int")
    rows = cut.join(F.broadcast(spread), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("n_buckets"))
    )
    starts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first")
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).cast("long").alias("rank")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = sent.value
        keys = to[:, 0] * 2**48 + to[:, 1]
        for batch in batches:
            if len(batch):
                length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
                row = to[np.searchsorted(keys, length * 2**48 + rank, side="right") - 1]
                nth = rank - row[:, 1]
                batch["sequence_id"] = row[:, 2] + nth // row[:, 3]
                batch["offset"] = row[:, 4] + length * (nth % row[:, 3])
                yield batch

    placed = ranked.mapInPandas(place, f"{PIECE}, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
