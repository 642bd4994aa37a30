"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import by_block, components, free_name, in_blocks, partitions, stacked, table, written

WORDS = 5  # in a k-mer
LEAST = 0.8  # similarity of a link
SKETCHES = 32
TAKEN = 2  # k-mers in a sketch
#: Texts of more k-mers have their sketches from as many parts of one hash space; shorter ones from as many hash functions.
LONG = 256
#: Texts of at most so many words have sketches of single words too, as one edit may touch all their k-mers.
SHORT = 48
SLOTS = 256  # of the signature that weeds out candidates
#: Texts of more words have a second signature of more slots, as any two long texts fill the first one much alike.
LONG_WORDS, WIDE = 512, 2048
ROUNDS = 3  # of comparisons with one text of each bucket
CLOSEST = 2  # alignments of the most alike pair of each two components, before all that are left
BLOCK = 1024
WORDS_KEPT = 200_000
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The occurrence-labelled k-mers of a text in text order, as 64-bit hashes, all different."""
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = mixed(out * MIX + words[i : i + n])
    order = np.argsort(out, kind="stable")
    v = out[order]
    same = v[1:] == v[:-1]
    if same.any():
        first = np.flatnonzero(np.r_[True, ~same])
        label = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = label.astype(np.uint64)
        out = np.where(occurrence > 0, mixed(out + MIX * occurrence), out)
    return out


def by_functions(found: np.ndarray, salt: int, m: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """For each of m hash functions the smallest k-mers, put back in text order, as one number."""
    v = mixed(found[None, :] ^ (MIX * np.arange(salt + 1, salt + m + 1, dtype=np.uint64))[:, None])
    if len(found) > taken:
        at = np.sort(np.argpartition(v, taken - 1, axis=1)[:, :taken], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(found)), (m, len(found)))
    key = np.arange(salt, salt + m, dtype=np.uint64)
    for c in range(at.shape[1]):
        key = mixed(key * MIX + found[at[:, c]])
    return key.astype(np.int64)


def by_parts(found: np.ndarray, salt: int, m: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """As by_functions, from one hash function: sketch j has the smallest k-mers of part j of its values; 0 where a part has too few."""
    v = mixed(found ^ np.uint64(int(MIX) * (salt + 1) % 2**64))
    order = np.argsort(v)
    edges = np.arange(m, dtype=np.uint64) * np.uint64((1 << 64) // m)
    first = np.searchsorted(v[order], edges)
    enough = np.r_[first[1:], len(v)] - first >= taken
    at = np.sort(order[np.minimum(first[:, None] + np.arange(taken), len(v) - 1)], axis=1)
    key = np.arange(salt, salt + m, dtype=np.uint64)
    for c in range(taken):
        key = mixed(key * MIX + found[at[:, c]])
    return np.where(enough, key, np.uint64(0)).astype(np.int64)


def sketches(words: np.ndarray) -> np.ndarray:
    """The sketches of a text: SKETCHES by functions, by parts, and of single words; 0 where a kind does not apply.

    Texts that may be similar have a kind in common: lengths differ by a fifth at most, and texts of
    a length between the bounds have both kinds.
    """
    found = kmers(words)
    none = np.zeros(SKETCHES, dtype=np.int64)
    return np.concatenate([
        by_functions(found, 0) if len(found) <= LONG else none,
        by_parts(found, 1000) if len(found) > LEAST * LONG - WORDS else none,
        by_functions(kmers(words, 1), 2000) if len(words) <= SHORT else none,
    ])


def signature(words: np.ndarray, slots: int = SLOTS) -> bytes:
    """One byte for each of `slots` parts of the hash space: the number of words in it, 255 where there are more."""
    part = (mixed(words ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=slots), 255).astype(np.uint8).tobytes()


def allowed(longest, least: float = LEAST):
    """How many edits a pair may be apart, by the words of its longer text."""
    return np.floor((1 - least) * np.asarray(longest) + 1e-9).astype(np.int64)


def within(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Whether lengths and signatures let pairs reach `least`; true for every pair that does.

    A word replaced moves two counts by one, a word put in or left out one count, so the counts of
    two texts differ by no more than twice the edits less the difference of the lengths.
    """
    nx, ny = np.asarray(nx, dtype=np.int64), np.asarray(ny, dtype=np.int64)
    apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    most, gap = allowed(np.maximum(nx, ny), least), np.abs(nx - ny)
    return (gap <= most) & (apart <= 2 * most - gap)


def marks(words: np.ndarray) -> bytes:
    """The signature, and behind it that of more slots if the text is long."""
    return signature(words) + (signature(words, WIDE) if len(words) > LONG_WORDS else b"")


def edits(x: list, y: list, most: int) -> int:
    """How many words must be put in, left out or replaced to make y of x, or most + 1 where that is more than `most`.

    The alignment looks only at a band of `most` places on both sides of the diagonal. A column of the
    band is kept as bits: where its value rises and where it falls towards the next row. So a column
    costs a few operations on whole numbers of 2 * most + 1 bits.
    """
    a, n = 0, min(len(x), len(y))
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if len(x) < len(y):
        x, y = y, x
    gap = len(x) - len(y)
    if gap > most or not y:
        return min(gap, most + 1)
    most = min(most, len(x))
    places: dict = {}
    for i, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << i
    full, far = (1 << (2 * most + 1)) - 1, 1 << (gap + most)
    rises, falls, total = full >> most << most, 0, gap
    for j, word in enumerate(y, 1):
        match = places.get(word, 0)
        match = (match << (most + 1 - j) if j <= most else match >> (j - most - 1)) & full
        level = ((((match & rises) + rises) ^ rises) | match | falls) & full
        if not level & far:
            total += 1
            if total > most:
                return most + 1
        right_up, right_down = falls | (full & ~(level | rises)), level & rises
        level >>= 1
        rises, falls = right_down | (full & ~(level | right_up)), level & right_up
    return total


def similarity(a: list, b: list, least: float = LEAST) -> float:
    """1 less the edits between two lists of words over the words of the longer; 0 where that is below `least`."""
    longest = max(len(a), len(b))
    most = int(allowed(longest, least))
    found = edits(a, b, most) if longest else 0
    return 1 - found / max(1, longest) if found <= most else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, words_hash, n, signature, keys) of the documents with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if words := words_of(text):
                    h = known.of(words)
                    same = hashlib.md5(" ".join(words).encode()).digest()
                    out.append((doc_id, same, len(h), marks(h), sketches(h)))
            yield pd.DataFrame(out, columns=["doc_id", "words_hash", "n", "signature", "keys"])

    rows = docs.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(run, "doc_id long, words_hash binary, n int, signature binary, keys array<long>")


def close(n: Column, m: Column) -> Column:
    """Whether the lengths of two texts let them reach LEAST."""
    return F.abs(n - m) <= F.floor((1 - LEAST) * F.greatest(n, m) + 1e-9)


def likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> np.ndarray:
    """Whether lengths and signatures let a pair reach LEAST."""
    x, y, nx, ny = stacked(a, np.uint8), stacked(b, np.uint8), na.to_numpy(), nb.to_numpy()
    may = within(x[:, :SLOTS], y[:, :SLOTS], nx, ny)
    at = np.flatnonzero(may & [len(s) > SLOTS and len(t) > SLOTS for s, t in zip(a, b, strict=True)])
    if len(at):
        may[at] = within(x[at, SLOTS:], y[at, SLOTS:], nx[at], ny[at])
    return may


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts align to LEAST or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got: dict[int, list[str]] = {}
            keep = []
            for a, b, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if len(got) > 256:
                    got.clear()
                x, y = got.get(a) or got.setdefault(a, words_of(s)), got.get(b) or got.setdefault(b, words_of(t))
                keep.append(similarity(x, y) > 0)
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def packed(longs: str) -> Column:
    """An array of longs as bytes."""
    return F.unhex(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def labelled(buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(key, rep, component) by the parts found so far."""
    if parts is None:
        return buckets.select("key", "rep", "n", F.col("rep").alias("component"))
    return buckets.join(parts, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))


def merged(parts: DataFrame | None, new: DataFrame) -> DataFrame:
    """(rep, component) of all linked texts after further links: only the components that these join are walked again."""
    if parts is None:
        return written(components(new).withColumnRenamed("node", "rep"), "components")
    ends = new
    for end in ("a", "b"):
        known = parts.select(F.col("rep").alias(end), F.col("component").alias("c" + end))
        ends = ends.join(known, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = parts.join(renamed, "component", "left").select("rep", F.coalesce("now", "component").alias("component"))
    fresh = joined.withColumnRenamed("node", "rep").join(parts.select("rep"), "rep", "left_anti")
    return written(old.unionByName(fresh), "components")


def across(rows: DataFrame, most: int) -> DataFrame:
    """Deals the rows of each key into blocks in which its largest component meets all others.

    Both sides are cut into chunks of about `most` rows, and a row goes to one block for each chunk of
    the other side. The pairs within the largest component are linked already, so a bucket that one
    component fills takes room in proportion to its rows. Columns as those of in_blocks.
    """
    top = F.col("component") == F.col("top")
    mine = F.ceil(F.when(top, F.col("tops")).otherwise(F.col("total") - F.col("tops")) / most).cast("int")
    theirs = F.ceil(F.when(top, F.col("total") - F.col("tops")).otherwise(F.col("tops")) / most).cast("int")
    rows = rows.select(
        "key", "rep", "component", F.col("key").alias("bucket"), top.cast("int").alias("side"), F.pmod(F.xxhash64("rep"), mine).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), theirs - 1)).alias("other"),
    )
    at = F.when(F.col("side") == 1, F.struct("chunk", "other")).otherwise(F.struct(F.col("other").alias("chunk"), F.col("chunk").alias("other")))
    block = F.xxhash64("key", F.lit("across"), at)
    return rows.select("rep", "component", "bucket", block.alias("block"), "side", F.lit(False).alias("alone"))


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, far, ca, cb) that the parts found so far do not join, by these parts."""
    for end in ("ca", "cb"):
        now = parts.select(F.col("rep").alias(end), F.col("component").alias("now"))
        pairs = pairs.join(now, end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
    return pairs.where("ca <> cb").select("a", "b", "far", "ca", "cb")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep) of the documents with words, rep the smallest doc_id of the same words; and (rep, component) of the reps with links.

    First the texts of a bucket are held against one of them, so that a large group of near copies
    becomes one component from about as many pairs as it has rows; that is done again, ROUNDS times in
    all, in buckets where it joined most texts. Then texts of a bucket
    in different components are compared by their signatures in blocks; only pairs that may reach
    LEAST leave the task. Of those of two components the one that the signatures hold for the most alike is
    aligned first, CLOSEST times in all, as a link spares all others of the two; then what still lies between two
    components is aligned whole. No pair is left out for the size of a bucket.
    """
    spark = docs.sparkSession
    rows = written(sketched(docs), "sketches")
    same = written(rows.groupBy("words_hash").agg(F.min("doc_id").alias("rep")), "same")  # apart, so that Spark may split a hot group
    members = rows.join(same, "words_hash").select("doc_id", "rep")
    reps = rows.join(same, "words_hash").where("doc_id = rep").dropDuplicates(["rep"])
    reps = written(reps.select("rep", "n", "signature", "keys"), "reps")

    single = reps.select("rep", "n", F.explode("keys").alias("key")).where("key <> 0")
    shared = single.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = written(single.join(shared, "key"), "buckets")
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = written(texts.join(involved, "doc_id", "left_semi"), "texts")

    def weed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[likely(b["sa"], b["sb"], b["na"], b["nb"]), ["a", "b"]]

    def slim(doc: str, sig: str, n: str) -> DataFrame:
        return reps.select(F.col("rep").alias(doc), F.col("signature").alias(sig), F.col("n").alias(n))

    first, parts = spark.createDataFrame([], "a long, b long"), None
    for k in range(ROUNDS):
        rows = labelled(buckets, parts)
        pivot = F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(k)))
        least, most = F.min("component").alias("least"), F.max("component").alias("most")
        joined = F.count_if(F.col("component") != F.col("rep")).alias("joined")
        pivots = rows.groupBy("key").agg(pivot.alias("p"), least, most, joined, F.count("*").alias("size")).where("least < most")
        pivots = pivots.where("2 * joined >= size" if k else "true").select("key", "p")
        stars = rows.join(pivots, "key").where("component <> p.component").where(close(F.col("n"), F.col("p.n")))
        stars = stars.select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b")).distinct()
        stars = stars.join(slim("a", "sa", "na"), "a").join(slim("b", "sb", "nb"), "b")
        new = written(verified(stars.mapInPandas(weed, "a long, b long"), texts), "links")
        first, parts = first.unionByName(new), merged(parts, new)

    rows = labelled(buckets, parts)
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("top"), F.max("size").alias("tops"),
        F.sum("size").alias("total"), F.count("*").alias("parts"),
    )
    rows = written(rows.join(sizes.where("parts > 1"), "key"), "open")
    full = reps.select("rep", "n", "signature", packed("keys").alias("keys"))

    def prepare(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        wide = {"signature": stacked(frame["signature"], np.uint8), "keys": stacked(frame["keys"], ">i8").astype(np.int64)}
        return {c: frame[c].to_numpy() for c in ("rep", "n", "component", "bucket")} | wide

    def compare(block: dict[str, np.ndarray]) -> np.ndarray:
        order = np.argsort(block["n"], kind="stable")  # of a text only those up to a quarter longer are looked at
        rep, n, part, sig, side, keys = (block[c][order] for c in ("rep", "n", "component", "signature", "side", "keys"))
        sig, wide = sig[:, :SLOTS], sig[:, SLOTS:]
        longest = n + np.floor(n * (1 - LEAST) / LEAST + 1e-9).astype(n.dtype)
        last = np.searchsorted(n, longest, side="right")
        coarse = sig.reshape(len(sig), SLOTS // 8, 8).sum(axis=2, dtype=np.int16)
        alone, out = bool(block["alone"][0]), []
        for i in range(len(rep) - 1):
            end = last[i]
            may = part[i + 1 : end] != part[i]
            if not alone:
                may &= side[i + 1 : end] != side[i]
            at = np.flatnonzero(may) + i + 1
            if len(at):
                # counts of eight slots together differ by no more than those of the slots
                at = at[np.abs(coarse[at] - coarse[i]).sum(axis=1, dtype=np.int32) <= 2 * allowed(n[at])]
            if len(at):
                at = at[within(sig[at], sig[i], n[at], n[i])]
                if n[i] > LONG_WORDS:  # and so are the others, which are not shorter
                    at = at[within(wide[at], wide[i], n[at], n[i])]
                same = (keys[at] == keys[i]) & (keys[i] != 0)  # a pair is told by the first bucket that it shares
                at = at[keys[i][same.argmax(axis=1)] == block["bucket"][0]]
                far = np.abs(sig[at].astype(np.int16) - sig[i]).sum(axis=1, dtype=np.int64) * 1000 // np.maximum(1, 2 * allowed(n[at]) - (n[at] - n[i]))
                first = rep[at] > rep[i]
                ends = [np.where(first, x[at], x[i]) for x in (rep, part)], [np.where(first, x[i], x[at]) for x in (rep, part)]
                out.append(np.stack([ends[0][0], ends[1][0], far, ends[0][1], ends[1][1]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 5), dtype=np.int64)

    rest = rows.where("component <> top AND parts > 2").select("key", "rep", "component", F.col("key").alias("bucket"))
    slim_blocks = across(rows, BLOCK).unionByName(in_blocks(rest, "key", "rep", BLOCK))  # n comes with full
    more = by_block(slim_blocks.join(full, "rep"), prepare, compare, 8 * partitions(spark), ("a", "b", "far", "ca", "cb"))
    more = written(more.join(first, ["a", "b"], "left_anti"), "candidates")
    for k in range(CLOSEST + 1):
        tried = more
        if k < CLOSEST:
            tried = more.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
            tried = written(tried, "tried")
        parts = merged(parts, written(verified(tried.select("a", "b"), texts), "links"))
        if k < CLOSEST:
            more = written(apart(more.join(tried, ["a", "b"], "left_anti"), parts), "candidates")
    return members, parts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, words_id and kept for every document.

    Words are runs of letters, digits and underscores, lower-cased. Texts with the same words have
    the same words_id, the smallest doc_id among them. Texts that share a sketch of k-mers of five
    words, and whose words align with edits of at most a fifth of the longer text's words
    (`similarity` 0.8), are linked; class_id is the smallest doc_id reachable by links, kept says
    doc_id = class_id. Null, empty and wordless texts link with nothing; a null doc_id has null class
    and is kept; repeated rows of one doc_id share a class; an empty table gives no rows; further
    columns are left aside.
    """
    members, classes = links(docs)
    named = members.distinct().join(classes, "rep", "left").select(
        "doc_id", F.col("rep").alias("words_id"), F.coalesce("component", "rep").alias("class_id")
    )
    named = named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("words_id").alias("words_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(named, "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("words_id", "doc_id").alias("words_id"))
    return rows.withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the smallest doc_id of their class; all columns stay, and null doc_ids."""
    (gone,) = free_name(docs, "gone")
    drop = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id") == F.col(gone), "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
