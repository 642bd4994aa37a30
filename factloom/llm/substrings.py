"""Removal of long substrings that an earlier document holds.

The classic way is a suffix array with common-prefix values, built for shards beyond memory by
induced sorting over disk-backed priority queues. Here Spark's own shuffle is the sorter on disk, and
the induction keeps its three steps, each a grouping by content:

1. Sampled suffixes. In every window of LENGTH bytes the place with the smallest hash of GRAM bytes is
   sampled, so equal windows sample the same place. Only sampled suffixes are sorted, by that hash.
2. Common prefixes. A sampled suffix carries a digest of all bytes that any of its windows can reach,
   on both sides: equal digests are common prefixes (and suffixes) long enough for all its windows.
3. Induction. Where sampled suffixes agree but not on all these bytes, their windows, and only they,
   are compared one by one.

A window is removable if a smaller doc_id has it; all steps need only the smallest doc_id of a group, so
tasks keep one holder of each string before the shuffle and no group is ever gathered whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import free_name, partitions, table, written

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM
#: Samples that a task sorts at a time: about 4 MB of text, and some 80 MB of memory.
BATCH = 300_000
#: Windows of a long text that are looked at together.
PART = 2 << 20
#: Of texts in a group, about.
GROUP_BYTES = 64 << 20
OUTSIDE = 256
BLOBS = "place int, kind string, blob binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of byte ranges modulo 2 ** 64, the same wherever the range stands."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.table = r.integers(0, 2**64, OUTSIDE + 1, dtype=np.uint64) | np.uint64(1)
        self.base = int(r.integers(0, 2**62)) * 4 + 3
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) + 1
        if len(self.power) < n:
            self.power = self.powers(self.base, 2 * n)
            self.inverse = self.powers(pow(self.base, -1, 2**64), 2 * n)
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.table[symbols] * self.power[: n - 1], out=out[1:])
        return out

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out, step = np.ones(1, dtype=np.uint64), base
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step % 2**64
        return out[:n]

    def of(self, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((sums[start + length] - sums[start]) * self.inverse[start])


def leftmost_least(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its smallest, the first of equals."""
    at, best, m = np.arange(len(v), dtype=np.int64), v, 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = best[shift:] < best[:-shift]
        return np.where(right, at[shift:], at[:-shift]), np.where(right, best[shift:], best[:-shift])

    while 2 * m <= width:
        at, best = joined(m)
        m *= 2
    if m < width:
        at, best = joined(width - m)
    return at


class Text:
    """A text's windows in parts: where each begins, its sampled place, and the hashes that are asked for."""

    def __init__(self, first: Rolling, second: Rolling) -> None:
        self.first, self.second = first, second

    def parts(self, data: bytes) -> Iterator[tuple[int, np.ndarray, Callable, Callable]]:
        b, n = np.frombuffer(data, dtype=np.uint8), len(data)
        for low in range(0, n - LENGTH + 1, PART):
            high = min(low + PART, n - LENGTH + 1)
            a, e = max(0, low - REACH), min(n, high + LENGTH + REACH)
            symbols = np.full(REACH + high - low + LENGTH + REACH, OUTSIDE, dtype=np.int64)
            symbols[REACH - (low - a) :][: e - a] = b[a:e]
            one, two = self.first.sums(symbols), self.second.sums(symbols)
            grams = self.first.of(one, np.arange(REACH, REACH + high - low + REACH), GRAM)
            sampled = leftmost_least(grams, REACH + 1) + low

            def samples(at: np.ndarray, low=low, grams=grams, two=two) -> tuple[np.ndarray, np.ndarray]:
                return grams[at - low], self.second.of(two, at - low, REACH + LENGTH)

            def windows(at: np.ndarray, low=low, one=one, two=two) -> tuple[np.ndarray, np.ndarray]:
                at = at - low + REACH
                return self.first.of(one, at, LENGTH), self.second.of(two, at, LENGTH).astype(np.uint32)

            yield low, sampled, samples, windows


def planes(a: np.ndarray, width: int = 8) -> bytes:
    """The bytes of all numbers by their place in the number, so that compression finds runs."""
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()


def unplaned(data: bytes, n: int, dtype, width: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.view(dtype)[:, 0]


#: kind -> columns of a blob as (numpy type, bytes kept). Fixed for all tasks. Each ends with doc_id, tag of the text, place.
#: Of the pairs of hashes 11 and 10 bytes stay, beside the bucket that the first one tells: few enough to meet by chance only beyond 10 ** 10 rows.
SAMPLE = (("<u8", 4), ("<u8", 7), ("<i8", 8), ("<i8", 8), ("<u4", 4))
WINDOW = (("<u8", 6), ("<u4", 4), ("<i8", 8), ("<i8", 8), ("<u4", 4))
PLACE = (("<i8", 8), ("<i8", 8), ("<u4", 4))


def blob(columns: tuple, shape: tuple) -> bytes:
    """Rows as compressed bytes, behind their length: Spark's own compression of a shuffle finds less in them."""
    data = b"".join(planes(np.ascontiguousarray(c, dtype=t), w) for c, (t, w) in zip(columns, shape, strict=True))
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unblob(blobs: list[bytes], shape: tuple) -> list[np.ndarray]:
    each, out = sum(w for _, w in shape), [[] for _ in shape]
    for packed in blobs:
        data = pa.decompress(memoryview(packed)[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        n, at = len(data) // each, 0
        for k, (t, w) in enumerate(shape):
            out[k].append(unplaned(data[at : at + n * w], n, t, w))
            at += n * w
    return [np.concatenate([np.empty(0, dtype=t), *c]) for c, (t, _) in zip(out, shape, strict=True)]


def dealt(place: np.ndarray, columns: tuple, shape: tuple, kind: str) -> Iterator[tuple[int, str, bytes]]:
    """A blob for each place, its rows as they come."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(place)], strict=True):
        yield int(place[a]), kind, blob(tuple(c[order[a:b]] for c in columns), shape)


def later(order: np.ndarray, keys: tuple, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In rows put in `order` by keys and then docs: which rows have a smaller doc_id with the same keys, and where groups begin."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    d = docs[order]
    return d > np.repeat(d[new], np.diff(np.r_[np.flatnonzero(new), len(d)])), new


def next_prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def tagged(docs: DataFrame, doc: str, tag: str, group: str, groups: int) -> DataFrame:
    """docs with its doc_id (0 for null), a hash of the text, and the group that the two are dealt to.

    Texts under one doc_id are told apart by their hashes; a null text counts as an empty one.
    """
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), tag: F.xxhash64(F.coalesce("text", F.lit("")))})
    return rows.withColumn(group, F.pmod(F.col(doc).bitwiseXOR(F.col(tag)), F.lit(groups)).cast("int"))


def homes(d: np.ndarray, t: np.ndarray, groups: int) -> np.ndarray:
    """The groups that tagged() deals doc_ids and hashes to."""
    return (d ^ t) % groups


def sampled(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Blobs of sampled suffixes by bucket, and of those with a holder in the same batch ("whole") by group."""

    def flush(store: list[tuple]) -> Iterator[tuple[int, str, bytes]]:
        h, c, d, t, p = (np.concatenate(x) for x in zip(*store, strict=True))
        order = np.lexsort((p, t, d, c, h))
        gone, _ = later(order, (h, c), d)
        out = order[gone]
        yield from dealt(homes(d[out], t[out], groups), (d[out], t[out], p[out]), PLACE, "whole")
        keep = np.sort(order[~gone])  # by document and place again: their bytes repeat more
        b = (h[keep] % np.uint64(buckets)).astype(np.int64)
        yield from dealt(b, (h[keep] // np.uint64(buckets), c[keep], d[keep], t[keep], p[keep]), SAMPLE, "sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, store, held = Text(Rolling(1), Rolling(2)), [], 0
        for batch in batches:
            for doc, tag, data in zip(batch["doc"], batch["tag"], batch["text"], strict=True):
                data = data.encode()
                for _, at, samples, _ in text.parts(data):
                    at = at[np.r_[True, at[1:] != at[:-1]]]
                    h, c = samples(at)
                    store.append((h, c, np.full(len(at), doc), np.full(len(at), tag), at.astype(np.uint32)))
                    held += len(at)
                    if held >= BATCH:
                        yield pd.DataFrame(flush(store), columns=["place", "kind", "blob"])
                        store, held = [], 0
        if store:
            yield pd.DataFrame(flush(store), columns=["place", "kind", "blob"])

    return known_texts(docs, groups).select("doc", "tag", "text").mapInPandas(run, BLOBS)


def known_texts(docs: DataFrame, groups: int) -> DataFrame:
    return tagged(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "doc", "tag", "grp", groups)


def settled(samples: DataFrame, groups: int) -> DataFrame:
    """For each bucket of sampled suffixes the places whose windows are all removable ("whole"), and those to be looked at ("part")."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(p, k, b) for p, k, b in frame[["place", "kind", "blob"]].itertuples(index=False) if k != "sample"]
        h, c, d, t, p = unblob([b for k, b in zip(frame["kind"], frame["blob"], strict=True) if k == "sample"], SAMPLE)
        order = np.lexsort((p, t, d, c, h))
        gone, new = later(order, (h, c), d)
        s, e = h[order], d[order]
        first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, dtype=bool)
        starts = np.flatnonzero(first)
        if len(starts):
            sizes = np.diff(np.r_[starts, len(s)])
            contexts = np.add.reduceat(new.astype(np.int64), starts)
            shared = np.maximum.reduceat(e, starts) > np.minimum.reduceat(e, starts)
            part = np.repeat((contexts > 1) & shared, sizes) & ~gone
            for rows, kind in ((order[gone], "whole"), (order[part], "part")):
                rows = np.sort(rows)
                out += dealt(homes(d[rows], t[rows], groups), (d[rows], t[rows], p[rows]), PLACE, kind)
        return pd.DataFrame(out, columns=["place", "kind", "blob"])

    return samples.groupBy("kind", "place").applyInPandas(run, BLOBS)


def by_document(blobs: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """The places of each doc_id and hash of a text."""
    d, t, p = unblob(blobs, PLACE)
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order].astype(np.int64)
    if not len(d):
        return {}
    cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    return {(int(d[a]), int(t[a])): p[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(d)], strict=True)}


def compared(docs: DataFrame, places: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Places of the windows, among those to be looked at, that a smaller doc_id has ("window")."""

    def ask(frame: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        text, part, store, seen = Text(Rolling(1), Rolling(2)), by_document(list(blobs["blob"])), [], set()
        for doc, tag, data in zip(frame["doc"], frame["tag"], frame["text"], strict=True):
            if (doc, tag) not in part or (doc, tag) in seen:
                continue
            seen.add((doc, tag))
            for low, at, _, windows in text.parts(data.encode()):
                s = np.flatnonzero(np.isin(at, part[doc, tag])) + low
                if len(s):
                    store.append((*windows(s), np.full(len(s), doc), np.full(len(s), tag), s.astype(np.uint32)))
        out = []
        if store:
            x, y, d, t, p = (np.concatenate(c) for c in zip(*store, strict=True))
            order = np.lexsort((p, t, d, y, x))
            gone, _ = later(order, (x, y), d)
            rows = order[gone]
            out += dealt(homes(d[rows], t[rows], groups), (d[rows], t[rows], p[rows]), PLACE, "window")
            rows = np.sort(order[~gone])
            b = (x[rows] % np.uint64(buckets)).astype(np.int64)
            out += dealt(b, (x[rows] // np.uint64(buckets), y[rows], d[rows], t[rows], p[rows]), WINDOW, "ask")
        return pd.DataFrame(out, columns=["place", "kind", "blob"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = frame["kind"].to_numpy()
        out = list(frame.loc[kinds == "window", ["place", "kind", "blob"]].itertuples(index=False, name=None))
        x, y, d, t, p = unblob(list(frame.loc[kinds == "ask", "blob"]), WINDOW)
        order = np.lexsort((p, t, d, y, x))
        gone, _ = later(order, (x, y), d)
        rows = np.sort(order[gone])
        out += dealt(homes(d[rows], t[rows], groups), (d[rows], t[rows], p[rows]), PLACE, "window")
        return pd.DataFrame(out, columns=["place", "kind", "blob"])

    asked = known_texts(docs, groups).select("doc", "tag", "text", "grp").groupBy("grp").cogroup(
        places.where("kind = 'part'").groupBy("place")
    ).applyInPandas(ask, BLOBS)
    return asked.groupBy("kind", "place").applyInPandas(answer, BLOBS)


def covered(data: bytes, text: Text, whole: np.ndarray | None, single: np.ndarray | None) -> np.ndarray:
    """(start, end) of the maximal runs of bytes in removable windows."""
    starts = [] if single is None else [single]
    if whole is not None:
        for low, at, _, _ in text.parts(data):
            starts.append(np.flatnonzero(np.isin(at, whole)) + low)
    s = np.unique(np.concatenate(starts)) if starts else np.empty(0, dtype=np.int64)
    if not len(s):
        return np.empty((0, 2), dtype=np.int64)
    gap = np.flatnonzero(s[1:] - s[:-1] > LENGTH)
    return np.stack([s[np.r_[0, gap + 1]], s[np.r_[gap, len(s) - 1]] + LENGTH], axis=1)


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(groups of texts, buckets of suffixes): as many as partitions, and more where a group would exceed GROUP_BYTES."""
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return next_prime(max(n, total // GROUP_BYTES)), 2 * max(n, total // GROUP_BYTES)


def with_spans(docs: DataFrame, build: Callable, schema) -> DataFrame:
    """build(Arrow table of rows of docs, texts as bytes, spans) for groups of rows of docs; other columns stay as they are."""
    groups, buckets = sizes(docs)
    doc, tag, group = free_name(docs, "doc", "tag", "grp")
    places = written(settled(sampled(docs, groups, buckets), groups), "places")
    windows = written(compared(docs, places, groups, buckets), "windows")
    blobs = places.where("kind = 'whole'").unionByName(windows)

    def finish(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        text, kinds = Text(Rolling(1), Rolling(2)), blobs["kind"].to_pylist()
        whole, single = (
            by_document([b for k, b in zip(kinds, blobs["blob"].to_pylist(), strict=True) if k == kind]) for kind in ("whole", "window")
        )
        datas = [(value or "").encode() for value in rows["text"].to_pylist()]
        keys = zip(rows[doc].to_pylist(), rows[tag].to_pylist(), strict=True)
        spans = [
            np.empty((0, 2), dtype=np.int64) if doc_id is None else covered(data, text, whole.get(key), single.get(key))
            for doc_id, key, data in zip(rows["doc_id"].to_pylist(), keys, datas, strict=True)
        ]
        return build(rows.drop_columns([doc, tag, group]), datas, spans)

    rows = tagged(docs, doc, tag, group, groups)
    return rows.groupBy(group).cogroup(blobs.groupBy("place")).applyInArrow(finish, schema)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller
    doc_id; strings do not cross documents and are judged on the input. Null text counts as empty; a
    text under LENGTH bytes and a row with a null doc_id stay whole and remove nothing elsewhere;
    equal rows of one doc_id give equal rows; different texts under one doc_id do not remove from each
    other. An empty table gives no rows; further columns are left aside.
    """

    def build(rows: pa.Table, datas: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        out = []
        for data, runs in zip(datas, spans, strict=True):
            sha, at = hashlib.sha256(), 0
            for a, b in runs.tolist():
                sha.update(data[at:a])
                at = b
            sha.update(data[at:])
            out.append((len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), sha.hexdigest()))
        n_bytes, n_removed, n_spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({
            "doc_id": rows["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string()),
        })

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_spans(docs.select(F.col("doc_id").cast("long"), "text"), build, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removable bytes cut from `text`, where characters cut in half go too; n_chars follows if it is there.

    All rows and all other columns stay as they are, null texts too.
    """

    def build(rows: pa.Table, datas: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        texts = rows["text"].to_pylist()
        for k, (data, runs) in enumerate(zip(datas, spans, strict=True)):
            if len(runs):
                ends = [0, *runs.ravel().tolist(), len(data)]
                texts[k] = "".join(data[a:b].decode(errors="ignore") for a, b in zip(ends[::2], ends[1::2], strict=True))
        new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
        for name in new.keys() & {*rows.column_names}:
            at = rows.column_names.index(name)
            rows = rows.set_column(at, name, pa.array(new[name], rows.schema.field(at).type))
        return rows

    return with_spans(docs, build, docs.schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
