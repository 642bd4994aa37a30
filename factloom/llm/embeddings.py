"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import by_block, components, in_blocks, partitions, stacked, table, written

LEAST = 0.98
DIMS = 4  # of a block
#: Width of a grid cell in search radii; at 2 or more a point lies within reach of 2 ** DIMS cells at most.
WIDTH = 4.0
BLOCK = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)


def rotation(n: int) -> np.ndarray:
    """The same random orthogonal matrix for each n."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def hashed(label: int, n: int, block: int, cells: np.ndarray) -> np.ndarray:
    """A number for each row of cells; rows that meet by chance fail the comparison later."""
    out = np.full(len(cells), (label * 1_000_003 + n * 1009 + block) % 2**63, dtype=np.uint64)
    for c in cells.T:
        out = (out ^ c.astype(np.int64).astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, same, label, vector): same is the digest of label and vector, null where the vector links with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same, data = [], []
            for label, v in zip(batch["label"], batch["embedding"], strict=True):
                v = None if v is None or label is None else np.asarray(v, dtype=np.float64)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    same.append(None)
                    data.append(None)
                else:
                    raw = (v + 0.0).tobytes()
                    same.append(hashlib.blake2b(raw, digest_size=16, salt=int(label).to_bytes(8, "little", signed=True)).digest())
                    data.append(raw)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "same": same, "label": batch["label"], "vector": data
            })

    long = lambda c: F.col(c).cast("long").cast("string").alias(c)  # noqa: E731  pandas would round numbers beside a null
    rows = vectors.select(long("vec_id"), "embedding", long("label")).mapInPandas(
        run, "vec_id string, same binary, label string, vector binary"
    )
    return rows.withColumns({c: F.col(c).cast("long") for c in ("vec_id", "label")})


def unit(vectors: pd.Series, n: int) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(-1, n)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def radii(n: int, least: float = LEAST) -> list[tuple[int, int, float]]:
    """(from, to, squared radius) of each block: its share of the squared distance 2 - 2 * least by its dimensions."""
    budget = (2 - 2 * least) * (1 + 1e-6) + 1e-9
    return [(a, min(a + DIMS, n), budget * (min(a + DIMS, n) - a) / n) for a in range(0, n, DIMS)]


def probes(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(cell, rep, home, near, point, norms): each block of a rotated vector in its own grid cell and in those within reach.

    If two unit vectors are within the whole squared budget, at least one block is within its share,
    so the two meet in the cell of either of them there. norms holds the lengths of all blocks: the
    sum of their squared differences is a lower bound of the squared distance.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, size), part in batch.groupby([batch["label"], batch["vector"].str.len()]):
                n = int(size) // 8
                x = unit(part["vector"], n) @ rotation(n)
                rep = part["rep"].to_numpy()
                cuts = radii(n, least)
                norms = np.stack([np.linalg.norm(x[:, a:b], axis=1) for a, b, _ in cuts], axis=1).astype(np.float32)
                for k, (a, b, square) in enumerate(cuts):
                    p, r = x[:, a:b], square**0.5
                    w = WIDTH * r
                    own, low, high = (np.floor((p + d) / w).astype(np.int64) for d in (0, -r, r))
                    other = np.where(low != own, low, high)
                    for mask in range(1 << (b - a)):
                        bits = np.array([mask >> d & 1 for d in range(b - a)], dtype=bool)
                        ok = (other[:, bits] != own[:, bits]).all(axis=1)
                        if ok.any():
                            cells = np.where(bits, other, own)[ok]
                            yield pd.DataFrame({
                                "cell": hashed(int(label), n, k, cells), "rep": rep[ok], "home": mask == 0, "near": square,
                                "point": [row.tobytes() for row in p[ok].astype(np.float32)],
                                "norms": [row.tobytes() for row in norms[ok].astype(np.float16)],
                            })

    return reps.mapInPandas(run, "cell long, rep long, home boolean, near double, point binary, norms binary")


def candidates(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct pairs (a, b), a > b, that share a block within its budget and pass the bound of the norms."""
    budget = (2 - 2 * least) * (1 + 1e-6) + 1e-9

    def prepare(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: frame[c].to_numpy() for c in ("rep", "home", "near")} | {
            "point": stacked(frame["point"], np.float32), "norms": stacked(frame["norms"], np.float16).astype(np.float32)
        }

    def compare(block: dict[str, np.ndarray]) -> np.ndarray:
        rep, side, p, q = (block[c] for c in ("rep", "side", "point", "norms"))
        here, out = np.flatnonzero(block["home"]), []
        for start in range(0, len(here), 256):
            rows = here[start : start + 256]
            gap = sum((p[rows, None, c] - p[None, :, c]) ** 2 for c in range(p.shape[1]))
            i, j = np.nonzero(gap <= block["near"].max() + 1e-5)  # float32 points get some slack
            i = rows[i]
            keep = rep[i] != rep[j] if block["alone"][0] else side[i] != side[j]
            i, j = i[keep], j[keep]
            keep = ((q[i] - q[j]) ** 2).sum(axis=1) <= budget + 0.004  # float16 norms too
            x, y = rep[i[keep]], rep[j[keep]]
            out.append(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)

    dealt = in_blocks(probes(reps, least), "cell", "rep", BLOCK)
    return by_block(dealt, prepare, compare, 8 * partitions(reps.sparkSession)).where("a > b")


def verified(pairs: DataFrame, reps: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs with equal labels and a cosine of `least` or more in double precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            sizes = batch["va"].str.len().to_numpy()
            same = (sizes == batch["vb"].str.len().to_numpy()) & (batch["la"] == batch["lb"]).to_numpy()
            for s in np.unique(sizes[same]):
                at = np.flatnonzero(same & (sizes == s))
                x = np.frombuffer(b"".join(batch["va"].iloc[at]), dtype=np.float64).reshape(len(at), -1)
                y = np.frombuffer(b"".join(batch["vb"].iloc[at]), dtype=np.float64).reshape(len(at), -1)
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                keep[at] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= least
            yield batch.loc[keep, ["a", "b"]]

    left = reps.select(F.col("rep").alias("a"), F.col("vector").alias("va"), F.col("label").alias("la"))
    right = reps.select(F.col("rep").alias("b"), F.col("vector").alias("vb"), F.col("label").alias("lb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, by links of equal labels and cosine >= `least`.

    Equal vectors of one label become one representative first, so a vector that is very common costs
    one row; its copies count as links of each other and of all that the representative links with.
    Null, empty, zero and non-finite vectors and null labels link with nothing; vectors of different
    length do not link; repeated rows count as vectors of their own; an empty table gives no rows;
    further columns are left aside.
    """
    rows = written(prepared(vectors), "vectors")
    copies = rows.where("same IS NOT NULL AND vec_id IS NOT NULL").groupBy("same").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    reps = written(copies, "reps")
    found = written(verified(candidates(reps, least), reps, least), "links")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = reps.select(F.col("rep").alias("b"), "n")
    linked = both.join(weight, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = components(found).withColumnRenamed("node", "rep")
    named = reps.join(linked, "rep", "left").join(parts, "rep", "left").select(
        "same", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    return rows.select("vec_id", "same").join(named, "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for op2. The walk over links is recursive; copies make no more than their own rows.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
