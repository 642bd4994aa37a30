"""Whitened embeddings: principal components by Golub-Kahan-Lanczos bidiagonalisation over blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written

MOST = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on count as non-finite: their x would not fit a long.
BOUND = 2.0**56
#: Rows of a block, of 8 bytes a dimension.
BLOCK = 4096
#: A triplet counts as converged, and a direction as exhausted, at this share of the largest singular value.
CLOSE = 1e-14


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is neither null nor empty and holds no null, non-finite or boundless entry, with x as array of long."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < BOUND)
    x = F.transform("embedding", lambda c: F.when(fits(c), F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fits)
    return vectors.where(whole).select(F.col("vec_id").cast("string").alias("vec_id"), x.alias("x"))


def sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """The count of the rows and their sum in each dimension, both exact: a row for each dimension comes to the driver."""
    each = x.select(F.posexplode("x").alias("dim", "value")).groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    found = sorted(each.collect())
    return (found[0]["n"] if found else 0), np.array([int(r["s"]) for r in found], dtype=object)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as long where it fits, else as Python's integers."""
    fits = n * max(int(np.abs(x).max(initial=1)), 1) < 2**62
    return n * x - s.astype(np.int64) if fits else n * x.astype(object) - s


class Rows:
    """The centred rows in blocks, with the products that the bidiagonalisation asks for."""

    def __init__(self, x: DataFrame, n: int, s: np.ndarray):
        self.n, self.dims = n, len(s)

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for a in range(0, len(batch), BLOCK):
                    rows = np.stack(batch["x"].iloc[a : a + BLOCK].to_list()).astype(np.int64)
                    yield pd.DataFrame({"block": [(centred(rows, n, s) / n).astype(np.float64).tobytes()]})

        self.blocks = written(x.select("x").mapInPandas(blocks, "block binary"), "centred")
        self.blocks.persist()

    def total(self, of: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """The sum of of(block) over all blocks: `length` numbers, added up by Spark."""
        dims = self.dims

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(length)
            for batch in batches:
                for block in batch["block"]:
                    out += of(np.frombuffer(block).reshape(-1, dims))
            yield pd.DataFrame({"slot": np.arange(length), "value": out})

        added = self.blocks.mapInPandas(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        out = np.zeros(length)
        for r in added.collect():
            out[r["slot"]] = r["value"]
        return out


def bidiagonal(rows: Rows, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the centred rows X, the largest `wanted` of them.

    Golub and Kahan's steps: u = X v - beta u', alpha = |u|; v' = X^T u - alpha v, beta = |v'|, each orthogonalised
    against all before it. The long vectors u stay where the rows are: u = X w for a short w, so one pass over the blocks
    gives U^T u, |u| and X^T u together; a second one does so for the corrected u. After each step the bidiagonal matrix of
    alpha and beta is decomposed; it ends once the wanted triplets have residuals under CLOSE or all dimensions are used. Where
    a direction is exhausted (beta is nothing), a new one that is orthogonal to all before goes on: so equal
    singular values are all found.
    """
    d, random = rows.dims, np.random.default_rng(seed)

    def orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - to @ (to.T @ v)
        return v

    vs, ws, alphas, betas = np.empty((d, 0)), np.empty((d, 0)), [], []
    v, beta, largest = random.standard_normal(d), 0.0, 0.0
    v /= np.linalg.norm(v)
    while True:
        k = ws.shape[1]
        vs = np.column_stack([vs, v])
        w = v - beta * ws[:, -1] if k else v
        for turn in range(2 if k else 1):
            both = np.column_stack([ws, w])

            def products(x: np.ndarray, both=both) -> np.ndarray:
                u = x @ both
                return np.r_[u.T @ u[:, -1], x.T @ u[:, -1]]

            found = rows.total(products, k + 1 + d)
            if k and not turn:
                w = w - ws @ found[:k]
        alpha, back = max(found[k], 0.0) ** 0.5, found[k + 1 :]
        largest = max(largest, alpha, beta)
        if alpha <= CLOSE * largest:
            alpha, w, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, back = w / alpha, back / alpha
        ws, alphas = np.column_stack([ws, w]), [*alphas, alpha]
        p, sigma, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        next_v = orthogonal(back - alpha * v, vs)
        beta = float(np.linalg.norm(next_v))
        if k + 1 == d or (k + 1 > wanted and beta > CLOSE * largest and (beta * np.abs(p[-1, :wanted]) <= CLOSE * sigma[0]).all()):
            return sigma[:wanted], orthonormal(vs @ qt.T)[:, :wanted]
        if beta <= CLOSE * largest:
            beta, next_v = 0.0, orthogonal(random.standard_normal(d), vs)
        betas, v = [*betas, beta], next_v / np.linalg.norm(next_v)


def orthonormal(v: np.ndarray) -> np.ndarray:
    """The columns, made unit and orthogonal to the last digit."""
    q, r = np.linalg.qr(v)
    return q * np.sign(np.diag(r))


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable vector and component.

    Vectors that are null or empty or hold a null or non-finite entry are dropped, and so are those of another length than
    the most have (of equally common lengths the largest stays): they have no place in the covariance. Components without variance
    are left out, so equal vectors, or a single one, give no rows, nor does an empty table. A null vec_id
    and repeated rows stay, each with rows of its own. Further columns are left aside. A deviation
    beyond a long is null. What comes to the driver is a few numbers for each dimension, at any number of rows.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    schema = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    x = rows.where(F.size("x") == (length["length"] if length else 0))
    n, s = sums(x)
    if not n:
        return result(x.mapInPandas(lambda batches: iter(()), schema), kind)
    blocks = Rows(x, n, s)
    try:
        trace = blocks.total(lambda b: np.array([(b * b).sum()]), 1)[0]
        sigma, components = bidiagonal(blocks, min(most, blocks.dims))
        real = sigma > 1e-10 * sigma[0] if trace > 0 else np.zeros(len(sigma), dtype=bool)
        sigma, components = sigma[real], components[:, real]
        to = components / (sigma / n**0.5)
        m = len(sigma)
        if m:
            mean = blocks.total(lambda b: (b @ to).sum(axis=0), m) / n

            def spread(b: np.ndarray) -> np.ndarray:
                z = b @ to - mean
                return (z.T @ z).ravel()

            error = float(np.abs(blocks.total(spread, m * m).reshape(m, m) / n - np.eye(m)).max())
    finally:
        blocks.blocks.unpersist()
    explained = sigma**2 / trace if m else sigma

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch) if m else 0, BLOCK):
                part = batch.iloc[a : a + BLOCK]
                c = centred(np.stack(part["x"].to_list()).astype(np.int64), n, s)
                far = c.astype(object) if int(np.abs(c).max()) ** 2 * c.shape[1] >= 2**63 else c
                deviation = [v if v < 2**63 else None for v in (far * far).sum(axis=1).tolist()]
                yield pd.DataFrame({
                    "vec_id": np.repeat(part["vec_id"].to_numpy(object), m), "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(part)),
                    "n": n, "deviation": pd.array(np.repeat(np.array(deviation, dtype=object), m), dtype="Int64"),
                    "whitened": ((c / n).astype(np.float64) @ to).ravel(), "explained": np.tile(explained, len(part)), "identity_error": error,
                })

    return result(x.mapInPandas(run, schema), kind)


def result(out: DataFrame, kind: str) -> DataFrame:
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
