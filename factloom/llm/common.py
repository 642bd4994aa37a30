"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a single machine, as in tests, one of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Spark's own setting: a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table by a checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Links that one task may hold: 16 bytes each.
FEW_LINKS = 200_000


def walked(edges: DataFrame) -> DataFrame:
    """components() of at most FEW_LINKS links, by one task."""
    import pandas as pd

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]}, dtype="int64")

    return edges.coalesce(1).mapInPandas(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join that Spark can
    split, until every link is one of a star, or until the links are so few that a task may walk
    them. Every step is checkpointed. Null ends link nothing.
    """
    edges = kept(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a > b")
        .distinct()
    )

    def stars(e: DataFrame) -> bool:
        """Whether each larger end has one link and is the smaller end of none."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(e.select("b", F.lit(0)))
        each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
        return each.where("ups > 0 AND n > 1").isEmpty()

    while edges.count() > FEW_LINKS and not stars(edges):
        # large star: every neighbour above a node links to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = kept(edges.where("a <> b"))
        # small star: a node and its smaller neighbours link to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        pairs = edges.join(least, "a")
        edges = kept(
            pairs.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
    if edges.count() <= FEW_LINKS:
        return walked(edges)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def in_blocks(rows: DataFrame, key: str, number: str, most: int) -> DataFrame:
    """Deals the rows of each key into blocks of at most about 2 * `most` rows, so that every two rows of a key meet in one.

    A key with more than `most` rows is cut into chunks by a hash of the column `number`; a block takes
    two chunks, and a row goes to one block for each chunk. Adds block (long), side (0 or 1: the chunk
    of the block that the row belongs to) and alone (the block is one chunk).
    """
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    rows = rows.join(counts, key).withColumn("chunk", F.pmod(F.xxhash64(number), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("*", other)
    block = F.xxhash64(key, F.least("chunk", "other"), F.greatest("chunk", "other"))
    return (
        rows.withColumn("block", block)
        .withColumn("side", (F.col("chunk") > F.col("other")).cast("int"))
        .withColumn("alone", F.col("chunk") == F.col("other"))
        .drop("chunk", "other", "chunks", key)
    )


def stacked(cells, dtype):
    """The rows of a binary column as one array, short ones filled up with zeros."""
    import numpy as np

    cells = list(cells)
    width = max(map(len, cells))
    data = b"".join(cells if min(map(len, cells)) == width else [c.ljust(width, b"\0") for c in cells])
    return np.frombuffer(data, dtype=dtype).reshape(len(cells), -1)


def by_block(rows: DataFrame, prepare, pairs, groups: int, found: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The distinct (a, b), or other longs as named, that pairs(columns) finds in each block, many blocks to a call of Python.

    prepare(frame) makes the dictionary of arrays, for many blocks at once; pairs gets their slices.
    """
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        ids = frame["block"].to_numpy()
        columns = prepare(frame) | {"side": frame["side"].to_numpy(), "alone": frame["alone"].to_numpy()}
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = [
            pairs({k: v[a:b] for k, v in columns.items()})
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True) if b - a > 1
        ]
        rows = np.concatenate([np.empty((0, len(found)), dtype=np.int64), *(x for x in out if len(x))])
        return pd.DataFrame(np.unique(rows, axis=0), columns=list(found))

    dealt = F.pmod("block", F.lit(groups)).alias("dealt")
    return rows.groupBy(dealt).applyInPandas(run, ", ".join(f"{c} long" for c in found)).distinct()


def key_of(name: str):
    """A string that is never null and tells null ids from all others; id_of() is its inverse."""
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def id_of(key: str, kind: str):
    return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1)).cast(kind)


def in_order(rows: DataFrame, key: str, order: list[str], sent: list, schema: str, start, take, end) -> DataFrame:
    """The rows that end(key, state) gives for each key, once take(state, columns, a, b) has seen all its rows by `order`.

    A key's rows stream through one task; of a large one, only a batch and the state are in memory.
    columns are lists of what is `sent` beside the key, of which rows a to b - 1 are the key's.
    """
    import numpy as np
    import pandas as pd

    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            columns, out = {c: batch[c].tolist() for c in batch.columns}, []
            keys = batch[key].to_numpy(object)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if state is None or keys[a] != now:
                    if state is not None:
                        out.extend(end(now, state))
                    now, state = keys[a], start()
                take(state, columns, a, b)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(end(now, state), columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, *sent).mapInPandas(run, schema)
