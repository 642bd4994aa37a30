"""Shards by a Feistel permutation of global row numbers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import free_name, table

ROUNDS = 6
WALK = 64


def permuted(number: Column, total: Column, seed: int = 0) -> Column:
    """The place, from 0 to total - 1, of each row number from 0 to total - 1.

    The numbers are pairs (l, r) with l < p and r < q, p = ceil(sqrt(total)), q = ceil(total / p);
    each round adds a hash of one half to the other, so that every round can be undone. Results
    beyond total are fed in again (cycle walking). Fewer than p values lie beyond, so the walk ends
    within p steps for any total, and past WALK steps with a chance below (1 / q) ** WALK; then
    the row fails loudly.
    """
    p = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    p = F.greatest(p, F.lit(1))
    q = F.ceil(total / p).cast("long")

    def once(x: Column) -> Column:
        start = F.struct((x / q).cast("long").alias("l"), (x % q).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), p), p)
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), q), q)
            even = i % 2 == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, start, turn, lambda s: s["l"] * q + s["r"])

    steps = F.array(*[F.lit(i) for i in range(WALK)])
    out = F.aggregate(steps, once(number), lambda x, _: F.when(x < total, x).otherwise(once(x)))
    return F.when(out < total, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, by: list[str], number: str, total: str, buckets: int = 4096) -> DataFrame:
    """df with a global row number from 0 and the count of all rows.

    Rows go to buckets by a hash of the columns `by`, are ordered by them in the bucket, and a table
    of at most `buckets` counts, which alone is broadcast, says where each bucket begins. The order
    depends on the values only, so the numbers come out alike in every run.
    """
    b, n, first = free_name(df, "bucket", "n", "first")
    rows = df.withColumn(b, F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = rows.groupBy(b).agg(F.count("*").alias(n))
    whole = Window.partitionBy(F.lit(0))
    starts = counts.select(
        b, (F.sum(n).over(whole.orderBy(b)) - F.col(n)).alias(first), F.sum(n).over(whole).alias(total)
    )
    place = F.row_number().over(Window.partitionBy(b).orderBy(*by)) - 1
    return (
        rows.withColumn(n, place).join(F.broadcast(starts), b)
        .withColumn(number, F.col(first) + F.col(n)).drop(b, n, first)
    )


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Deals rows with doc_id and text into shards whose counts differ by one at most.

    The shuffled place of a row is a Feistel permutation of its global row number; shard is the
    place modulo `shards` and slot the place divided by `shards`, so both can be computed for any
    row number without a lookup. Repeated rows get places of their own; rows with a null doc_id or
    null text are dealt like others (size 1, crc of no bytes); an empty table gives no rows; further
    columns of docs are left aside.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "size", "text_crc32"], "number", "total")
    place = F.col("place")
    return rows.withColumn("place", permuted(F.col("number"), F.col("total"), seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
