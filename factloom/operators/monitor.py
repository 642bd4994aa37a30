"""Watches: alerts, conditions, rules, ratings, evidence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.urls import hostname


def condition_starts(evaluations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The evaluations at which a condition holds and did not at the one before."""
    before = F.lag("holds").over(Window.partitionBy(*key).orderBy(*order))
    return evaluations.withColumn("before", F.coalesce(before, F.lit(False))).where("holds AND NOT before").drop("before")


def moved(kind: str, old: Column, new: Column, percent: float) -> Column:
    """Whether a value dropped or rose by a percentage or more."""
    change = (new - old) * 100
    change = -change if kind == "drop" else change
    return F.coalesce((old != 0) & (change >= old * percent), F.lit(False))


def confidence(findings: DataFrame) -> DataFrame:
    """Level of each run from findings (run_id, trusted, site): high needs 3 trusted from 2 sites and 70 in 100."""
    got = findings.groupBy("run_id").agg(
        F.count("*").alias("findings"), F.count_if("trusted").alias("trusted"),
        F.count_distinct(F.when(F.col("trusted"), F.col("site"))).alias("sites"),
    )
    high = (F.col("trusted") >= 3) & (F.col("sites") >= 2) & (10 * F.col("trusted") >= 7 * F.col("findings"))
    return got.withColumn("level", F.when(high, "high").when(F.col("trusted") > 0, "medium").otherwise("low"))


def assess(findings: DataFrame, sources: DataFrame, runs: DataFrame, stale_days: int = 30) -> DataFrame:
    """confidence() of each run, one level lower for news whose newest trusted page is too old or undated.

    findings: run_id, source_no, trusted. sources: run_id, source_no, url, published, updated. runs: run_id, kind, today.
    """
    rows = findings.join(sources.select("run_id", "source_no", hostname(F.col("url")).alias("site"), F.greatest("published", "updated").alias("day")), ["run_id", "source_no"], "left")
    newest = rows.where("trusted").groupBy("run_id").agg(F.max("day").alias("day"))
    out = runs.join(confidence(rows), "run_id", "left").join(newest, "run_id", "left")
    old = (F.col("kind") == "news") & ~F.coalesce(F.datediff("today", "day") <= stale_days, F.lit(False))
    level = F.coalesce("level", F.lit("low"))
    level = F.when(old & (level == "high"), "medium").when(old & (level == "medium"), "low").otherwise(level)
    return out.select("run_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("trusted", F.lit(0)).alias("trusted"), F.coalesce("sites", F.lit(0)).alias("sites"), level.alias("level"))


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, numbered from 1; tasks drop what is beyond before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def with_last_run(watches: DataFrame, runs: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Every watch with its last run's columns, null where it never ran."""
    last = runs.groupBy("watch").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    return watches.join(last, "watch", "left")


def change_counts(deltas: DataFrame, key: str, change: str, kinds: list[str]) -> DataFrame:
    """How many changes of each kind a key has."""
    return deltas.groupBy(key).agg(*[F.count_if(F.col(change) == k).alias(k.lower()) for k in kinds])


def first_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos, copies): of equal keys the first, and how many there are."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos), F.count("*").alias("copies"))


def ruling(supports: Column, refutes: Column) -> Column:
    return F.when((supports > 0) & (refutes > 0), "disputed").when(supports > 0, "supported").when(refutes > 0, "refuted").otherwise("unclear")


def last_verdicts(ratings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last verdict of each rated finding."""
    return ratings.groupBy(*key).agg(F.max_by("verdict", F.struct(*order)).alias("verdict"))


def report_order(findings: DataFrame) -> DataFrame:
    """Numbers findings of a run from 1, the trusted first, else as they came."""
    order = Window.partitionBy("run_id").orderBy(F.desc("trusted"), "pos")
    return findings.withColumn("number", F.row_number().over(order))


def due(watches: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(watch, due) of watches that are not paused: the last start and the interval, now at the earliest."""
    last = runs.groupBy("watch").agg(F.max("started_at").alias("last"))
    at = F.timestamp_seconds(F.col("last").cast("long") + F.col("interval"))
    rows = watches.where("NOT paused").join(last, "watch", "left")
    return rows.select("watch", F.coalesce(F.greatest(now, at), now).alias("due"))


def recency_level(published: Column, today: Column, days: int) -> Column:
    """0 within the days asked for, 1 dated but older, 2 undated or from the future."""
    age = F.datediff(today, published)
    return F.when(age.between(0, days), 0).when(age > days, 1).otherwise(2)


def widened(hits: DataFrame, group: str) -> DataFrame:
    """Of each group only the hits of its smallest level."""
    return hits.withColumn("least", F.min("level").over(Window.partitionBy(group))).where("level = least").drop("least")
