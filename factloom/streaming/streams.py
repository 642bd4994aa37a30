"""Streams of page versions and fetches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from factloom.operators import watch
from factloom.operators.sites import FAILURES
from factloom.sources import versions


def new_versions(pages: DataFrame, at: str = "fetched_at", kept: str = "90 days") -> DataFrame:
    """The first version of each content hash; a hash is forgotten after `kept`, as stored versions are."""
    return pages.where("status = 'ok'").withWatermark(at, kept).dropDuplicatesWithinWatermark(["content_hash"])


def write_new_versions(pages: DataFrame, path: str, checkpoint: str):
    """Appends new versions to parquet; a restart goes on where the checkpoint says."""
    return (
        new_versions(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


HEALTH = "site string, reads long, failures long, streak long, last_failure timestamp"


def site_health_stream(log: DataFrame) -> DataFrame:
    """Health of the sites of a stream of fetches (site, status, at, seq), told anew for each site that a trigger brings.

    Each site's record is state of its own, so a trigger touches only its sites. Fetches are put in
    order within a trigger; those of an earlier time that come later count behind.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reads, failures, streak, last = state.get if state.exists else (0, 0, 0, None)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for status, at in zip(rows["status"], rows["at"], strict=True):
            if status == "ok":
                reads, streak = reads + 1, 0
            else:
                failures, streak = failures + 1, streak + 1
                last = at if last is None else max(last, at)
        state.update((reads, failures, streak, last))
        yield pd.DataFrame({"site": [key[0]], "reads": [reads], "failures": [failures], "streak": [streak], "last_failure": [last]})

    rows = log.where(F.col("status").isin("ok", *FAILURES)).select("site", "status", "at", "seq")
    shape = HEALTH.replace("site string, ", "")
    return rows.groupBy("site").applyInPandasWithState(step, HEALTH, shape, "update", GroupStateTimeout.NoTimeout)


ALERT = "watch string, key string, run_id long, change string, amount double, previous double, starts boolean"


def condition_stream(facts: DataFrame) -> DataFrame:
    """(watch, key, run_id, change, amount, previous, starts) of a stream of facts (watch, key, run_id, amount, holds).

    Each fact of a watch is state of its own: its last amount, and whether its condition held. A fact is
    new, changed or same by what its key had before; starts says that its condition holds and did not at the
    fact before, so each start alerts once, also over restarts from the checkpoint.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, held = state.get if state.exists else (None, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("run_id").itertuples():
            change = "new" if before is None else "changed" if before != row.amount else "same"
            out.append((*key, row.run_id, change, row.amount, before, bool(row.holds and not held)))
            before, held = row.amount, bool(row.holds)
        state.update((float(before), held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])

    rows = facts.where("amount IS NOT NULL").select("watch", "key", "run_id", "amount", F.coalesce("holds", F.lit(False)).alias("holds"))
    return rows.groupBy("watch", "key").applyInPandasWithState(step, ALERT, "amount double, held boolean", "append", GroupStateTimeout.NoTimeout)


def watch_stream(runs: DataFrame, rules: DataFrame, folder: str, checkpoint: str):
    """Starts the query that applies a stream of runs (watch.RUN) to ledgers, alerts and observations in `folder`.

    Each trigger's runs go through watch.apply_run() in the order of their time, the n-th of every watch together, and become
    one version of all tables, published once it is whole under the trigger's number. So a trigger that fails and is
    repeated, or a restart from the checkpoint, alerts nobody twice, and what a watch knows always fits its alerts.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions.published(spark, folder)
        if last is not None and last[0] >= number:
            return
        path = last[1] if last else None
        nth = F.row_number().over(Window.partitionBy("watch").orderBy("at", "run_id"))
        inbox = versions.stored({"runs": batch.withColumn("nth", nth)}, folder, f"inbox-{number}")
        arrived = spark.read.parquet(f"{inbox}/runs")
        most = arrived.agg(F.max("nth")).first()[0] or 0
        for n in range(1, most + 1):
            state = watch.apply_run(versions.load(spark, path, watch.STATE), arrived.where(F.col("nth") == n).drop("nth"), rules)
            path = versions.stored(state, folder, f"v{number}-{n}")
        if most:
            versions.publish(spark, folder, number, path)

    return runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_state(spark, folder: str) -> dict[str, DataFrame]:
    """The tables (watch.STATE) that watch_stream() published last."""
    last = versions.published(spark, folder)
    return versions.load(spark, last[1] if last else None, watch.STATE)
