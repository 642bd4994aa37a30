"""Sites: health of fetching, standing of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of a fetch that count against a site.
FAILURES = "blocked timeout network_error server_error junk empty".split()


def site_health(log: DataFrame) -> DataFrame:
    """reads, failures, streak of failures since the last success and last_failure of each site of a fetch log (site, status, at, seq)."""
    ok, at = F.col("status") == "ok", F.struct("at", "seq")
    rows = log.where(F.col("status").isin("ok", *FAILURES))
    each = rows.groupBy("site").agg(
        F.count_if(ok).alias("reads"), F.count_if(~ok).alias("failures"), F.max(F.when(~ok, F.col("at"))).alias("last_failure"), F.max(F.when(ok, at)).alias("success")
    )
    # the failures behind a site's last success: a join and a count, so that no site's log is sorted in one task
    behind = rows.where(~ok).select("site", at.alias("place")).join(each.select("site", "success"), "site").where("success IS NULL OR place >= success")
    streak = behind.groupBy("site").agg(F.count("*").alias("streak"))
    return each.join(streak, "site", "left").select("site", "reads", "failures", F.coalesce("streak", F.lit(0)).alias("streak"), "last_failure")


def avoided(streak: Column, last_failure: Column, now: Column) -> Column:
    """A site that failed three times in a row is left alone for seven days."""
    return F.coalesce((streak >= 3) & (now.cast("long") - last_failure.cast("long") < 7 * 86_400), F.lit(False))


def standing(findings: Column, verified: Column, rated_bad: Column) -> Column:
    """From -1 to 1, 0 where nothing is known; a verified finding that was rated bad weighs double."""
    good = F.greatest(verified - rated_bad, F.lit(0)) + 1
    bad = findings - verified + 2 * rated_bad + 1
    return (good - bad) / (good + bad)


def bonus(findings: Column, verified: Column, rated_bad: Column) -> Column:
    """What a site's standing adds to the ranking of its hits."""
    return 0.1 * standing(findings, verified, rated_bad)
