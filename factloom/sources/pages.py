"""Page versions, fetch caches, exports and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetch_status(code: Column) -> Column:
    return (
        F.when(code.between(200, 299), "ok").when(code.isin(401, 403, 407, 429, 451), "blocked").when(code.isin(404, 410), "not_found")
        .when(code >= 500, "server_error").otherwise("http_error")
    )


def readable_status(text: Column, junk: Column, n_offers: Column) -> Column:
    return F.when(junk, "junk").when((F.length(text) >= 200) | (n_offers > 0), "ok").otherwise("empty")


def content_hash(text: Column, offers: Column | None = None) -> Column:
    """The hash of a page's text and of its offers (product, price, currency, availability, unit), None where a part is missing."""
    if offers is None:
        return F.sha2(text, 256)
    part = lambda o, c: F.concat(F.lit("|"), F.coalesce(o[c].cast("string"), F.lit("None")))
    each = F.transform(offers, lambda o: F.concat(*[part(o, c) for c in ("product", "price", "currency", "availability", "unit")]))
    return F.sha2(F.concat(text, F.array_join(each, "")), 256)


def first_versions(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: the first writer of a content hash wins. A grouped minimum, combined before the shuffle."""
    rest = F.struct(*[c for c in docs.columns if c != key])
    return docs.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("row")).select(key, "row.*")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as a grouped maximum."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("row")).select(key, "row.*")


def append_snapshots(docs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows to append: versions whose hash is not stored yet, the first writer of each."""
    return first_versions(docs.where("status = 'ok'"), "content_hash", ["fetched_at", "url"]).join(snapshots, "content_hash", "left_anti")


def fresh(rows: DataFrame, now: Column, version: Column | None = None, watch: Column | None = None) -> DataFrame:
    """Cached rows that may be used: answers for an hour, failures that may pass for ten minutes, a watch's pages for five.

    version: whether the extractor that read the page is the present one, asked of answers only. watch: whether a watch asks.
    """
    age = now.cast("long") - F.col("fetched_at").cast("long")
    life = F.when(F.col("status") == "ok", F.when(watch, 300).otherwise(3600) if watch is not None else F.lit(3600)).otherwise(600)
    current = (F.col("status") != "ok") | version if version is not None else F.lit(True)
    return rows.where((age >= 0) & (age < life) & current)


def search_key(engine: Column, news: Column, region: Column, recency: Column, results: Column, query: Column) -> Column:
    """What a search is cached under (a fixed format)."""
    kind = F.when(news, "news").otherwise("web")
    return F.concat_ws("|", engine, kind, region, F.coalesce(recency, F.lit("any")), results.cast("string"), query)


def answered(requests: DataFrame, cache: DataFrame, key: str, now: Column, life: int = 3600) -> DataFrame:
    """Each request with `usable`, and the newest cached row of its key in `cached` where that may be used: hits and misses by one join.

    cache: key, fetched_at, results (an array). Searches without results are never taken from the cache, as an engine may only
    have been slow; of a key's rows the newest counts, a grouped maximum. Rows from after `now` do not count.
    """
    rest = F.struct(*[c for c in cache.columns if c != key])
    rows = cache.where((F.size("results") > 0) & (F.col("fetched_at") <= now))
    newest = rows.groupBy(key).agg(F.max_by(rest, "fetched_at").alias("cached"))
    age = now.cast("long") - F.col("cached.fetched_at").cast("long")
    usable = F.coalesce(age < life, F.lit(False))
    out = requests.join(newest, key, "left").withColumn("usable", usable)
    return out.withColumn("cached", F.when(F.col("usable"), F.col("cached")))


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def prune(snapshots: DataFrame, used: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Snapshots to drop: older than `days`, not the newest of their URL, and not among the hashes that recent runs used."""
    newest = snapshots.groupBy(F.col("url").alias("_url")).agg(F.max("fetched_at").alias("_newest"))
    old = snapshots.where(F.col("fetched_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    old = old.join(newest, F.col("url").eqNullSafe(F.col("_url"))).where(F.col("fetched_at") < F.col("_newest")).drop("_url", "_newest")
    return old.join(used, "content_hash", "left_anti")


def write_ratings(ratings: DataFrame, path: str) -> None:
    """JSON Lines in the order of rating."""
    ratings.orderBy("rated_at", "run_id", "number").write.json(path)


def write_observations(observations: DataFrame, path: str) -> None:
    text = [c for c, t in observations.dtypes if t == "string"]
    observations.withColumns({c: guarded(F.col(c)) for c in text}).write.csv(path, header=True)
