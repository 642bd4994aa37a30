"""Research runs: queries, coverage, sources, staleness, evidence of claims, stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a recency, tokens kept back for the reply, characters of a token.
PERIODS = {"day": 1, "week": 7, "month": 31, "year": 366}
CHARS_PER_TOKEN = 3.2


def tidy_queries(queries: Column, goal: Column, limit: int = 4) -> Column:
    """Trimmed queries without blanks, each once whatever its case, at most `limit`; the goal alone where none is left."""
    kept = F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q != "")
    lowered = F.transform(kept, lambda q: F.lower(q))
    first = F.filter(kept, lambda q, i: F.array_position(lowered, F.lower(q)) == i + 1)
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, F.slice(first, 1, limit)).otherwise(F.array(goal))


def coverage(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(goal, text_id, coverage) of all texts: the share of the query's terms in a text, weighted by rarity within the goal.

    queries has goal and tokens, texts goal, text_id and tokens. Only the words asked for leave the
    join, so counts are made from these and not from the whole vocabulary. No terms give 0.
    """
    asked = queries.select("goal", F.explode(F.array_distinct("tokens")).alias("term"))
    words = texts.select("goal", "text_id", F.explode(F.array_distinct("tokens")).alias("term"))
    present = words.join(asked, ["goal", "term"])
    totals = texts.groupBy("goal").agg(F.count("*").alias("total"))
    seen = present.groupBy("goal", "term").agg(F.count("*").alias("df"))
    df = F.coalesce("df", F.lit(0))
    weights = asked.join(totals, "goal").join(seen, ["goal", "term"], "left").select(
        "goal", "term", F.log(1 + (F.col("total") - df + 0.5) / (df + 0.5)).alias("weight")
    )
    whole = weights.groupBy("goal").agg(F.sum("weight").alias("whole"))
    part = present.join(weights, ["goal", "term"]).groupBy("goal", "text_id").agg(F.sum("weight").alias("part"))
    rows = texts.select("goal", "text_id").join(part, ["goal", "text_id"], "left").join(whole, "goal", "left")
    return rows.select("goal", "text_id", F.round(F.coalesce(F.col("part") / F.col("whole"), F.lit(0.0)), 6).alias("coverage"))


def source_budget(context: Column) -> Column:
    """Characters of sources that fit into a context of so many tokens."""
    reply = F.greatest(F.lit(2048), F.floor(context / 4))
    tokens = F.greatest(F.lit(1024), context - reply - 1200)
    return F.floor(tokens * CHARS_PER_TOKEN).cast("long")


def drop_read(hits: DataFrame, read: DataFrame, canonical: str) -> DataFrame:
    """Hits whose canonical URL was not read before."""
    return hits.join(read.select(canonical).distinct(), canonical, "left_anti")


def build_sources(hits: DataFrame, docs: DataFrame, start: int = 1) -> DataFrame:
    """Numbered sources of each goal: the text of the document of a hit, or its snippet where that cannot be read.

    hits has goal, rank, url, title and snippet; docs has url, status, text and title. A document
    counts where its status is ok; titles fall back to the hit's. Equal ranks go by URL and snippet.
    """
    pages = docs.select("url", "status", F.col("text").alias("page"), F.col("title").alias("page_title"))
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    order = Window.partitionBy("goal").orderBy("rank", "url", "snippet")
    return hits.join(pages, "url", "left").select(
        "goal", (F.row_number().over(order) + (start - 1)).alias("number"), "url", F.when(ok, F.col("page")).otherwise(F.col("snippet")).alias("text"),
        F.coalesce(F.when(ok, F.nullif("page_title", F.lit(""))), "title").alias("title"), (~ok).alias("snippet_only"),
        F.coalesce("status", F.lit("missing")).alias("status"),
    )


def unreadable_summary(sources: DataFrame) -> DataFrame:
    """(run, summary): how many sources of each status could not be read, by status."""
    counts = sources.where("snippet_only").groupBy("run", "status").agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.concat_ws(" ", "status", F.col("n").cast("string"))))
    return counts.groupBy("run").agg(F.array_join(parts, ", ").alias("summary"))


def stale(kind: Column, recency: Column, trusted: Column, published: Column, today: Column) -> Column:
    """Whether a trusted finding of news or a release is older than twice the period asked for."""
    days = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])[recency]
    return F.coalesce(kind.isin("news", "release") & trusted & (F.datediff(today, published) > 2 * days), F.lit(False))


def carried_over(before: DataFrame, now: DataFrame, run: str, reading: list[str]) -> DataFrame:
    """(run, carried): whether both sides read the same, each reading once; true lets the earlier analysis stand.

    Grouped twice, so that no run's readings are gathered.
    """
    both = before.select(run, *reading, F.lit(1).alias("b"), F.lit(0).alias("n")).unionByName(
        now.select(run, *reading, F.lit(0).alias("b"), F.lit(1).alias("n"))
    )
    each = both.groupBy(run, *reading).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    return each.groupBy(run).agg(F.bool_and((F.col("b") == 1) & (F.col("n") == 1)).alias("carried"))


def number_sources(found: DataFrame) -> DataFrame:
    """(check, reading, number): one number for each reading of a check, by its first place; equal places go by reading."""
    first = found.groupBy("check", "reading").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("check").orderBy("pos", "reading")
    return first.select("check", "reading", F.row_number().over(order).alias("number"))


def assemble(evidence: DataFrame, order: list[str]) -> DataFrame:
    """(check, claim, supports, refutes, set_aside): evidence numbered over the check, trusted first, as sorted arrays of each claim.

    A claim has a few quotes, which bounds the arrays.
    """
    number = F.row_number().over(Window.partitionBy("check").orderBy(F.desc("trusted"), *order))
    rows = evidence.withColumn("number", number)
    of = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("number"))))
    trusted, stance = F.col("trusted"), F.col("stance")
    return rows.groupBy("check", "claim").agg(
        of(trusted & (stance == "supports")).alias("supports"), of(trusted & (stance == "refutes")).alias("refutes"),
        of(~trusted | ~stance.isin("supports", "refutes")).alias("set_aside"),
    )


def site_tallies(findings: DataFrame) -> DataFrame:
    """Findings of each host and how many of them were verified."""
    return findings.groupBy("host").agg(F.count("*").alias("findings"), F.count_if("verified").alias("verified"))


def run_json(run: Column) -> Column:
    return F.to_json(run)


def run_from_json(text: Column, schema: str) -> Column:
    """A run from its JSON; fields that it was written without are null."""
    return F.from_json(text, schema)


def remembered(runs: DataFrame) -> DataFrame:
    """(url, quote, claim, last_seen) of the trusted findings of runs (run_id, started_at, findings, sources).

    A finding meets the sources of its own run within the row, without a join; each url and quote
    keeps its oldest claim and its newest time.
    """
    rows = runs.select("run_id", "started_at", "sources", F.posexplode("findings").alias("pos", "finding")).where("finding.trusted")
    mine = F.filter("sources", lambda s: s["index"] == F.col("finding.source"))
    rows = rows.select("run_id", "started_at", "pos", "finding", F.explode(mine).alias("source"))
    at = F.struct("started_at", "run_id", "pos")
    return rows.groupBy(F.col("source.url").alias("url"), F.col("finding.quote").alias("quote")).agg(
        F.min_by("finding.claim", at).alias("claim"), F.max("started_at").alias("last_seen")
    )


def rating_lines(ratings: DataFrame, order: list[str]) -> DataFrame:
    """Ratings as JSON lines, sorted over all files; `.write.text` stores them."""
    return ratings.orderBy(*order).select(F.to_json(F.struct(*ratings.columns)).alias("line"))
