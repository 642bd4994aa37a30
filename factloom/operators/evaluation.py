"""Scores of evaluation cases, reports and feeds as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import fold

#: Fixed value: the name space of identifiers made from URLs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def eval_score(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(case, trusted, found, missed, violations) of cases (case, facts, untrusted) against findings (case, text, trusted).

    An expectation is present where a trusted finding's folded text holds it. Expectations and
    findings meet by case; only whether they do is grouped.
    """
    want = cases.select("case", F.explode(F.transform("facts", lambda t: F.struct(t.alias("t"), F.lit(True).alias("fact")))).alias("e")).unionByName(
        cases.select("case", F.explode(F.transform("untrusted", lambda t: F.struct(t.alias("t"), F.lit(False).alias("fact")))).alias("e"))
    ).select("case", "e.t", "e.fact")
    told = findings.where("trusted").select("case", fold(F.col("text")).alias("text"))
    met = want.distinct().withColumn("needle", fold(F.col("t"))).join(told, "case", "left").groupBy("case", "t", "fact").agg(
        F.coalesce(F.bool_or(F.contains("text", "needle")), F.lit(False)).alias("here")
    )
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("t"))))
    out = met.groupBy("case").agg(
        listed(F.col("fact") & F.col("here")).alias("found"), listed(F.col("fact") & ~F.col("here")).alias("missed"),
        listed(~F.col("fact") & F.col("here")).alias("violations"),
    )
    counts = told.groupBy("case").agg(F.count("*").alias("trusted"))
    none = F.array().cast("array<string>")
    rows = cases.select("case").join(out, "case", "left").join(counts, "case", "left")
    return rows.select("case", F.coalesce("trusted", F.lit(0)).alias("trusted"), *[F.coalesce(c, none).alias(c) for c in ("found", "missed", "violations")])


def regressions(baseline: DataFrame, scores: DataFrame) -> DataFrame:
    """(case, lost, newly_trusted) of the cases that got worse; cases that the baseline lacks are not compared."""
    old = baseline.select("case", F.col("found").alias("was"), F.col("violations").alias("had"))
    rows = scores.join(old, "case").select(
        "case", F.array_sort(F.array_except("was", "found")).alias("lost"), F.array_sort(F.array_except("violations", "had")).alias("newly_trusted")
    )
    return rows.where((F.size("lost") > 0) | (F.size("newly_trusted") > 0))


def restored(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sources of stored runs (run_id, source_no, content_hash, snippet_only) with the text and offers that they had then, and `gone`.

    snapshots: content_hash, text, offers. A page whose version is no longer stored counts as a snippet without text.
    """
    kept = snapshots.groupBy("content_hash").agg(F.first(F.struct("text", "offers")).alias("s"))
    rows = sources.drop("text", "offers").join(kept, "content_hash", "left")
    gone = ~F.col("snippet_only") & F.col("s").isNull()
    shown = F.when(~F.col("snippet_only"), F.col("s"))
    rows = rows.withColumns({"gone": gone, "text": F.coalesce(shown["text"], F.lit("")), "offers": shown["offers"]})
    return rows.withColumn("snippet_only", F.col("snippet_only") | F.col("gone")).drop("s")


def cases_from_runs(runs: DataFrame, sources: DataFrame, ratings: DataFrame) -> DataFrame:
    """(run_id, goal, plan, facts, untrusted, error) of stored runs as cases: good ratings are expected facts, bad ones must not be trusted.

    sources: as restored() gives them. ratings: run_id, number, verdict, value, quote. A run with pages that are gone
    is no case, and says how many.
    """
    lost = sources.groupBy("run_id").agg(F.count_if("gone").alias("lost"))
    text = F.coalesce("value", "quote")
    each = lambda verdict: F.sort_array(F.collect_list(F.when(F.col("verdict") == verdict, F.struct("number", text.alias("t")))))
    told = ratings.groupBy("run_id").agg(each("good").alias("good"), each("bad").alias("bad"))
    rows = runs.select("run_id", "goal", "plan").join(lost, "run_id", "left").join(told, "run_id", "left")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["t"]), F.array().cast("array<string>"))
    error = F.when(F.col("lost") > 0, F.concat(F.col("lost").cast("string"), F.lit(" page(s) are gone")))
    return rows.select("run_id", "goal", "plan", texts("good").alias("facts"), texts("bad").alias("untrusted"), error.alias("error"))


def replayed(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """(case, seq, purpose, reply) of requests (case, seq, purpose) met by recorded replies (case, purpose, replies): the n-th of a purpose by its n-th.

    reply is null where none is recorded.
    """
    nth = F.row_number().over(Window.partitionBy("case", "purpose").orderBy("seq"))
    rows = requests.withColumn("nth", nth).join(replies, ["case", "purpose"], "left")
    return rows.select("case", "seq", "purpose", F.get("replies", F.col("nth") - 1).alias("reply"))


def replay_counts(before: DataFrame, after: DataFrame, sources: DataFrame) -> DataFrame:
    """(run_id, findings_before, findings_after, trusted_before, trusted_after, note) of runs whose pages were analysed again.

    before and after: findings (run_id, trusted). sources: as restored() gives them; the note tells how many pages are gone.
    """
    count = lambda rows, when: rows.groupBy("run_id").agg(F.count("*").alias("findings_" + when), F.count_if("trusted").alias("trusted_" + when))
    lost = sources.groupBy("run_id").agg(F.count_if("gone").alias("lost"))
    rows = lost.join(count(before, "before"), "run_id", "left").join(count(after, "after"), "run_id", "left")
    note = F.concat(F.lit("replay of run "), F.col("run_id").cast("string"), F.when(F.col("lost") > 0, F.concat(F.lit("; "), F.col("lost").cast("string"), F.lit(" page(s) of it are no longer stored"))).otherwise(""))
    counts = [F.coalesce(f"{what}_{when}", F.lit(0)).alias(f"{what}_{when}") for what in ("findings", "trusted") for when in ("before", "after")]
    return rows.select("run_id", *counts, note.alias("note"))


def name_id(name: Column) -> Column:
    """The UUID of version 5 of a name in the name space of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def escaped(text: Column) -> Column:
    """Text for XML: without the characters that it forbids, marks as references."""
    text = F.regexp_replace(text, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def alert_feeds(alerts: DataFrame, watches: DataFrame, entries: int = 50) -> DataFrame:
    """(watch, feed): an Atom feed of each watch (watch, goal) with its newest alerts (watch, alert_id, created_at, reason, url, quote).

    Rows beyond the newest few go before they are gathered, partly before the shuffle too.
    """
    nth = F.row_number().over(Window.partitionBy("watch").orderBy(F.desc("created_at"), F.desc("alert_id")))
    rows = alerts.withColumn("nth", nth).where(F.col("nth") <= entries)
    tag = lambda name, text: F.concat(F.lit(f"<{name}>"), escaped(text), F.lit(f"</{name}>"))
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    link = F.when(F.col("url").rlike("^https?://"), F.concat(F.lit('<link href="'), F.replace(escaped(F.col("url")), F.lit('"'), F.lit("&quot;")), F.lit('"/>')))
    name = F.concat(F.lit("watch:"), "watch", F.lit(":alert:"), F.col("alert_id").cast("string"))
    entry = F.concat(
        F.lit("<entry>"), tag("id", F.concat(F.lit("urn:uuid:"), name_id(name))), tag("title", F.col("reason")), tag("updated", at),
        F.coalesce(link, F.lit("")), tag("summary", F.coalesce("quote", "reason")), F.lit("</entry>"),
    )
    each = rows.select("watch", F.struct("nth", at.alias("at"), entry.alias("entry")).alias("e")).groupBy("watch").agg(F.sort_array(F.collect_list("e")).alias("e"))
    out = watches.join(each, "watch", "left")
    head = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), tag("id", F.concat(F.lit("urn:uuid:"), name_id(F.concat(F.lit("watch:"), "watch")))),
        tag("title", F.col("watch")), tag("subtitle", F.col("goal")), tag("updated", F.coalesce(F.get("e", 0)["at"], F.lit(""))),
    )
    body = F.array_join(F.transform(F.coalesce("e", F.array().cast("array<struct<nth:int,at:string,entry:string>>")), lambda x: x["entry"]), "")
    return out.select("watch", F.concat(head, body, F.lit("</feed>")).alias("feed"))


def report_rows(findings: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(run_id, section, ord, text, url, reason) of reports: findings, the trusted first, sources, and claims with their rulings.

    findings: run_id, pos, claim, source_no, trusted, note. sources: run_id, source_no, title, url,
    snippet_only, status. claims: run_id, claim_no, claim, ruling.
    """
    order = Window.partitionBy("run_id").orderBy(F.desc("trusted"), "pos")
    urls = sources.select("run_id", "source_no", "url")
    found = findings.join(urls, ["run_id", "source_no"], "left").select(
        "run_id", F.when(F.col("trusted"), "finding").otherwise("set aside").alias("section"), F.row_number().over(order).cast("long").alias("ord"),
        F.col("claim").alias("text"), "url", F.when(~F.col("trusted"), F.col("note")).alias("reason"),
    )
    read = F.when(F.col("snippet_only"), F.concat(F.lit("snippet only ("), "status", F.lit(")"))).otherwise("yes")
    pages = sources.select("run_id", F.lit("source").alias("section"), F.col("source_no").cast("long").alias("ord"), F.col("title").alias("text"), "url", read.alias("reason"))
    ruled = claims.select(
        "run_id", F.lit("claim").alias("section"), F.col("claim_no").cast("long").alias("ord"), F.col("claim").alias("text"), F.lit(None).cast("string").alias("url"),
        F.col("ruling").alias("reason"),
    )
    return found.unionByName(pages).unionByName(ruled)
