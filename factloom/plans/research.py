"""Queries of research runs and deliveries over the given tables, with equal SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import urls as u
from factloom.operators import delivery, research
from factloom.plans.catalog import FOLDED, HOST, ORACLES, query, read

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
RUN = (
    "run_id bigint, started_at bigint, findings array<struct<claim:string,quote:string,source:int,trusted:boolean>>,"
    " sources array<struct<index:int,url:string>>, note string"
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored runs: a finding and a source for each of the few lines."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.struct(
            *LINE,
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("claim"),
            F.col("l_returnflag").alias("quote"), F.col("l_linenumber").alias("source"), (F.col("l_quantity") > 25).alias("trusted"),
        ).alias("f"),
        F.struct(F.col("l_linenumber").alias("index"), F.col("l_suppkey").cast("string").alias("url")).alias("s"),
    )
    rows = lines.groupBy("run_id").agg(F.sort_array(F.collect_list("f")).alias("findings"), F.sort_array(F.collect_set("s")).alias("sources"))
    bare = F.transform("findings", lambda f: F.struct(f["claim"].alias("claim"), f["quote"].alias("quote"), f["source"].alias("source"), f["trusted"].alias("trusted")))
    return rows.select("run_id", F.col("run_id").alias("started_at"), bare.alias("findings"), "sources")


@query("SELECT l_orderkey AS run_id, count(*)::BIGINT AS findings, count(DISTINCT (l_linenumber, l_suppkey))::BIGINT AS sources, count_if(l_quantity > 25)::BIGINT AS trusted, NULL::VARCHAR AS note FROM lineitem GROUP BY 1")
def a8_stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = runs(spark, sf_dir).select(research.run_json(F.struct("run_id", "started_at", "findings", "sources")).alias("json"))
    back = stored.select(research.run_from_json(F.col("json"), RUN).alias("r")).select("r.*")
    return back.select(
        "run_id", F.size("findings").cast("long").alias("findings"), F.size("sources").cast("long").alias("sources"),
        F.size(F.filter("findings", lambda f: f["trusted"])).cast("long").alias("trusted"), "note",
    )


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_suppkey::VARCHAR AS url FROM lineitem),
f AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS quote, l_partkey || '-' || l_suppkey AS claim, l_quantity > 25 AS trusted,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem)
SELECT s.url, f.quote, arg_min(f.claim, (f.o, f.pos)) AS claim, max(f.o) AS last_seen FROM f JOIN s ON s.o = f.o AND s.n = f.n WHERE f.trusted GROUP BY ALL"""
)
def a9_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.remembered(runs(spark, sf_dir))


@query("""SELECT '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' AS line FROM labels""")
def a10_rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.rating_lines(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query(
    """WITH q AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[.?!]'), lambda x: trim(x)), lambda x: x <> '') AS k FROM conversations WHERE text IS NOT NULL),
f AS (SELECT *, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) AS d FROM q)
SELECT conv_id, turn, CASE WHEN len(d) > 0 THEN array_to_string(d[1:4], '|') ELSE role END AS queries FROM f"""
)
def b17_tidy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    tidy = research.tidy_queries(F.split("text", "[.?!]"), F.col("role"))
    return rows.select("conv_id", "turn", F.array_join(tidy, "|").alias("queries"))


@query(
    """WITH q AS (SELECT DISTINCT n_regionkey AS goal, n_name AS term FROM nation),
w AS (SELECT c_custkey AS text_id, n_regionkey AS goal, unnest([n_name, c_mktsegment]) AS term FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT goal, text_id FROM w GROUP BY ALL), n AS (SELECT goal, count(*) AS total FROM t GROUP BY goal),
p AS (SELECT DISTINCT w.goal, text_id, term FROM w JOIN q USING (goal, term)), d AS (SELECT goal, term, count(*) AS df FROM p GROUP BY ALL),
i AS (SELECT q.goal, q.term, ln(1 + (total - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS weight FROM q JOIN n ON n.goal = q.goal LEFT JOIN d ON d.goal = q.goal AND d.term = q.term),
a AS (SELECT goal, sum(weight) AS whole FROM i GROUP BY goal), b AS (SELECT p.goal, text_id, sum(weight) AS part FROM p JOIN i ON i.goal = p.goal AND i.term = p.term GROUP BY ALL)
SELECT t.goal, t.text_id, round(coalesce(part / whole, 0), 6) AS coverage FROM t LEFT JOIN b ON b.goal = t.goal AND b.text_id = t.text_id LEFT JOIN a ON a.goal = t.goal"""
)
def d4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "goal")
    queries = nations.groupBy("goal").agg(F.collect_set("n_name").alias("tokens"))
    texts = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return research.coverage(queries, texts.select("goal", F.col("c_custkey").alias("text_id"), F.array("n_name", "c_mktsegment").alias("tokens")))


@query(
    f"""WITH c AS ({ORACLES["b10_canonical_urls"]})
SELECT page_id FROM c WHERE canonical NOT IN (SELECT canonical FROM c JOIN labels ON doc_id = page_id WHERE quality = 1)"""
)
def d6_drop_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "pages").select("page_id", u.canonical_url(F.col("url")).alias("canonical"))
    read_before = hits.join(read(spark, sf_dir, "labels").where("quality = 1"), F.col("page_id") == F.col("doc_id"), "left_semi")
    return research.drop_read(hits, read_before, "canonical").select("page_id")


@query(
    """SELECT o_orderkey, floor(greatest(1024, c - greatest(2048, floor(c / 4)) - 1200) * 3.2)::BIGINT AS budget
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS c FROM orders)"""
)
def d8_source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", research.source_budget(F.floor("o_totalprice")).alias("budget"))


SOURCES = """WITH h AS (SELECT DISTINCT l_orderkey AS goal, l_linenumber AS rank, l_partkey AS url, l_returnflag AS snippet FROM lineitem),
s AS (SELECT goal, row_number() OVER (PARTITION BY goal ORDER BY rank, url, snippet) AS number, url, CASE WHEN p_size >= 10 THEN p_name ELSE snippet END AS text,
p_size >= 10 AS ok, CASE WHEN p_size >= 10 THEN p_brand ELSE 'untitled' END AS title, CASE WHEN p_size >= 10 THEN 'ok' WHEN p_size >= 5 THEN 'empty' ELSE 'timeout' END AS status
FROM h JOIN part ON p_partkey = url)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    hits = line.select(
        F.col("l_orderkey").alias("goal"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("url"), F.col("l_returnflag").alias("snippet")
    ).distinct().withColumn("title", F.lit("untitled"))
    status = F.when(F.col("p_size") >= 10, "ok").when(F.col("p_size") >= 5, "empty").otherwise("timeout")
    docs = part.select(F.col("p_partkey").alias("url"), status.alias("status"), F.col("p_name").alias("text"), F.col("p_brand").alias("title"))
    return research.build_sources(hits, docs)


@query(SOURCES + "SELECT goal, number, url, text, title, NOT ok AS snippet_only, status FROM s")
def d9_build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir)


@query(
    SOURCES + """, n AS (SELECT goal, status, count(*) AS n FROM s WHERE NOT ok GROUP BY ALL)
SELECT goal AS run, string_agg(status || ' ' || n, ', ' ORDER BY status) AS summary FROM n GROUP BY goal"""
)
def d10_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.unreadable_summary(sources(spark, sf_dir).withColumnRenamed("goal", "run"))


@query(
    """WITH m AS (SELECT max(o_orderdate) AS today FROM orders), o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'news' WHEN 'O' THEN 'release' ELSE 'price' END AS kind,
CASE o_orderpriority[1:1] WHEN '1' THEN 1 WHEN '2' THEN 7 WHEN '3' THEN 31 WHEN '4' THEN 366 END AS days FROM orders)
SELECT o_orderkey, coalesce(kind IN ('news', 'release') AND o_totalprice > 1000 AND date_diff('day', o_orderdate::DATE, today::DATE) > 2 * days, false) AS stale FROM o, m"""
)
def f5_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    today = orders.agg(F.max("o_orderdate").alias("today"))
    status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    kind = F.when(status == "F", "news").when(status == "O", "release").otherwise("price")
    recency = F.when(level == "1", "day").when(level == "2", "week").when(level == "3", "month").when(level == "4", "year")
    found = research.stale(kind, recency, F.col("o_totalprice") > 1000, F.col("o_orderdate"), F.col("today"))
    return orders.crossJoin(F.broadcast(today)).select("o_orderkey", found.alias("stale"))


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS b, count_if(l_quantity > 3) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, bool_and(b = 1 AND n = 1) AS carried FROM g GROUP BY l_orderkey"""
)
def f7_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return research.carried_over(line, line.where("l_quantity > 3"), "l_orderkey", ["l_linenumber"])


@query(f"SELECT {HOST} AS host, count(*)::BIGINT AS findings, count_if(contains(html, '<article'))::BIGINT AS verified FROM pages GROUP BY 1")
def g6_site_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(u.hostname(F.col("url")).alias("host"), F.contains("html", F.lit("<article")).alias("verified"))
    return research.site_tallies(rows)


@query(
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS "check", l_suppkey AS reading, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_suppkey) AS number FROM f"""
)
def j4_number_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.number_sources(
        read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("check"), F.col("l_suppkey").alias("reading"), F.col("l_linenumber").alias("pos"))
    )


@query(
    """WITH e AS (SELECT l_orderkey AS c, l_partkey AS claim, l_quantity > 25 AS t, l_returnflag AS s,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity > 25 DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)
SELECT c AS "check", claim, coalesce(string_agg(n, ',' ORDER BY n) FILTER (t AND s = 'A'), '') AS supports,
coalesce(string_agg(n, ',' ORDER BY n) FILTER (t AND s = 'R'), '') AS refutes, coalesce(string_agg(n, ',' ORDER BY n) FILTER (NOT t OR s NOT IN ('A', 'R')), '') AS set_aside FROM e GROUP BY ALL"""
)
def j7_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("check"), F.col("l_partkey").alias("claim"), (F.col("l_quantity") > 25).alias("trusted"),
        F.when(flag == "A", "supports").when(flag == "R", "refutes").otherwise("neither").alias("stance"), *LINE,
    )
    out = research.assemble(rows, LINE)
    return out.select("check", "claim", *[F.array_join(out[c].cast("array<string>"), ",").alias(c) for c in ("supports", "refutes", "set_aside")])


@query(
    """WITH c AS (SELECT user_id, max(ts) AS changed FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.event_id, e.user_id AS watch FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE changed IS NULL OR ts >= changed"""
)
def k6_current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("watch"), F.col("ts").alias("at"), "event_type")
    return delivery.current_facts(events, events.where("event_type = 'error'")).select("event_id", "watch")


@query(
    """WITH m AS (SELECT max(ts) AS now FROM events), a AS (SELECT event_id, user_id, ts, CASE WHEN value > 50 THEN 259200 ELSE 86400 END AS every FROM events WHERE event_type <> 'error')
SELECT user_id AS watch, event_id AS alert_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM a, m
WHERE floor(epoch(now)) - floor(epoch(ts)) <= greatest(259200, 2 * every)"""
)
def k7_undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("watch"), F.col("event_id").alias("alert_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("value") > 50, 259_200).otherwise(86_400).alias("interval"), (F.col("event_type") == "error").alias("delivered"),
    )
    now = alerts.agg(F.max("created_at").alias("now"))
    return delivery.undelivered(alerts.crossJoin(F.broadcast(now)), F.col("now")).select("watch", "alert_id", "place")


@query(
    f"""SELECT source AS url, min(doc_id) AS first, max(doc_id) AS last_seen, count(*)::BIGINT AS times FROM documents JOIN labels USING (doc_id)
WHERE quality = 1 GROUP BY source, {FOLDED.format("text")}"""
)
def k8_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return delivery.learned(rows.select(F.col("source").alias("url"), F.col("text").alias("quote"), F.col("doc_id").alias("seen"), (F.col("quality") == 1).alias("trusted")))


PACKS = [
    ("price-{slug}", "Price of {product} by {brand}", ["below {limit}", "in stock at {store}", "drops 10%"]),
    ("news-{slug}", "News about {product}", ["mentions {brand}"]),
]


@query(
    """WITH p AS (SELECT p_name, p_brand, p_size, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60], '-+$', '') AS slug FROM part)
SELECT 'price-' || slug AS watch, 'Price of ' || p_name || ' by ' || p_brand AS goal, 'below ' || p_size || '|drops 10%' AS alerts FROM p
UNION ALL SELECT 'news-' || slug, 'News about ' || p_name, 'mentions ' || p_brand FROM p"""
)
def k12_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = read(spark, sf_dir, "part").select(F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_size").alias("limit"))
    out = delivery.expand_packs(params, PACKS, ["product", "brand", "limit"])
    return out.select("watch", "goal", F.array_join("alerts", "|").alias("alerts"))
