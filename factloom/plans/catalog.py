"""Queries over the given tables, one or more for each operator, with equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.functions import urls as u
from factloom.operators import monitor, retrieval, sites, values
from factloom.sources import pages as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FOLDED = "trim(regexp_replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH q AS (SELECT item_id AS quote_id, {FOLDED.format("text")} AS quote FROM benchmark WHERE text <> ''),
d AS (SELECT doc_id, source, {FOLDED.format("text")} AS t FROM documents)
SELECT d.source, count(DISTINCT q.quote_id)::BIGINT AS quotes, count(*)::BIGINT AS found FROM q JOIN d ON contains(d.t, q.quote) GROUP BY d.source"""
)
def f2_quotes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = retrieval.find_quotes(quotes, docs).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.count_distinct("quote_id").alias("quotes"), F.count("*").alias("found"))


@query(
    f"""WITH q AS (SELECT item_id AS quote_id, {FOLDED.format("text")} AS quote FROM benchmark WHERE text <> ''),
d AS (SELECT doc_id, {FOLDED.format("text")} AS t FROM documents)
SELECT q.quote_id, d.doc_id, strpos(d.t, q.quote)::BIGINT AS position FROM q JOIN d ON contains(d.t, q.quote)"""
)
def f2_find_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return retrieval.find_quotes(quotes, read(spark, sf_dir, "documents"))


@query("SELECT event_id, CASE WHEN c BETWEEN 200 AND 299 THEN 'ok' WHEN c IN (401,403,407,429,451) THEN 'blocked' WHEN c IN (404,410) THEN 'not_found' WHEN c >= 500 THEN 'server_error' ELSE 'http_error' END AS status FROM (SELECT event_id, 200 + event_id % 400 AS c FROM events)")
def a2_fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", p.fetch_status(200 + F.col("event_id") % 400).alias("status"))


@query("SELECT doc_id, CASE WHEN length(text) >= 200 THEN 'ok' ELSE 'empty' END AS status FROM documents")
def a3_readable_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", p.readable_status(text, t.looks_like_junk(text), F.lit(0)).alias("status"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("content_hash", p.content_hash(F.col("text")))
    return p.first_versions(docs.select("content_hash", "doc_id"), "content_hash", ["doc_id"]).select("content_hash", "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def a5_latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.latest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a6_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", p.content_hash(F.col("text")).alias("content_hash"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE epoch(now)::BIGINT - epoch(ts)::BIGINT >= 0 AND floor(epoch(now)) - floor(epoch(ts)) < CASE WHEN event_type = 'error' THEN 600 ELSE 3600 END")
def a7_fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("fetched_at"), F.when(F.col("event_type") == "error", "timeout").otherwise("ok").alias("status")
    )
    now = log.agg(F.max("fetched_at").alias("now"))
    return p.fresh(log.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def a11_guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", p.guarded(F.col("text")).alias("cell"))


@query(
    """WITH e AS (SELECT event_id, user_id, ts, md5(event_id::VARCHAR) AS h FROM events), m AS (SELECT max(ts) AS now FROM e),
o AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM e)
SELECT event_id FROM o, m WHERE ts < now - INTERVAL 7 DAY AND ts < newest
AND h NOT IN (SELECT h FROM e WHERE event_id % 10 = 0)"""
)
def a14_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("url"), F.col("ts").alias("fetched_at"), F.md5(F.col("event_id").cast("string")).alias("content_hash")
    )
    used = rows.where("event_id % 10 = 0").select("content_hash")
    now = rows.agg(F.max("fetched_at").alias("now"))
    return p.prune(rows.crossJoin(F.broadcast(now)), used, F.col("now"), 7).select("event_id")


@query("SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE 1.0 - length(regexp_replace(text, '[\\x{FFFD}\\p{Co}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g'))::DOUBLE / length(text) END, 9) AS ratio FROM documents")
def b3_junk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(t.junk_ratio(F.col("text")), 9).alias("ratio"))


@query(
    """WITH c AS (SELECT doc_id, text, text[1:79] AS cut, text[80:80] AS nxt FROM documents),
s AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS space, strpos(cut, ' ') > 0 AS has FROM c)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(
CASE WHEN NOT regexp_matches(nxt, '^\\s$') AND has AND space > 40 THEN cut[1:space] ELSE cut END, '\\s+$', '') || '…' END AS short FROM s"""
)
def b4_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.shorten(F.col("text"), 80).alias("short"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), l AS (SELECT page_id, host, string_split(host, '.') AS s FROM h)
SELECT page_id, host, array_to_string(s[greatest(len(s) - CASE WHEN len(s) > 2 AND length(s[-1]) = 2
AND s[-2] IN ('ac','co','com','edu','gov','net','or','org') THEN 2 ELSE 1 END, 1):], '.') AS domain FROM l"""
)
def b9_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = u.hostname(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), u.registrable_domain(host).alias("domain"))


@query(
    """WITH s AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS sc, regexp_extract(url, '://([^/?#]*)', 1) AS h,
regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
AND lower(split_part(x, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid','msclkid','yclid')) AS ks FROM s)
SELECT page_id, lower(sc) || '://' || lower(h) || CASE WHEN rtrim(pa, '/') = '' THEN '/' ELSE rtrim(pa, '/') END
|| CASE WHEN len(ks) = 0 THEN '' ELSE '?' || array_to_string(ks, '&') END AS canonical FROM k"""
)
def b10_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", u.canonical_url(F.col("url")).alias("canonical"))


@query(
    f"""SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS listed,
contains(url, '/s?') OR contains(url, '/search') OR contains(url, '/sch/') OR contains(url, '?q=') OR contains(url, '&q=') OR contains(url, '/pl?')
OR contains(url, '/category/') OR contains(url, '/tag/') AS listing FROM (SELECT page_id, url, {HOST} AS h FROM pages)"""
)
def b11_host_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", u.host_in(url, ["example.com"]).alias("listed"), u.is_listing(url).alias("listing"))


@query("SELECT o_orderkey, o_orderdate::DATE AS published FROM orders")
def b13_url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://news.example.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/story"))
    return read(spark, sf_dir, "orders").select("o_orderkey", u.url_date(url).alias("published"))


WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}](?:[\\p{L}\\p{N}\\p{M}.+#-]*[\\p{L}\\p{N}\\p{M}+#])?'), lambda x: x NOT IN (" + ",".join(f"'{w}'" for w in t.STOPWORDS) + ") AND NOT regexp_matches(x, '^[a-z]$'))"


@query(
    f"""WITH w AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, ws, CASE WHEN list_has_any(ws, {t.PRICE_WORDS}) THEN 'price' WHEN list_has_any(ws, {t.NEWS_WORDS}) THEN 'news'
WHEN list_has_any(ws, {t.RELEASE_WORDS}) THEN 'release' ELSE 'general' END AS kind FROM w)
SELECT conv_id, turn, kind, CASE WHEN list_contains(ws, 'today') THEN 'day' WHEN kind = 'price' THEN 'month' WHEN kind = 'news' THEN 'week'
WHEN kind = 'release' THEN 'year' END AS recency FROM k"""
)
def b16_classify_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, recency = t.classify_goal(F.col("text"))
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", kind.alias("kind"), recency.alias("recency"))


@query(f"WITH d AS (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents) SELECT doc_id, len({WORDS})::BIGINT AS words, len(list_distinct({WORDS}))::BIGINT AS terms FROM d")
def b18_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", t.tokenize(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("terms"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+n''t|[a-z]+|[0-9]+|\\.') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x, i: (x IN ('not','no','never','none','nobody','nothing','neither','nor','without','cannot') OR ends_with(x, 'n''t'))
AND NOT (x = 'not' AND coalesce(w[i+1], '') IN ('only','just','until')) AND NOT (x = 'no' AND (coalesce(w[i+1], '') = 'longer'
OR (coalesce(w[i+1], '') IN ('fewer','less','more') AND coalesce(w[i+2], '') = 'than') OR (coalesce(w[i+1], '') = '.' AND regexp_matches(coalesce(w[i+2], ''), '^[0-9]'))))))::BIGINT AS negations FROM w"""
)
def b21_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.negations(F.col("text")).cast("long").alias("negations"))


@query(
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'below $' || p_size || ',000' WHEN 1 THEN 'drops by ' || p_size || '%' WHEN 2 THEN 'mentions ' || p_brand
ELSE 'back in stock' END AS rule FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'below' WHEN 1 THEN 'drop' WHEN 2 THEN 'mentions' ELSE 'in_stock' END AS kind,
CASE WHEN p_partkey % 4 = 0 THEN replace(regexp_extract(rule, '\\$(.*)$', 1), ',', '')::BIGINT END AS amount,
CASE WHEN p_partkey % 4 = 0 THEN 'USD' END AS currency, CASE WHEN p_partkey % 4 = 1 THEN regexp_extract(rule, '(\\d+)%', 1)::BIGINT END AS percent,
CASE WHEN p_partkey % 4 = 2 THEN regexp_extract(rule, 'mentions (.*)$', 1) END AS phrase FROM r"""
)
def b22_parse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    rule = (
        F.when(k == 0, F.concat(F.lit("below $"), size, F.lit(",000"))).when(k == 1, F.concat(F.lit("drops by "), size, F.lit("%")))
        .when(k == 2, F.concat(F.lit("mentions "), "p_brand")).otherwise("back in stock")
    )
    rows = read(spark, sf_dir, "part").select("p_partkey", t.parse_rule(rule).alias("r"))
    return rows.select(
        "p_partkey", "r.kind", F.col("r.amount").cast("long").alias("amount"), "r.currency", F.col("r.percent").cast("long").alias("percent"), "r.phrase"
    )


@query(
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey AS watch, coalesce(greatest(now, last + to_seconds(CASE c_custkey % 3 WHEN 0 THEN 86400 WHEN 1 THEN 604800 ELSE 21600 END)), now) AS due
FROM customer LEFT JOIN l ON o_custkey = c_custkey, m WHERE c_custkey % 7 <> 0"""
)
def b23_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    every = F.when(k == 0, "1d").when(k == 1, "1w").otherwise("6h")
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("watch"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    now = runs.agg(F.max("started_at").alias("now"))
    watches = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("watch"), t.interval_seconds(every).alias("interval"), (F.col("c_custkey") % 7 == 0).alias("paused")
    )
    rows = monitor.due(watches.crossJoin(F.broadcast(now)), runs, F.col("now"))
    return rows.select("watch", F.col("due").cast("timestamp_ntz").alias("due"))


@query("SELECT p_partkey, rtrim(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')[1:30], '-') AS slug FROM part")
def b24_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", t.slug(F.col("p_name"), 30).alias("slug"))


@query("SELECT doc_id, translate(text, '<>[]', '‹›⁅⁆') AS inert FROM documents")
def b25_inert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.inert(F.col("text")).alias("inert"))


def goals_and_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.tokenize(F.col("text")).alias("tokens"))
    docs = read(spark, sf_dir, "documents").select("doc_id", t.tokenize(F.col("text")).alias("tokens"))
    return asked, docs


BM25 = f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS})) AS term FROM (SELECT item_id, replace(text, 'ß', 'ss') AS text FROM benchmark)),
d AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents)),
n AS (SELECT count(*) AS total, avg(len(ws)) AS average FROM d),
c AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM d) GROUP BY ALL),
i AS (SELECT term, ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c, n GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS score
FROM q JOIN c USING (term) JOIN i USING (term), n GROUP BY query_id, doc_id)
"""


@query(BM25 + "SELECT query_id, doc_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS r FROM s) WHERE r <= 10")
def d1_search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(*goals_and_docs(spark, sf_dir), 10)


@query(
    f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS goal, {HOST} AS host FROM pages),
r AS (SELECT *, (page_id * 7919) % 101 AS ranking, row_number() OVER (PARTITION BY goal ORDER BY page_id) AS rank FROM h),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY goal, host ORDER BY ranking DESC, rank) AS n FROM r) WHERE n <= 2)
SELECT goal, page_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY ranking DESC, rank) AS place FROM c) WHERE place <= 6"""
)
def d5_select_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("goal"), u.hostname(F.col("url")).alias("host"),
        ((F.col("page_id") * 7919) % 101).alias("ranking"), F.col("page_id").alias("rank"), F.col("page_id").alias("pos"),
    )
    return retrieval.capped(hits, 2, 6).select("goal", "page_id", "place")


@query(
    """WITH m AS (SELECT max(o_orderdate)::DATE AS today FROM orders),
l AS (SELECT o_custkey, o_orderkey, CASE WHEN today - o_orderdate::DATE BETWEEN 0 AND 31 THEN 0 WHEN today - o_orderdate::DATE > 31 THEN 1 ELSE 2 END AS level FROM orders, m)
SELECT o_custkey, o_orderkey, level FROM (SELECT *, min(level) OVER (PARTITION BY o_custkey) AS least FROM l) WHERE level = least"""
)
def d11_recency_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    today = orders.agg(F.max("o_orderdate").cast("date").alias("today"))
    hits = orders.crossJoin(F.broadcast(today)).select(
        "o_custkey", "o_orderkey", monitor.recency_level(F.col("o_orderdate").cast("date"), F.col("today"), 31).alias("level")
    )
    return monitor.widened(hits, "o_custkey")


@query(
    """WITH f AS (SELECT lang AS run_id, source, coalesce(quality = 1 AND toxic = 0, false) AS trusted FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT run_id, count(*) AS findings, count_if(trusted) AS trusted, count(DISTINCT CASE WHEN trusted THEN source END) AS sites FROM f GROUP BY run_id)
SELECT run_id, findings::BIGINT AS findings, trusted::BIGINT AS trusted, sites::BIGINT AS sites,
CASE WHEN trusted >= 3 AND sites >= 2 AND 10 * trusted >= 7 * findings THEN 'high' WHEN trusted > 0 THEN 'medium' ELSE 'low' END AS level FROM g"""
)
def f4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    trusted = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return monitor.confidence(rows.select(F.col("lang").alias("run_id"), F.col("source").alias("site"), trusted.alias("trusted")))


@query(
    """WITH f AS (SELECT source AS run_id, doc_id, coalesce(quality = 1 AND toxic = 0, false) AS trusted FROM documents LEFT JOIN labels USING (doc_id))
SELECT run_id, doc_id, row_number() OVER (PARTITION BY run_id ORDER BY trusted DESC, doc_id)::INT AS number FROM f"""
)
def f6_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    trusted = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    rows = rows.select(F.col("source").alias("run_id"), "doc_id", F.col("doc_id").alias("pos"), trusted.alias("trusted"))
    return monitor.report_order(rows).select("run_id", "doc_id", "number")


@query(
    """WITH o AS (SELECT p_type AS source, lower(p_name) AS product, round(p_retailprice * 100)::BIGINT AS price, p_partkey AS pos FROM part),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, product ORDER BY price, pos) AS n FROM o) WHERE n = 1)
SELECT source, product, price, pos, m::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY price, pos) AS m FROM a) WHERE m <= 3"""
)
def g2_cheapest_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = read(spark, sf_dir, "part").select(
        F.col("p_type").alias("source"), F.col("p_name").alias("product"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"),
        F.col("p_partkey").alias("pos"),
    )
    return values.cheapest_offers(offers)


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)\\b(ring|bolt|widget|gear)s?\\b') AND NOT contains('a new ring', lower(regexp_extract(p_name, '(?i)\\b(ring|bolt|widget|gear)s?\\b'))) AS accessory FROM part")
def g3_accessories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ring", "bolt", "widget", "gear"]
    return read(spark, sf_dir, "part").select("p_partkey", values.accessory(F.col("p_name"), F.lit("a new ring"), names).alias("accessory"))


@query(
    """WITH v AS (SELECT p_partkey, p_brand, round(p_retailprice * 100)::BIGINT AS amount FROM part),
o AS (SELECT a.p_partkey, a.amount, median(b.amount) AS m, count(*) AS n FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey GROUP BY ALL)
SELECT v.p_partkey, coalesce(o.n >= 2 AND (v.amount < 0.9 * o.m OR v.amount > 1.1 * o.m), false) AS outlier FROM v LEFT JOIN o USING (p_partkey)"""
)
def g4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("amount"))
    return values.flag_outliers(rows, ["p_brand"], "amount", ["p_partkey"], 0.9, 1.1).select("p_partkey", "outlier")


AMOUNT = "round(l_extendedprice / l_quantity * 100)::BIGINT"


@query(
    f"""WITH o AS (SELECT l_partkey, {AMOUNT} AS a, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k FROM lineitem)
SELECT l_partkey, arg_min(a, k) AS first, arg_max(a, k) AS last, min(a) AS low, max(a) AS high, count(*)::BIGINT AS points FROM o GROUP BY l_partkey"""
)
def g5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("a", F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long"))
    return values.series(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], "a")


@query("SELECT o_custkey, o_orderkey, r::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5")
def g8_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.newest(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "nth")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "network_error").when(F.col("event_type") == "signup", "not_found").otherwise("ok")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("site"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(
    """WITH e AS (SELECT user_id AS site, ts, event_id, (event_type <> 'error')::INT AS ok FROM events WHERE event_type <> 'signup'),
r AS (SELECT *, sum(ok) OVER (PARTITION BY site ORDER BY ts, event_id) AS epoch FROM e), m AS (SELECT site, max(epoch) AS e FROM r GROUP BY site)
SELECT r.site, sum(ok)::BIGINT AS reads, sum(1 - ok)::BIGINT AS failures, coalesce(sum(1 - ok) FILTER (epoch = e), 0)::BIGINT AS streak,
max(ts) FILTER (ok = 0) AS last_failure FROM r JOIN m USING (site) GROUP BY r.site"""
)
def h1_site_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_health(fetch_log(spark, sf_dir))


@query(
    """WITH g AS (SELECT source, count(*) AS f, count_if(quality = 1) AS v, count_if(quality = 1 AND toxic = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(((greatest(v - b, 0) + 1) - (f - v + 2 * b + 1))::DOUBLE / ((greatest(v - b, 0) + 1) + (f - v + 2 * b + 1)), 9) AS standing FROM g"""
)
def h2_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.count("*").alias("f"), F.count_if(F.col("quality") == 1).alias("v"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("b")
    )
    return rows.select("source", F.round(sites.standing(F.col("f"), F.col("v"), F.col("b")), 9).alias("standing"))


MOVES = f"""WITH o AS (SELECT l_partkey, l_orderkey, l_linenumber, {AMOUNT} AS a, l_shipdate, l_extendedprice, l_quantity FROM lineitem),
m AS (SELECT *, lag(a) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS b FROM o)
"""


def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("a", F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long"))
    return values.moves(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], "a")


@query(MOVES + "SELECT l_partkey, l_orderkey, l_linenumber, a AS amount, b AS previous FROM m")
def h3_price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_moves(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber", F.col("a").alias("amount"), "previous")


@query(MOVES + "SELECT l_partkey, l_orderkey, l_linenumber, a AS amount, b AS previous FROM m WHERE b <> 0 AND (b - a) * 100 >= b * 20")
def k4_drop_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_moves(spark, sf_dir).where(monitor.moved("drop", F.col("previous"), F.col("a"), 20))
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", F.col("a").alias("amount"), "previous")


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, value > 50 AS h, coalesce(lag(value > 50) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), false) AS b
FROM events) WHERE h AND NOT b"""
)
def h4_condition_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("holds", F.col("value") > 50)
    return monitor.condition_starts(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def h5_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.first_wins(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "copies")


@query(
    """WITH g AS (SELECT source, count_if(quality = 1) AS s, count_if(quality = 0) AS r FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN s > 0 AND r > 0 THEN 'disputed' WHEN s > 0 THEN 'supported' WHEN r > 0 THEN 'refuted' ELSE 'unclear' END AS ruling FROM g"""
)
def j6_ruling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.count_if(F.col("quality") == 1).alias("s"), F.count_if(F.col("quality") == 0).alias("r")
    )
    return rows.select("source", monitor.ruling(F.col("s"), F.col("r")).alias("ruling"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY user_id")
def k10_last_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumnRenamed("event_type", "verdict")
    return monitor.last_verdicts(rows, ["user_id"], ["ts", "event_id"])


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def g8_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.change_counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", list("FOP"))
