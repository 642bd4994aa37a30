"""What the third review found: queries on odd rows, held against their SQL or plain Python, and the shapes of plans."""

import datetime
import glob
import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from factloom.functions import text as t
from factloom.functions import urls as u
from factloom.operators import delivery, retrieval
from factloom.plans import watches
from factloom.sources import extraction, versions


def held_against_sql(spark, tmp_path, name, tables):
    """A query and its SQL over tables of a few rows: (schema, rows) by name."""
    con, folder = duckdb.connect(), str(tmp_path)
    for table, (schema, given) in tables.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_titles_decode_three_references(spark, tmp_path):
    titles = ["of.&amp;&amp;&amp", "token = &quot;73&quot;", "a &lt;b&gt; &amp;lt; &#65; &AMP; & c", "plain"]
    pages = [(i, "https://www.a.org/x", f"<html><head><title>{title}</title></head></html>") for i, title in enumerate(titles)]
    held_against_sql(spark, tmp_path, "c6_page_names", {"pages": ("page_id long, url string, html string", pages)})


def test_hidden_turns_are_exact(spark, tmp_path):
    """Near copies of the first letters are told by a query of their own."""
    turns = [(1, 0, "user", "Thsh. The thing is here"), (1, 1, "user", "so thsh. the thing"), (1, 2, "user", "so thshx the thing"), (2, 0, "user", "other words altogether"), (2, 1, "user", "none of them")]
    held_against_sql(spark, tmp_path, "e8_hidden", {"conversations": ("conv_id long, turn int, role string, text string", turns)})
    near = __spark_entry__.queries()["e8_hidden_nearly"](spark, str(tmp_path))
    assert sorted(map(tuple, near.collect())) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prices_name_each_match_once(spark):
    """What a price needs of a match was written out wherever it was used, so each row searched hundreds of times."""
    amount, currency = t.parse_price(F.col("told"))
    told = spark.createDataFrame([("1.999,00 EUR",), ("$2 million",), ("5 %",), (None,), ("about 0.125 a day",)], "told string").select(amount.cast("double").alias("a"), currency.alias("c"))
    assert [tuple(r) for r in told.collect()] == [(1999.0, "EUR"), (2e6, "USD"), (None, None), (None, None), (0.125, None)]
    assert plan_of(told.select("a")).count("regexp_extract(") < 20


def test_pages_are_scanned_once(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x", "<title>x</title>")], "page_id long, url string, html string")
    assert plan_of(extraction.page_names(pages, "page_id").where("title IS NOT NULL")).count("scan(html") == 1


def test_addresses_are_read_once(spark):
    urls = ["http://10.1.2.3:80/", "http://8.8.8.8/", "http://a@[::ffff:127.0.0.1]/", "http://[fe80::1]/x", "http://256.1.1.1/", "http://a.org/"]
    rows = spark.createDataFrame([(url,) for url in urls], "url string").select(u.private_address(F.col("url")).alias("a"))
    assert [r.a for r in rows.collect()] == ["10.1.2.3", None, "127.0.0.1", "fe80::1", None, None]
    assert plan_of(rows).count("split(") == 1


def test_hosts_in_two_matches(spark):
    """Equal to one replacement after another, at a third of the matches."""
    def plain(host):
        host = re.sub(r":\d*$", "", re.sub("^.*@", "", host)).lower()
        return re.sub(r"^www\.", "", re.sub(r"\.+$", "", host))

    r = random.Random(7)
    hosts = ["".join(r.choice(["www.", "WWW.", "a", "b.", ".", ":", ":80", "@", "co", ".uk"]) for _ in range(r.randint(0, 7))) for _ in range(3000)]
    rows = spark.createDataFrame([(h, f"http://{h}/x") for h in hosts], "host string, url string").select("host", u.hostname(F.col("url")).alias("got"))
    assert [(r.host, r.got) for r in rows.collect() if r.got != plain(r.host)] == []
    assert plan_of(rows).count("regexp_replace(") == 1
    domains = rows.select(u.registrable_domain(F.col("got")).alias("d"))
    assert plan_of(domains).count("split(") == 1


def test_memory_is_never_broadcast(spark):
    """Findings and memory grow alike, so no join of theirs may pass a side through the driver, however small it looks."""
    at = "timestamp'2026-01-01'"
    findings = spark.range(4).selectExpr("'a.org/' || id % 2 AS url", "'a quote of some words' || id AS quote", "'c' AS claim", "'g' AS goal", "1L AS run_id", "id AS pos", f"{at} AS seen", "true AS trusted")
    memory = findings.limit(0).select("url", "quote", "claim", "goal", "run_id", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(False).alias("hidden"))
    out = delivery.learn(memory, findings, findings.limit(1).select("url", "quote"))
    assert [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Broadcast" in x] == []
    assert sorted((r.url, r.hidden) for r in out.collect()) == [("a.org/0", True), ("a.org/1", False)]


def test_watches_go_in_slices(spark, tmp_path, monkeypatch):
    """Watches together kept and shuffled all their facts at once; what a slice of them keeps is gone behind it, and no row with it."""
    monkeypatch.setattr(watches, "SLICE", 60)
    kept = set(glob.glob(f"{versions.shared(spark).removeprefix('file:')}/*"))
    r = random.Random(5)
    day = lambda: datetime.datetime(r.randint(1995, 2000), r.randint(1, 12), r.randint(1, 28))
    lines = [(n, r.randint(1, 12), r.randint(1, 9), 1, float(r.randint(1, 3)), float(r.randint(400, 1800)), day()) for n in range(200)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    for name in ("k2_diff", "k13_watch_runs"):
        held_against_sql(spark, tmp_path / name, name, {"lineitem": (schema, lines)})
    new = [x for x in glob.glob(f"{versions.shared(spark).removeprefix('file:')}/*") if x not in kept]
    assert sorted(len(glob.glob(f"{x}/out/slice=*")) for x in new) == [4, 4]


def test_near_quotes_shuffle_nothing(spark):
    """Pieces of four letters met nearly every document, in a join and a shuffle of them all; now places are counted in one pass."""
    quotes = spark.createDataFrame([(1, "the quick brown fox jumps over 77 lazy dogs"), (2, "nowhere to be found in these documents")], "quote_id long, quote string")
    docs = spark.createDataFrame([(1, "He said: the quick brown fox jumpd over 77 lazy dogs, twice."), (2, "the quick brown fox jumps over 78 lazy dogs"), (3, None)], "doc_id long, text string")
    out = retrieval.near_quotes(quotes, docs)
    assert [(r.quote_id, r.doc_id, "jumpd" in r.span) for r in out.collect()] == [(1, 1, True)]
    assert not re.search("Join|Repartition|Aggregate", plan_of(out))


def test_words_are_counted_within_rows(spark):
    """A task kept the counts of all documents of its split, and their scores for all queries, before the shuffle."""
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["c", "a"])], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(9, ["a", "b", "zz"])], "query_id long, tokens array<string>")
    asked = queries.select("query_id", F.explode("tokens").alias("term"))
    counts = retrieval.term_counts(docs, [], asked)
    assert sorted((r.doc_id, r.length, r.term, r.tf) for r in counts.collect() if r.term != retrieval.LENGTH) == [(1, 3, "a", 1), (1, 3, "b", 2), (3, 2, "a", 1)]
    assert not re.search(r"Aggregate \[doc_id", plan_of(counts))
    assert re.search(r"Aggregate \[query_id.*\n.*Project.*\n.*Join.*\n(.*\n)*?.*RepartitionByExpression \[doc_id", plan_of(retrieval.bm25_scores(queries, docs)))
