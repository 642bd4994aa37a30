"""Golden rows of scalar functions and operators."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.functions import urls as u
from factloom.operators import values
from factloom.streaming import streams


def one(spark, f, *inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold_and_clean(spark):
    assert one(spark, t.fold, "Straße “A” – B", None, "", "ﬁne  X") == ['strasse "a" - b', None, "", "fine x"]
    assert one(spark, t.clean, " a  b \r\n\r\n\r\n\r\nc​ ") == ["a b\n\nc"]


def test_numbers(spark):
    got = one(spark, t.numbers, "paid $1,999.00 or 12 or 1.5 million", "$84.7K and 2m tall 10m", None)
    assert got[0] == ["1999", "12", "1500000"]
    assert "84700" in got[1] and "10" in got[1] and "10000000" not in got[1]
    assert got[2] is None


def test_prices(spark):
    told = {
        "$1,999.99": ("1999.99", "USD"), "Rs. 1,66,269.38": ("166269.38", "INR"), "₹38,641": ("38641", "INR"), "22,90 €": ("22.90", "EUR"), "1999 USD": ("1999", "USD"),
        "about 2000": ("2000", None), "$83K": ("83000", "USD"), "$84.7k": ("84700", "USD"), "$1.2M": ("1200000", "USD"), "$1,999 MSRP": ("1999", "USD"),
        "$15 per 1M tokens": ("15", "USD"), "$599 for the 4K model": ("599", "USD"), "$1,999 (2 m cable)": ("1999", "USD"), "$0.053 per hour": ("0.053", "USD"),
        "rtx 5090 $1,999": ("1999", "USD"), "3 for $20": ("20", "USD"), "1.299,00": ("1299", None), "22,90 EUR": ("22.90", "EUR"), "1 299,00 €": ("1299", "EUR"),
        "5% off, now 80": ("80", None), "US$ 7": ("7", "USD"), "84.7K USD": ("84700", "USD"), "USD 5": ("5", "USD"), "none": (None, None), "": (None, None),
    }
    amounts, currencies = (one(spark, lambda x, i=i: t.parse_price(x)[i], *told, None) for i in (0, 1))
    assert [None if a is None else Decimal(a) for a, _ in told.values()] == amounts[:-1] and amounts[-1] is None
    assert [c for _, c in told.values()] == currencies[:-1] and currencies[-1] is None


def test_units_and_intervals(spark):
    assert one(spark, t.rate_unit, "$0.53/hr", "$0.35/GPU-hr", "$120 a year", "hours", "$5") == ["hour", "hour", "year", "hour", None]
    assert one(spark, t.interval_seconds, "30m", "6h", "1w", "5m", "x") == [1800, 21600, 604800, None, None]


def test_urls(spark):
    hosts = ["https://www.News.BBC.co.uk:80/a", "http://docs.python.org", "x", None]
    assert one(spark, u.hostname, *hosts) == ["news.bbc.co.uk", "docs.python.org", "", None]
    assert one(spark, lambda x: u.registrable_domain(u.hostname(x)), *hosts[:2]) == ["bbc.co.uk", "python.org"]
    assert one(spark, u.canonical_url, "HTTPS://A.com/b/?utm_source=x&q=1#top", "http://a.com") == ["https://a.com/b?q=1", "http://a.com/"]
    assert one(spark, u.is_ad_link, "https://www.bing.com/aclick?ld=1", "https://bing.com/x") == [True, False]
    assert one(spark, u.url_date, "https://a.b/2024/05/x", "https://a.b/2024/05/09/x", "https://a.b/x") == [
        datetime.date(2024, 5, 1), datetime.date(2024, 5, 9), None
    ]


def test_outliers_match_brute_force(spark):
    import random
    import statistics

    r = random.Random(3)
    data = [(g, i, r.randint(1, 400)) for g in range(6) for i in range(g + 1)] + [(9, i, r.randint(50, 150)) for i in range(40)]
    got = values.flag_outliers(spark.createDataFrame(data, "g int, i int, a long"), ["g"], "a", ["i"]).collect()
    for row in got:
        others = [a for g, i, a in data if g == row["g"] and i != row["i"]]
        want = len(others) >= 2 and not 0.5 * statistics.median(others) <= row["a"] <= 2.5 * statistics.median(others)
        assert row["outlier"] == want


def test_stream_of_new_versions(spark, tmp_path):
    pages = [("u1", "ok", "h1", datetime.datetime(2024, 1, 1)), ("u2", "ok", "h1", datetime.datetime(2024, 1, 2)), ("u3", "blocked", "h2", datetime.datetime(2024, 1, 2))]
    shape = "url string, status string, content_hash string, fetched_at timestamp"
    spark.createDataFrame(pages, shape).coalesce(1).write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "pages"))
    streams.write_new_versions(stream, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert [r["content_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["h1"]


def test_canonical_query(spark):
    told = {
        "http://A.com/x/?q=a%20b&utm_source=1#f": "http://a.com/x?q=a+b", "http://a.com/x?q=a+b": "http://a.com/x?q=a+b", "https://a.com?a&b=&c=1=2&gclid=9": "https://a.com/?a=&b=&c=1%3D2",
        "https://a.com/?q=%zz&t=~*": "https://a.com/?q=%25zz&t=~%2A", "https://a.com/?q=caf%C3%A9": "https://a.com/?q=caf%C3%A9", "https://a.com/?UTM%5Fx=1": "https://a.com/",
    }
    assert one(spark, u.canonical_url, *told) == list(told.values())


def test_replies_of_wrong_types(spark):
    told = ['{"n": 5, "t": "x", "l": [1]}', 'so {"n": "five", "t": "x"}', '{"n": null, "l": "no"}', '{"n": 1, "z": 2}', '{"t": "x"}', "none"]
    got = one(spark, lambda c: t.parse_reply(c, F.lit(None).cast("string"), "n int, t string, l array<int>", ["n"]), *told)
    assert [r["reason"] for r in got] == [None, "wrong type: n", "wrong type: l", "unknown: z", "missing: n", "no JSON object"]
    assert got[0]["value"].asDict() == {"n": 5, "t": "x", "l": [1]} and got[1]["value"] is None
