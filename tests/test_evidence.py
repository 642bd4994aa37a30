"""Golden rows and plain-Python versions of what SQL cannot tell: near quotes, entities, chunks, packing, diffs, fact checks, streams."""

import datetime
import random
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from factloom.functions import align, stem
from factloom.functions import text as t
from factloom.functions import urls as u
from factloom.operators import delivery, evaluation, evidence, factcheck, ledger, retrieval, sites
from factloom.sources import extraction, pages
from factloom.streaming import streams


def one(spark, f, *inputs):
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_words_and_numbers(spark):
    assert one(spark, lambda c: t.numbers(c, 1), "seven of 7 rings, 1,999.00 and $5m") == [["7", "1999", "5000000"]]
    assert one(spark, t.numbers_as_written, "1,999.00 and 1999 or 12") == [{"1999": "1,999.00", "12": "12"}]
    assert one(spark, t.negations, "not only this, I don't and never. no. 5 no longer no less than no", None) == [3, None]
    kinds = one(spark, t.parse_rule, "below $1,999.50", "Price under 20 eur", "drops by 5 %", "mentions 'Foo bar'", "Back in stock", "price", "drop 5", None)
    assert [k["kind"] for k in kinds] == ["below", "below", "drop", "mentions", "in_stock", None, None, None]
    assert kinds[0]["amount"] == Decimal("1999.5") and kinds[0]["currency"] == "USD" and kinds[1]["currency"] == "EUR" and kinds[3]["phrase"] == "Foo bar"
    assert one(spark, lambda c: t.sparkline(F.transform(F.split(c, ","), lambda x: x.cast("double"))), "1,2,3,8", "5,5", "0,7") == ["▁▂▃█", "▄▄", "▁█"]
    assert one(spark, u.private_address, "http://10.1.2.3/x", "http://8.8.8.8", "http://[::1]:80/", "http://[::ffff:192.168.1.1]/", "http://a.com") == [
        "10.1.2.3", None, "::1", "192.168.1.1", None
    ]


def test_sentences_and_chunks(spark):
    text = "Dr. No said this is it. Then U.S. law came in [2] here! - a b\nAnother line with four words"
    assert "".join(one(spark, t.sentence_pieces, text)[0]) == text
    assert [s["claim"] for s in one(spark, lambda c: t.sentences(c, 5), text)[0]] == [
        "Dr. No said this is it.", "Then U.S. law came in here!", "Another line with four words"
    ]

    def plain(text, target):
        def merged(parts, joiner):
            out, now = [], ""
            for part, cut in parts:
                if cut:
                    out += [now] * bool(now) + [part]
                    now = ""
                elif now and len(now) + len(joiner) + len(part) > target:
                    out.append(now)
                    now = part
                else:
                    now = now + joiner + part if now else part
            return out + [now] * bool(now)

        import re

        pieces = []
        for p in filter(None, (p.strip() for p in text.split("\n\n"))):
            if len(p) <= target:
                pieces.append(p)
                continue
            parts = [(s[i : i + target], len(s) > target) for s in re.split(r"(?<=[.!?])\s+", p) for i in range(0, max(1, len(s)), target)]
            pieces += merged(parts, " ")
        return merged([(p, False) for p in pieces], "\n\n")

    r = random.Random(4)
    texts = ["".join(r.choice(["ab", "c. ", "d! ", " ", "\n\n", "efgh"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    assert one(spark, lambda c: t.split_chunks(c, 20), *texts) == [plain(x, 20) for x in texts]


def test_near_quotes(spark):
    sources = spark.createDataFrame(
        [(1, 1, "Shop", "Today the RTX 5090 now sells for $1,999.00 at the shop, they say.", None, None, False),
         (1, 2, "Docs", "It was released on October 7, 2024 worldwide.", None, None, True)],
        "run_id int, source_no int, title string, text string, published date, updated date, snippet_only boolean",
    )
    findings = spark.createDataFrame(
        [(1, 0, "It costs 1999", "the RTX 5090 now sells for $1,999.00 at the shop", None, 1, None),
         (1, 1, "x 2024", "released on October 7, 2024 worldwide", "2025", 2, None), (1, 2, "y", "short", None, 1, None),
         (1, 3, "z", "the RTX 5090 now sell for $1,999.00 at teh shop", None, 2, "hm"),
         (1, 4, "z", "the RTX 5090 now sells for $1,849.00 at the shop", None, 1, None)],
        "run_id int, pos int, claim string, quote string, value string, source_no int, doubt string",
    )
    assert rows(evidence.verify(findings, sources), "pos") == [
        (1, 0, 1, "verified", None, None), (1, 1, 2, "unverified", None, "the quote does not contain 2025"),
        (1, 2, 1, "unverified", None, "quote too short to check"), (1, 3, 1, "verified", "doubted", "quote is from source 1; doubtful: hm"),
        (1, 4, 1, "unverified", None, "quote not found in the source"),
    ]
    pairs = spark.createDataFrame([("the quick brown fox jumps over it", "quick brown fox jumps"), ("the quick brown fox jumps", "a slow red hen sleeps")], "a string, b string")
    assert [r[0] for r in pairs.select(evidence.same_quote(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert align.common(a, b) == best[-1][-1]


PAGE = """<html><head><title> Shop </title><meta property="article:published_time" content="2024-05-06T00:00"><meta property="og:site_name" content="Site">
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"RTX 5090","offers":{"@type":"AggregateOffer","lowPrice":"1999.00","priceCurrency":"usd",
"priceSpecification":{"unitCode":"HUR"},"offers":[{"@type":"Offer","price":2099,"priceCurrency":"USD","availability":"https://schema.org/InStock"}]}},
{"@type":"NewsArticle","datePublished":"2024-01-02","dateModified":"2024-01-03"}]}</script><script type="application/ld+json">[{bad</script>
<script type='application/ld+json'>[{"@type":"Offer","price":"5.50","itemOffered":{"name":"Y"}}]</script></head></html>"""


def test_entities(spark):
    pages = spark.createDataFrame([("https://www.s.com/2020/03/04/a", PAGE), ("https://b.org/2020/03/04/a", "<p>x"), ("https://c.org/x", "<p><time datetime='2023-01-01'>x")], "url string, html string")
    found = extraction.offers(pages).select("product", F.col("price").cast("int"), "currency", "availability", "unit")
    assert sorted(rows(found), key=str) == [("RTX 5090", 1999, "USD", None, "hour"), ("RTX 5090", 2099, "USD", "InStock", "hour"), ("Y", 5, None, None, None)]
    day = datetime.date
    assert rows(extraction.page_dates(pages), "url") == [
        ("https://b.org/2020/03/04/a", day(2020, 3, 4), None), ("https://c.org/x", None, None),
        ("https://www.s.com/2020/03/04/a", day(2024, 1, 2), day(2024, 1, 3)),
    ]
    assert rows(extraction.page_names(pages), "url")[2] == ("https://www.s.com/2020/03/04/a", "Shop", "Site", None)
    assert one(spark, extraction.joined_lines, "- Created:\n- 08-Jul-2024\nThis is a long line of prose that was wrapped at fifty chars\nand goes on here\nA\nA", "") == [
        "- Created: 08-Jul-2024\nThis is a long line of prose that was wrapped at fifty chars and goes on here\nA\nA", ""
    ]


def page_of(*blocks, body=""):
    return "<html><head>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + f"</head><body>{body}</body></html>"


def test_offers_anywhere_in_json(spark):
    """Products in lists, graphs and other entities; offers in offers at any depth, each once; prices as text or numbers."""
    nested = '{"@type":"Offer","price":7}'
    for k in range(6, 0, -1):
        nested = f'{{"@type":"AggregateOffer","lowPrice":"{k}","offers":[{nested}]}}'
    blocks = {
        "list": '{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":"Product","name":" A ","offers":{"@type":"Offer","price":"1.299,00 \\u20ac","priceCurrency":"eur"}}}]}',
        "main": '{"@type":"WebPage","mainEntity":{"@type":["Thing","http://schema.org/Product"],"name":"B","offers":[{"price":22.90,"priceCurrency":"US"},{"price":0},{"price":true},"x"]}}',
        "deep": f'{{"@type":"Product","name":"C","offers":{nested}}}',
        "graph": '{"@graph":[[{"@graph":[{"@type":"Offer","price":-1,"priceSpecification":[{"price":"5 USD","unitText":"per month","priceCurrency":"USD"}],"itemOffered":{"name":"D"}}]}]]}',
        "context": '{"@context":{"x":{"@type":"Offer","price":3}},"@type":"Thing"}',
        "bad": "{nope",
    }
    pages = spark.createDataFrame([(k, page_of(b)) for k, b in blocks.items()] + [("none", None), ("empty", "")], "url string, html string")
    got = [(r.url, r["product"], str(r.price.normalize()), r.currency, r.unit) for r in extraction.offers(pages).orderBy("url", "at").collect()]
    assert got == [
        *[("deep", "C", str(k), None, None) for k in range(1, 8)], ("graph", "D", "5", "USD", "month"), ("list", "A", "1299", "EUR", None), ("main", "B", "22.9", None, None),
    ]
    assert sorted(r.url for r in extraction.entities(pages).collect()) == ["context", "deep", "graph", "list", "main"]


def test_dates_and_names_by_scope(spark):
    body = '<div class="comment"><time datetime="2021-05-05">x</time></div><article><p><time datetime="2022-06-06">y</time></p></article><time pubdate datetime="2020-01-01">'
    pages = spark.createDataFrame([
        ("https://a.org/1", page_of(body=body)), ("https://a.org/2", page_of(body=body.split("<article>")[0])), ("https://a.org/2024/05/x", page_of(body=body.split("<article>")[0])),
        ("https://a.org/3", "<meta content='2019-02-03' name=DATE><meta content=' By me ' name=author><meta content='Own' property=og:title><title>T &amp; t</title>"),
        ("https://a.org/4", page_of('[{"@type":"Article"},{"@type":"BlogPosting","dateModified":"2018-01-01T00:00"}]', body=body) + "<title>T &amp; t</title>"), ("https://a.org/5", None),
    ], "url string, html string")
    day = datetime.date
    assert rows(extraction.page_dates(pages), "url") == [
        ("https://a.org/1", day(2022, 6, 6), None), ("https://a.org/2", None, None), ("https://a.org/2024/05/x", day(2024, 5, 1), None), ("https://a.org/3", day(2019, 2, 3), None),
        ("https://a.org/4", day(2022, 6, 6), day(2018, 1, 1)), ("https://a.org/5", None, None),
    ]
    names = {r.url[-1]: (r.title, r.site, r.author) for r in extraction.page_names(pages).collect()}
    assert names["3"] == ("Own", "a.org", "By me") and names["4"] == ("T & t", "a.org", None) and names["5"] == (None, "a.org", None)


FACT = "watch string, key string, claim string, quote string, url string, entity string, value string, amount decimal(38,10), currency string, unit string, structured boolean, availability string"
SEEN = "watch string, url string, text string, offers array<struct<product:string,price:decimal(38,10)>>, title string"


def fact(key, quote, entity=None, amount=None, claim="c"):
    return ("w", key, claim, quote, "http://s.com/1", entity, str(amount) if amount else None, Decimal(amount) if amount else None, "USD" if amount else None, None, False, None)


def test_diff(spark):
    old = [fact("value|a|price|s.com", "a costs 1999 dollars today", "A", 1999), fact("text|s.com|1", "firm opened 12 new shops", claim="The big firm opened twelve new shops"),
           fact("value|g|price|s.com", "g costs 77 dollars there", "G", 77), fact("value|k|price|s.com", "k costs 3 dollars here", "K", 3)]
    new = [fact("value|a|price|s.com", "a costs 1849 dollars today", "A", 1849), fact("text|s.com|2", "firm opened 12 new shops", claim="The big firm opened twelve new shops now"),
           fact("value|b|price|s.com", "b costs 5 dollars since long", "B", 5), fact("value|n|price|s.com", "n costs 6 dollars as of now", "N", 6)]
    now = [("w", "http://s.com/1", "Today a costs 1849 dollars today. b costs 5 dollars since long. k costs 3 dollars here", [], "t")]
    before = [("w", "http://s.com/1", "a costs 1999 dollars today b costs 5 dollars since long", [], "t")]
    frame = spark.createDataFrame
    got = ledger.diff(frame(old, FACT), frame(new, FACT), frame(now, SEEN), frame(before, SEEN)).select("key", "change", "previous.value")
    assert sorted(rows(got)) == [
        ("text|s.com|1", "same", None), ("value|a|price|s.com", "changed", "1999"), ("value|b|price|s.com", "noticed", None),
        ("value|g|price|s.com", "gone", "77"), ("value|k|price|s.com", "same", "3"), ("value|n|price|s.com", "new", None),
    ]


def test_alerts_fire_once(spark):
    log = [(1, True), (2, True), (3, False), (4, True)]
    checked = spark.createDataFrame([("w", "r", "k", "below", n, holds) for n, holds in log] + [("w", "e", "k", "new", 1, True)], "watch string, rule string, key string, kind string, run_id int, holds boolean")
    assert sorted((r["rule"], r["run_id"]) for r in ledger.raised(checked, ["run_id"]).collect()) == [("e", 1), ("r", 1), ("r", 4)]
    deltas = spark.createDataFrame([("w", "k", "gone", 1, None, None), ("w", "l", "new", 2, None, None), ("w", "m", "new", None, None, None)], "watch string, key string, change string, amount int, currency string, unit string")
    assert [r["key"] for r in ledger.observations(deltas).collect()] == ["l"]


def test_fact_checks(spark):
    texts = spark.createDataFrame([(1, "Vaccines do not cause it. In 2024 the firm sold 12 units (see 10:30). It is version 3.5.1.")], "check int, text string")
    claims = [(1, 1, "The firm sold 12 units in 2024", "In 2024 the firm sold 12 units"), (1, 2, "The firm sold 13 units", "the firm sold 12 units"),
              (1, 3, "Vaccines cause it", "do not cause it"), (1, 4, "x", "nowhere in here"), (1, 5, "THE FIRM sold 12 units in 2024", "In 2024 the firm sold 12 units"), (1, 6, "y", "short")]
    claims = spark.createDataFrame(claims, "check int, pos int, claim string, excerpt string")
    got = factcheck.anchor_claims(claims, texts, 1).select("pos", "reason", "kept")
    assert rows(got, "pos") == [
        (1, None, True), (2, "its passage does not say 13", False), (3, None, False), (4, "its passage is not in the text", False), (6, "its passage is too short to place", False)
    ]
    assert [r["pos"] for r in factcheck.caveats(claims, texts).where("caveat").collect()] == [3]
    marks = spark.createDataFrame([(1, 1, "In 2024 the firm sold 12 units (see 10:30).", False), (1, 2, "sold 12", False)], "check int, number int, excerpt string, caveat boolean")
    got = [(r["piece"], r["claims"]) for r in factcheck.annotate(texts, marks).orderBy("nth").collect()]
    assert [c for _, c in got] == [[], [1], []] and "".join(p for p, _ in got) == texts.first()["text"]
    left = spark.createDataFrame([(1, "sold 12 units", "In 2024-05 the firm sold 12 units at 10:30 [3]")], "check int, claim string, excerpt string")
    assert factcheck.unchecked_numbers(left).first()["unchecked"] == ["2024", "05"]
    sources = spark.createDataFrame([(1, 2, "Docs", "It was released on October 7, 2024 worldwide.", None, None, False)], "check int, source_no int, title string, text string, published date, updated date, snippet_only boolean")
    judged = spark.createDataFrame([(1, 1, n, s, "It was released on October 7, 2024 worldwide", 2, says) for n, s, says in [(1, "supports", "released 2024"), (2, "refutes", "no"), (3, "supports", "released 2023")]],
                                   "check int, claim_no int, nth int, stance string, quote string, source_no int, says string")
    got = factcheck.weigh(spark.createDataFrame([(1, 1, "It was released in 2024")], "check int, claim_no int, claim string"), judged, sources)
    assert rows(got.select("nth", "verdict", "note"), "nth") == [
        (1, "verified", None), (2, "unverified", "it states every number of the claim, so it does not refute it"), (3, "unverified", "the quote does not contain 2023")
    ]


def test_merge_and_pack(spark):
    hits = [(1, 1, 1, "http://a.com/x", "T"), (1, 2, 1, "http://a.com/x/", "U"), (1, 1, 2, "http://a.com/y", "t"), (1, 2, 2, "http://b.com", "B"), (1, 1, 3, "https://www.bing.com/aclick?x", "z")]
    got = retrieval.merge_hits(spark.createDataFrame(hits, "goal int, list_no int, rank int, url string, title string"), 5)
    assert rows(got, "place") == [(1, 1, "http://a.com/x", 1, 1), (1, 2, "http://b.com", 2, 2)]
    texts = spark.createDataFrame([(1, 1, "alpha beta. " * 10), (1, 2, "gamma delta words. " * 5)], "goal int, source int, text string")
    asked = spark.createDataFrame([(1, ["gamma", "beta"])], "goal int, tokens array<string>")
    assert [(r["source"], r["position"]) for r in retrieval.pack(texts, asked, 100, 60, 50).orderBy("source").collect()] == [(1, 0), (2, 0)]


def test_scores_and_feeds(spark):
    cases = spark.createDataFrame([("c", ["A b", "z"], ["bad"])], "case string, facts array<string>, untrusted array<string>")
    found = spark.createDataFrame([("c", "xx a  B yy", True), ("c", "bad", True), ("c", "z", False)], "case string, text string, trusted boolean")
    scores = evaluation.eval_score(cases, found)
    assert rows(scores) == [("c", 2, ["A b"], ["z"], ["bad"])]
    before = spark.createDataFrame([("c", ["A b", "z"], [])], "case string, found array<string>, violations array<string>")
    assert rows(evaluation.regressions(before, scores)) == [("c", ["z"], ["bad"])]
    assert one(spark, evaluation.name_id, "watch:x", "ü") == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in ("watch:x", "ü")]
    alerts = spark.createDataFrame([("w", n, datetime.datetime(2024, 1, n), "r<1>", "https://a?b&c", None) for n in range(1, 5)], "watch string, alert_id int, created_at timestamp, reason string, url string, quote string")
    feed = evaluation.alert_feeds(alerts, spark.createDataFrame([("w", "g"), ("v", "h")], "watch string, goal string"), 3).where("watch = 'w'").first()["feed"]
    assert feed.count("<entry>") == 3 and "r&lt;1&gt;" in feed and "2024-01-04T" in feed and "2024-01-01T" not in feed
    import xml.etree.ElementTree as ET

    ET.fromstring(feed)


def test_keyed_streams_equal_batches(spark, tmp_path):
    r = random.Random(6)
    log = [(r.choice("abc"), r.choice(["ok", "timeout", "blocked", "not_found"]), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), h) for h in range(40)]
    schema = "site string, status string, at timestamp, seq int"
    for part in (log[:15], log[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = streams.site_health_stream(source).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination()
    last = {}
    for row in spark.table("health").collect():
        last[row["site"]] = max(last.get(row["site"], (0,) * 4), (row["reads"] + row["failures"], row["reads"], row["failures"], row["streak"]))
    want = {w["site"]: (w["reads"] + w["failures"], w["reads"], w["failures"], w["streak"]) for w in sites.site_health(spark.createDataFrame(log, schema)).collect()}
    assert last == want

    facts = [("w", r.choice("xy"), n, float(r.randint(1, 3)), r.random() < 0.5) for n in range(30)]
    schema = "watch string, key string, run_id long, amount double, holds boolean"
    for part in (facts[:11], facts[11:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "facts"))
    streams.condition_stream(source).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    state, want = {}, []
    for watch, key, n, amount, holds in facts:
        before, held = state.get(key, (None, False))
        want.append((watch, key, n, "new" if before is None else "changed" if before != amount else "same", amount, before, holds and not held))
        state[key] = (amount, holds)
    assert sorted(map(tuple, spark.table("alerts").collect()), key=lambda x: x[2]) == want


def test_merge_hits_equals_a_plain_walk(spark):
    r = random.Random(7)
    hits = [(g, k, n, f"http://{r.choice('ab')}.com/{r.choice('uvwxyz')}{r.choice(['', '/', '?utm_source=q', '#top'])}", r.choice(["T", "t ", "U", "V", "W x"])) for g in range(4) for k in range(3) for n in range(1, 13)]
    want = set()
    for g in range(4):
        seen, kept = set(), []
        for _, k, n, url, title in sorted((h for h in hits if h[0] == g), key=lambda h: (h[2], h[1])):
            host, path = url[7:12], url[12:].split("?")[0].split("#")[0].rstrip("/")
            keys = {f"http://{host}{path or '/'}", f"{host}|{title.strip().lower()}"}
            if not keys & seen and len(kept) < 6:
                seen |= keys
                kept.append((g, len(kept) + 1, url, k, n))
        want |= set(kept)
    got = retrieval.merge_hits(spark.createDataFrame(hits, "goal int, list_no int, rank int, url string, title string"), 6)
    assert set(rows(got)) == want


def test_pack_equals_a_plain_walk(spark):
    import math

    r = random.Random(8)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    texts = [(g, s, ". ".join(" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 9)))) for g in range(3) for s in range(4)]
    asked = {g: r.sample(words, 3) for g in range(3)}
    chunks = {(g, s): one(spark, lambda c: t.split_chunks(c, 40), text)[0] for g, s, text in texts}
    want = set()
    for g in range(3):
        mine = [(s, p, c, [w.strip(".") for w in c.split()]) for (h, s), parts in chunks.items() if h == g for p, c in enumerate(parts)]
        average = sum(len(w) for *_, w in mine) / len(mine)

        def score(s, p, w, mine=mine, average=average, g=g):
            total = 0.0
            for term in asked[g]:
                n, tf = sum(term in x for *_, x in mine), w.count(term)
                total += math.log(1 + (len(mine) - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average)) if tf else 0
            return round(total, 6) + (0.5 if p == 0 else 0.0)

        scored = sorted(((-score(s, p, w), s, p, len(c)) for s, p, c, w in mine))
        first = {}
        for x in scored:
            first.setdefault(x[1], x)
        leads = sorted(first.values())
        used, by, taken = 0, {}, set()
        for _, s, p, n in [*leads, *(x for x in scored if x not in leads)]:
            if used + n <= 200 and by.get(s, 0) + n <= 90:
                used, by[s] = used + n, by.get(s, 0) + n
                taken.add((g, s, p))
        want |= taken
    frame = spark.createDataFrame(texts, "goal int, source int, text string")
    got = retrieval.pack(frame, spark.createDataFrame(list(asked.items()), "goal int, tokens array<string>"), 200, 90, 40)
    assert {(x["goal"], x["source"], x["position"]) for x in got.collect()} == want


def test_writers(spark, tmp_path):
    from factloom.sources import pages

    ratings = spark.createDataFrame([(2, 1, "good", 1), (1, 1, "bad", 0)], "run_id int, number int, verdict string, rated_at int")
    pages.write_ratings(ratings.coalesce(1), str(tmp_path / "ratings"))
    lines = [x for f in sorted((tmp_path / "ratings").glob("part*")) for x in f.read_text().splitlines()]
    assert [x.split('"verdict":"')[1].split('"')[0] for x in lines] == ["bad", "good"]
    points = spark.createDataFrame([("=1+1", 5, "USD"), ("plain", 6, None)], "label string, amount int, currency string")
    pages.write_observations(points.coalesce(1), str(tmp_path / "points"))
    got = spark.read.csv(str(tmp_path / "points"), header=True).collect()
    assert sorted(r["label"] for r in got) == ["'=1+1", "plain"]


def test_reworded_equals_the_plain_walk(spark):
    """Statements of one site choose in order, at any number of them, ties included."""
    r = random.Random(11)
    words = "the big firm opened twelve new shops in town today again".split()
    said = lambda n: [" ".join(r.sample(words, r.randint(6, len(words)))) + r.choice(["", " 77"]) for _ in range(n)]
    new, old = said(40), said(40)
    old[5] = old[9] = new[3]  # ties
    met = {3: 2, 7: 30}  # statements that a fact of the run is itself, by the place of that fact
    facts = [("w", k, f"n{k:02}", "s.com", x) for k, x in enumerate(new)]
    known = [("w", f"o{k:02}", "s.com", x, met.get(k)) for k, x in enumerate(old)]
    got = ledger.reworded(
        spark.createDataFrame(facts + [("v", 0, "n00", "s.com", new[0])], "watch string, pos int, key string, site string, wording string"),
        spark.createDataFrame(known + [("v", "o00", "t.com", new[0], None)], "watch string, key string, site string, wording string, met_at int"),
    )
    used, want = set(), []
    for k, x in enumerate(new):
        best = None
        for j, y in enumerate(old):
            if j in used or met.get(j, 99) <= k or ("77" in x) != ("77" in y):
                continue
            score = align.words_alike(x, y)
            if score >= ledger.REWORDED and (best is None or score > best[0]):
                best = (score, j)
        if best:
            used.add(best[1])
            want.append(("w", f"n{k:02}", f"o{best[1]:02}"))
    assert len(want) > 25 and sorted(tuple(x)[:3] for x in got.collect()) == sorted(want)
    twins = spark.createDataFrame([("w", k, f"n{k:02}", "s.com", "all the same words") for k in range(40)], "watch string, pos int, key string, site string, wording string")
    others = spark.createDataFrame([("w", f"o{k:02}", "s.com", "all the same words", None) for k in range(40)], "watch string, key string, site string, wording string, met_at int")
    assert sorted((x.key[1:], x.old_key[1:]) for x in ledger.reworded(twins, others).collect()) == [(f"{k:02}", f"{k:02}") for k in range(40)]


def test_diff_of_published_offers(spark):
    """Offers are followed by folded names, or their page's title; their price lines are evidence too."""
    offer = lambda product, price: (product, Decimal(price), "USD", None, "InStock")
    of = "watch string, url string, text string, offers array<struct<product:string,price:decimal(38,10),currency:string,unit:string,availability:string>>, title string"
    structured = lambda key, entity, price: ("w", key, "c", "schema.org offer", "http://s.com/1", entity, price, Decimal(price), "USD", None, True, "InStock")
    frame = spark.createDataFrame
    quoted = ("w", "text|s.com|9", "it is priced", "- straße  x: 5 USD, InStock", "http://s.com/1", None, None, None, None, None, False, None)
    old = frame([structured("a", "STRASSE X", "5"), structured("b", "Shop", "7"), structured("c", "gone", "9"), structured("d", "Repriced", "3"), quoted], FACT)
    now = frame([("w", "http://s.com/1", "Deals.", [offer("Straße  x", "5"), offer(None, "7"), offer("ﬁne", "2"), offer("repriced", "4")], "SHOP")], of)
    new = frame([structured("e", "Fine", "2")], FACT)
    got = ledger.diff(old, new, now, now).select("key", "change")
    assert sorted(rows(got)) == [("a", "same"), ("b", "same"), ("c", "gone"), ("e", "noticed"), ("text|s.com|9", "same")]


def test_near_windows_equal_all_windows():
    """best_window() against the alignment of every stretch."""
    r, hits = random.Random(1), 0

    def plain(short, long, least=0.9):
        n, m, best, where = len(short), len(long), least, None
        for a, b in [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(m - n + 1)] + [(i, m) for i in range(m - n + 1, m)]:
            share = 2 * align.common(short, long[a:b]) / (n + b - a)
            if share > best or share == best and where is None:
                best, where = share, (a, b)
        return None if where is None else (*where, best)

    for _ in range(800):
        letters = "abcde "[: r.randint(2, 6)]
        some = lambda n: "".join(r.choice(letters) for _ in range(n))
        quote = some(r.randint(3, 40))
        x = list(quote)
        for _ in range(r.randint(0, len(quote) // 8 + 1)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = some(r.randint(0, 1))
        text = some(r.randint(0, 30)) + "".join(x) + some(r.randint(0, 30))
        if len(text) >= len(quote):
            assert align.best_window(quote, text) == plain(quote, text)
            hits += plain(quote, text) is not None
    assert hits > 300


def test_near_quotes_over_a_corpus_find_all(spark):
    """Every pair that alignment of all places finds passes the count of pieces."""
    r = random.Random(2)
    words = [a + b for a in "ka lo mi ne pu ra so ti".split() for b in "ben dor fal gim".split()]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 120))) for _ in range(60)] + ["", "Total 1,999 USD for all of it here", None]
    quotes = []
    for k in range(80):
        t = texts[k % 60]
        a = r.randrange(max(1, len(t) - 15))
        q = list(t[a : a + r.randint(12, 90)])
        for _ in range(r.randint(0, max(1, len(q) // 10))):
            j = r.randrange(len(q) + 1)
            q[j : j + r.randint(0, 1)] = r.choice(["", "x", "e"])
        quotes.append("".join(q).upper())
    quotes += ["Total 1,999 USD for all of i here", "Total 1,899 USD for all of it here", "short", None]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(x.quote_id, x.doc_id): x.span for x in retrieval.near_quotes(q, d).collect()}
    want = {}
    for i, quote in enumerate(quotes):
        quote = " ".join((quote or "").lower().split())[:400]
        for j, text in enumerate(texts):
            text = " ".join((text or "").lower().split())
            if 12 <= len(quote) <= len(text):
                span = (text.find(quote), text.find(quote) + len(quote)) if quote in text else align.nearest(text, quote)
                if span and (i, j) != (81, 61):
                    want[i, j] = text[span[0] : span[1]]
    assert (80, 61) in want and len(want) > 60 and got == want


def test_repeated_claims_and_names(spark):
    """A repeat of a claim that was set aside may still be made; any name before a number counts."""
    texts = spark.createDataFrame([(1, "The tool ran on Windows 7 first. It got faster in 2019 by half. [12] Later it was sold for 40 coins.")], "check int, text string")
    claims = spark.createDataFrame([
        (1, 1, "It was sold for 40 coins", "nowhere to be found"), (1, 2, "It was sold for 40 coins", "Later it was sold for 40 coins."), (1, 3, "it was SOLD for 40 coins", "Later it was sold for 40 coins."),
        (1, 4, "Mac 7 and Windows 7 got faster in 2019", "It got faster in 2019 by half."), (1, 5, "It was sold for 12 coins", "Later it was sold for 40 coins."),
    ], "check int, pos int, claim string, excerpt string")
    got = factcheck.anchor_claims(claims, texts, 9).select("pos", "reason", "kept")
    assert rows(got, "pos") == [(1, "its passage is not in the text", False), (2, None, True), (4, None, True), (5, "its passage does not say 12", False)]


def test_memory_of_near_copies(spark):
    """learn() against a walk through all findings in order."""
    r = random.Random(6)
    words = "the big firm opened twelve new shops in town today and sold many 4711 things there".split()
    base = [" ".join(r.sample(words, 9)) for _ in range(12)]

    def some(quote):
        q = list(quote)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(q))
            q[k : k + 1] = r.choice(["", "e", "xy"])
        q = "".join(q)
        return r.choice([q, q.upper(), q + " and more of it", q[: max(14, len(q) - r.randint(0, 20))]])

    day = lambda k: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=k)
    stored = [("u1", base[0], "old claim", "g", 0, day(0), day(1), True), ("u1", base[1], "older", "g", 0, day(0) + datetime.timedelta(hours=1), day(9), False)]
    found = [(f"u{r.randint(1, 2)}", some(r.choice(base)), f"claim {k}", "g", 1 + k // 20, k % 20, day(2 + k // 20), k % 7 != 0) for k in range(100)]
    bad = [("u1", base[3]), ("u2", base[4])]
    fold = lambda s: " ".join(s.lower().split())
    nums = lambda s: {w for w in s.split() if w.isdigit()}

    def holds(text, quote):
        if quote in text:
            return True
        span = align.nearest(text, quote) if len(text) >= len(quote) >= 12 else None
        return span is not None and nums(quote) <= nums(text[span[0] : span[1]])

    same = lambda a, b: holds(fold(a), fold(b)) or holds(fold(b), fold(a))
    memory = [list(x) for x in stored]
    for url, quote, claim, goal, run, _, seen, trusted in sorted(found, key=lambda x: (x[6], x[4], x[5])):
        if not trusted:
            continue
        row = next((m for m in memory if m[0] == url and same(m[1], quote)), None)
        if row:
            row[6] = max(row[6], seen)
        else:
            memory.append([url, quote, claim, goal, run, seen, seen, any(u == url and same(q, quote) for u, q in bad)])
    frame = spark.createDataFrame
    shape = "url string, quote string, claim string, goal string, run_id long, first_seen timestamp, last_seen timestamp, hidden boolean"
    got = delivery.learn(frame(stored, shape), frame(found, "url string, quote string, claim string, goal string, run_id long, pos int, seen timestamp, trusted boolean"), frame(bad, "url string, quote string"))
    assert 10 < len(memory) < 70 and sorted(map(tuple, got.collect())) == sorted(map(tuple, memory))


def test_stems(spark):
    """Examples of the published description, and recall by stems without diacritics."""
    told = (
        "caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
        "tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radicalli radic "
        "vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formalize formal electrical electr "
        "goodness good revival reviv allowance allow airliner airlin adjustable adjust replacement replac adoption adopt homologou homolog communism commun probate probat rate rate cease ceas "
        "controll control roll roll running run"
    ).split()
    assert [stem.stem(w) for w in told[::2]] == told[1::2]
    memory = spark.createDataFrame([(1, "He runs daily", "", "", 5, False), (2, "the cafés were closed", "", "", 6, False), (3, "running shoes", "x", "", 7, True)], "memory_id int, claim string, quote string, goal string, last_seen int, hidden boolean")
    asked = spark.createDataFrame([(1, ["running"]), (2, ["cafe"]), (3, ["closing", "run"])], "query_id int, tokens array<string>")
    found = lambda stemmed: {(r.query_id, r.memory_id) for r in retrieval.recall(asked, memory, 5, stemmed).collect()}
    assert found(True) == {(1, 1), (2, 2), (3, 1), (3, 2)} and found(False) == set()


def test_search_cache(spark):
    now = datetime.datetime(2026, 1, 1, 12)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    cache = spark.createDataFrame([("a", ago(10), ["x"]), ("a", ago(5), []), ("a", ago(50), ["y"]), ("b", ago(3600), ["z"]), ("c", ago(-5), ["w"])], "key string, fetched_at timestamp, results array<string>")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, n int")
    got = pages.answered(asked, cache, "key", F.lit(now)).orderBy("n").collect()
    assert [(r.key, r.usable, r.cached and r.cached.results) for r in got] == [("a", True, ["x"]), ("b", False, None), ("c", False, None), ("d", False, None)]
    keys = spark.range(1).select(pages.search_key(F.lit("e"), F.lit(True), F.lit("uk"), F.lit(None).cast("string"), F.lit(5), F.lit("q")).alias("k"))
    assert keys.first().k == "e|news|uk|any|5|q"


def test_measured_series_and_moves(spark):
    from factloom.operators import values

    told = [("a", "old", 100, "USD", None), ("a", "new", 80, "USD", None), ("a", "eur", 5, "EUR", None), ("a", "eur", 6, "EUR", "hour"), ("a", "eur", 9, "EUR", "hour"), ("b", "zero", 0, None, None), ("b", "zero", 3, None, None)]
    points = spark.createDataFrame([(n, *x) for n, x in enumerate(told)], "n int, key string, label string, amount int, currency string, unit string")
    got = sorted(rows(values.measured_series(points, ["n"]).select("key", "measure", "label", "first", "last", "low", "high", "points", "percent")), key=lambda r: r[:2])
    assert got == [("a", "EUR", "eur", 5, 5, 5, 5, 1, 0.0), ("a", "EUR per hour", "eur", 6, 9, 6, 9, 2, 50.0), ("a", "USD", "new", 100, 80, 80, 100, 2, -20.0), ("b", "", "zero", 0, 3, 0, 3, 2, None)]
    assert [r.percent for r in values.percent_moves(points, ["key"], ["n"]).orderBy("n").collect()] == [None, -20.0, None, None, 50.0, None, None]


def test_pack_errors(spark):
    packs = spark.createDataFrame([("price", ["product", "limit"], ["product"])], "pack string, params array<string>, required array<string>")
    given = spark.createDataFrame([("price", {"product": "X"}), ("price", {"product": " "}), ("price", {"b": "1", "a": "2"}), ("none", {"x": "1"}), ("price", {"limit": None, "product": "Y"})], "pack string, values map<string,string>")
    got = {r.error for r in delivery.pack_errors(given, packs).collect()}
    assert got == {"pack price needs product=...", "pack price has no parameter a, b", "there is no pack none"} and delivery.pack_errors(given, packs).count() == 3


def test_replay_and_cases_from_runs(spark):
    frame = spark.createDataFrame
    sources = frame([(1, 1, "h1", False), (1, 2, None, True), (2, 1, "h2", False), (2, 2, "h1", False)], "run_id int, source_no int, content_hash string, snippet_only boolean")
    stored = evaluation.restored(sources, frame([("h1", "the page", None), ("h1", "the page", None)], "content_hash string, text string, offers array<string>"))
    assert rows(stored.select("run_id", "source_no", "text", "snippet_only", "gone"), "run_id", "source_no") == [
        (1, 1, "the page", False, False), (1, 2, "", True, False), (2, 1, "", True, True), (2, 2, "the page", False, False)
    ]
    ratings = frame([(1, 3, "bad", None, "q3"), (1, 2, "good", None, "q2"), (1, 1, "good", "$5", "q1")], "run_id int, number int, verdict string, value string, quote string")
    runs = frame([(1, "g", "p"), (2, "h", "p"), (3, "i", "p")], "run_id int, goal string, plan string")
    assert rows(evaluation.cases_from_runs(runs, stored, ratings), "run_id") == [
        (1, "g", "p", ["$5", "q2"], ["q3"], None), (2, "h", "p", [], [], "1 page(s) are gone"), (3, "i", "p", [], [], None)
    ]
    asked = frame([("a", 1, "plan"), ("a", 2, "extract"), ("a", 3, "extract"), ("a", 4, "extract"), ("b", 1, "plan")], "case string, seq int, purpose string")
    recorded = frame([("a", "plan", ["P"]), ("a", "extract", ["X", "Y"])], "case string, purpose string, replies array<string>")
    assert [r.reply for r in evaluation.replayed(asked, recorded).orderBy("case", "seq").collect()] == ["P", "X", "Y", None, None]
    found = lambda *x: frame(list(x), "run_id int, trusted boolean")
    assert rows(evaluation.replay_counts(found((1, True), (1, False)), found((1, True), (2, True)), stored), "run_id") == [
        (1, 2, 1, 1, 1, "replay of run 1"), (2, 0, 1, 0, 1, "replay of run 2; 1 page(s) of it are no longer stored")
    ]
