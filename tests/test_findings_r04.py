"""What the fourth review found: queries on odd rows, held against their SQL or plain Python, and how much work is left to slow steps."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.functions import align
from factloom.llm import substrings
from factloom.operators import evidence, retrieval
from test_findings_r03 import held_against_sql


def test_few_pairs_are_aligned():
    """Nearly every text of a quote's language passed the count of grams and was aligned at all places; no pair that matches may be lost."""
    r = random.Random(3)
    syllables = "th nd ed er on re at en he in ti es or the and of an".split()
    words = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [words(r.choice([4, 40, 400])) for _ in range(40)] + ["and the " * 300, "", "of"]
    quotes = []
    for k in range(40):
        text = texts[k]
        q = list(text[(a := r.choice([0, r.randrange(len(text)), max(0, len(text) - 150)])) : a + r.randint(80, 250)])
        for _ in range(int(len(q) * r.choice([0, 0.05, 0.15, 0.2]))):
            j = r.randrange(len(q))
            q[j : j + 1] = r.choice([[], [q[j], "x"]])
        quotes.append("".join(q) if len(q) > 11 else "there is nothing of this here")
    sought = align.Sought(quotes)
    found = {(t, k) for t, text in enumerate(texts) for k in sought.candidates(text)}
    held = {(t, k) for t, text in enumerate(texts) for k, q in enumerate(quotes) if len(q) <= len(text) and (q in text or align.nearest(text, q))}
    assert held <= found and len(held) > 20 and len(found - held) < 10


def test_near_quotes_are_checked_whole(spark):
    """Quotes were judged by their first 400 letters, so what came behind them could say anything."""
    start = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} of it" for k in range(60))
    quotes = spark.createDataFrame([(1, f"{start} and then they all went home to sleep, in 1999, each one by himself, and none of them came back to tell"), (2, start)], "quote_id long, quote string")
    docs = spark.createDataFrame([(1, start + " " + "but nobody ever heard of any of these things again " * 4), (2, f"It says: {quotes.first().quote}, so.")], "doc_id long, text string")
    assert sorted((r.quote_id, r.doc_id) for r in retrieval.near_quotes(quotes, docs).collect()) == [(1, 2), (2, 1), (2, 2)]
    pages = docs.withColumn("page", docs.doc_id * 0)
    assert sorted((r.quote_id, r.doc_id) for r in retrieval.near_quotes(quotes.withColumn("page", quotes.quote_id * 0), pages, by=["page"]).collect()) == [(1, 2), (2, 1), (2, 2)]


def test_hidden_turns_hold_the_letters_as_they_stand(spark, tmp_path):
    """Spaces were folded, and a turn was hidden too if the first letters held it; SQL knows neither."""
    turns = [
        (1, 0, "user", "It was here  and there"), (1, 1, "assistant", "it was here and so"), (1, 2, "user", "was"), (1, 3, "user", ""), (1, 4, "user", "so it was here  or"), (1, 5, "user", None),
        (2, 0, "user", "a thing here is"), (2, 1, "assistant", "a thing her"), (2, 2, "user", "A THING HERE"), (2, 3, "user", "a\tthing here"), (3, 0, "user", ""), (3, 1, "user", "any"), (4, 0, "user", None), (4, 1, "user", "any"),
        (5, 0, "user", "ΟΔΟΣ ΑΣ \u0130\u0130\u0130\u0130 x"), (5, 1, "user", "οδοσ ασ iiii"), (5, 2, "user", "οδος ας iiii"), (6, 0, "user", "no"), (6, 0, "user", "no"), (6, 1, "assistant", "no, n\u2019o"), (7, 0, "assistant", "x"), (7, 1, "user", "x"),
        (8, 0, "user", "straße ﬁx it"), (8, 1, "user", "strasse fix it"), (9, 0, "user", "it\u2019s this way"), (9, 1, "user", "it's this way"), (9, 2, "user", "it\u2019s this way"), (None, 0, "user", "x"),
    ]
    held_against_sql(spark, tmp_path, "e8_hidden", {"conversations": ("conv_id long, turn int, role string, text string", turns)})


def test_texts_without_the_numbers_are_not_aligned(spark):
    """A page with another price was aligned with the old one at all places, only to miss its number; whatever is whole is possible."""
    written = ["1,999.00", "1999", "$1.5 million", "1500000", "78k", "78,000", "0.05", "$0.50 m", "500000", "12.34", "12.340", "007", "70", "0.1234567", "0.123457", "99999999999999999999999999999999999999999", "1,66,269", "2 bn", "20", "0.12345678999", "0.12345679", "1.9999999", "2"]
    pairs = [(f"part 5 is sold for {a} dollars here", f"part 5 is sold for {b} dollars here") for a in written for b in written]
    rows = spark.createDataFrame(pairs, "text string, quote string").select(
        "text", "quote", evidence.whole(F.col("quote"), F.col("text")).alias("whole"), evidence.located(F.col("text"), F.col("quote")).isNotNull().alias("located")
    ).collect()
    lacking = [r for r in rows if align.lacks(r.text, r.quote)]
    assert [r for r in lacking if r.whole] == [] and sum(r.whole for r in rows) > len(written) and len(lacking) > 150
    assert [r for r in rows if r.located != (r.whole and (r.quote == r.text or align.nearest(r.text, r.quote) is not None))] == []
    assert align.lacks("part 7 is sold out at this shop", "part 7 is sold for 12.34 dollars at this shop")


def test_sampled_suffixes_are_packed():
    """A row of the shuffle of sampled suffixes took 34 bytes; two hashes of 11 bytes cannot shrink, the rest can."""
    n, g = 4000, np.random.default_rng(1)
    docs, tags = np.repeat(np.arange(n // 4), 4), np.repeat(g.integers(-(2**63), 2**63, n // 4), 4)
    columns = (g.integers(0, 2**64, n, dtype=np.uint64), g.integers(0, 2**64, n, dtype=np.uint64), docs, tags, np.tile(np.arange(4, dtype=np.uint32) * 900, n // 4))
    packed = substrings.blob(columns, substrings.SAMPLE)
    assert len(packed) < 21 * n
    got = substrings.unblob([packed, packed], substrings.SAMPLE)
    assert all((x[:n] == y).all() and (x[n:] == y).all() for x, y in zip(got[2:], columns[2:], strict=True))
    assert (got[0][:n] == columns[0] % 2**32).all() and (got[1][:n] == columns[1] % 2**56).all()
