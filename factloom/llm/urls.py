"""URL filters by a ratio of character language models."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written

#: The rules of the query, as (verdict, host and path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
ORDER = 5
ALPHABET = 256
#: URLs that are scored at a time against their part of the counts, and the steps in which scores are told apart for the threshold.
BLOCK = 2000
STEPS = 4096


class Markov:
    """A variable-order Markov model of characters, Witten-Bell smoothed down to a uniform one."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.seen: dict[str, int] = defaultdict(int)  # context and character -> times
        self.total: dict[str, int] = defaultdict(int)  # context -> times
        self.kinds: dict[str, int] = defaultdict(int)  # context -> distinct characters

    def add(self, text: str) -> None:
        text = "\x02" * self.order + text + "\x03"
        for i in range(self.order, len(text)):
            for k in range(self.order + 1):
                context = text[i - k : i]
                gram = context + text[i]
                self.kinds[context] += not self.seen.get(gram, 0)
                self.seen[gram] += 1
                self.total[context] += 1

    def likelihood(self, text: str) -> float:
        """The mean log probability of a character."""
        text = "\x02" * self.order + text + "\x03"
        seen, total, kinds = self.seen, self.total, self.kinds
        out = 0.0
        for i in range(self.order, len(text)):
            p = 1 / ALPHABET
            for k in range(self.order + 1):
                context = text[i - k : i]
                n = total.get(context)
                if not n:
                    break
                t = kinds[context]
                p = (seen.get(context + text[i], 0) + t * p) / (n + t)
            out += math.log(p)
        return out / (len(text) - self.order)


class Filter:
    """Scores a URL by the difference of the two models' mean log probabilities."""

    def __init__(self, labelled: list[tuple[str, str]], order: int = ORDER) -> None:
        self.accepted, self.rejected = Markov(order), Markov(order)
        held = []
        for k, (text, verdict) in enumerate(labelled):
            if k % 5 == 4:
                held.append((text, verdict))
            else:
                (self.accepted if verdict == "allow" else self.rejected).add(text)
        self.least = calibrated([(self.score(t), v == "allow") for t, v in held])

    def score(self, text: str) -> float:
        return self.accepted.likelihood(text) - self.rejected.likelihood(text)

    def verdict(self, text: str) -> str:
        return "allow" if self.score(text) >= self.least else "block"


def calibrated(scores: list[tuple[float, bool]]) -> float:
    """The threshold of counted() for single scores."""
    return counted([(score, int(label), int(not label)) for score, label in scores])


def counted(scores: list[tuple[float, int, int]]) -> float:
    """From (score, accepted, rejected), the counts: the least score to accept that gives the highest mean of both classes' accuracies; 0 where a class is missing."""
    good, bad = sum(g for _, g, _ in scores), sum(b for _, _, b in scores)
    if not good or not bad:
        return 0.0
    right, best, least = good / good, good / good, -math.inf
    below_good = below_bad = 0
    ranked = sorted(scores)
    for k, (score, accepted, rejected) in enumerate(ranked):
        below_good += accepted
        below_bad += rejected
        if k + 1 < len(ranked) and ranked[k + 1][0] == score:
            continue
        right = (good - below_good) / good + below_bad / bad
        if right > best:
            best, least = right, (score + ranked[k + 1][0]) / 2 if k + 1 < len(ranked) else math.inf
    return least


def strings(text: str, order: int) -> Iterator[str]:
    """Every context of a text with the character after it."""
    text = "\x02" * order + text + "\x03"
    for i in range(order, len(text)):
        for k in range(order + 1):
            yield text[i - k : i + 1]


NUMBERS = ["seen_a", "seen_r", "total_a", "total_r", "kinds_a", "kinds_r"]


def fitted(labelled: DataFrame, order: int) -> DataFrame:
    """(string, *NUMBERS) of all labelled (text, says): what Markov counts of accepted and rejected texts, as a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, r = Counter(), Counter()
            for text, says in zip(batch["text"], batch["says"], strict=True):
                (a if says == "allow" else r).update(strings(text, order))
            keys = list(a | r)
            yield pd.DataFrame({"string": keys, "seen_a": [a[k] for k in keys], "seen_r": [r[k] for k in keys]})

    grams = labelled.select("text", "says").mapInPandas(run, "string string, seen_a long, seen_r long")
    grams = grams.groupBy("string").agg(F.sum("seen_a").alias("seen_a"), F.sum("seen_r").alias("seen_r"))
    contexts = grams.groupBy(F.expr("substring(string, 1, length(string) - 1)").alias("string")).agg(
        F.sum("seen_a").alias("total_a"), F.sum("seen_r").alias("total_r"),
        F.count_if(F.col("seen_a") > 0).alias("kinds_a"), F.count_if(F.col("seen_r") > 0).alias("kinds_r"),
    )
    both = grams.unionByName(contexts, allowMissingColumns=True)
    return both.groupBy("string").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NUMBERS))


def scored(texts: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(text, says, score) of distinct texts: blocks of about BLOCK texts meet the counts of their own strings only."""
    n = max(1, -(-texts.count() // BLOCK))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(n)))

    def needed(group: pd.DataFrame) -> pd.DataFrame:
        found = {"\x02" * k for k in range(order + 1)}
        for text in group["text"]:
            found.update(strings(text, order))
        return pd.DataFrame({"block": group["block"].iloc[0], "string": list(found)})

    def run(group: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        models = []
        for end in "ar":
            model = Markov(order)
            for name in ("seen", "total", "kinds"):
                setattr(model, name, dict(zip(counts["string"], counts[f"{name}_{end}"].tolist(), strict=True)))
            models.append(model)
        score = [models[0].likelihood(t) - models[1].likelihood(t) for t in group["text"]]
        return group[["text", "says"]].assign(score=score)

    wanted = texts.groupBy("block").applyInPandas(needed, "block long, string string").join(counts, "string")
    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(run, "text string, says string, score double")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for what has no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def divided(ruled: DataFrame) -> DataFrame:
    """(text, says, held) of distinct labelled texts: a fifth by hash is held out, and of each verdict with two texts at least one is."""
    hashed = F.xxhash64("text")
    spare = ruled.groupBy("says").agg(F.min_by("text", hashed).alias("spare"), F.count("*").alias("n")).where("n > 1").select("says", "spare")
    rows = ruled.join(F.broadcast(spare), "says", "left")
    held = (F.pmod(hashed, F.lit(5)) == 4) & F.col("spare").isNotNull() | F.coalesce(F.col("text") == F.col("spare"), F.lit(False))
    return rows.select("text", "says", held.alias("held"))


def filtered(pages: DataFrame, rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Rules decide where they fit. For the rest, Markov models of accepted and rejected URLs are counted
    over all distinct URLs that rules decide but a fifth, and all of that fifth set the threshold, their
    scores told apart in steps of 1 / STEPS. A null or odd url has empty host and path and is judged by the
    models; without any labelled URL the score is 0 and it is allowed. Repeated rows each get their
    row, an empty table gives none, further columns are left aside.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says, "text": F.concat("host", "path")})
    texts = written(rows.select("text", "says").distinct(), "urls")
    labelled = written(divided(texts.where("says IS NOT NULL")), "labelled")
    counts = fitted(labelled.where("NOT held"), order)
    judged = texts.where("says IS NULL").unionByName(labelled.where("held").select("text", "says"))
    scores = written(scored(judged, counts, order), "scores")
    step = F.floor(F.col("score") * STEPS)
    held = scores.where("says IS NOT NULL").groupBy(step.alias("step")).agg(
        F.count_if(F.col("says") == "allow").alias("good"), F.count_if(F.col("says") != "allow").alias("bad")
    )
    least = counted([(r["step"] / STEPS, r["good"], r["bad"]) for r in held.collect()])
    verdict = F.when(step / STEPS >= least, "allow").otherwise("block")
    models = scores.where("says IS NULL").select("text", verdict.alias("judged"))
    ruled = rows.where("says IS NOT NULL").withColumn("judged", F.col("says"))
    rest = rows.where("says IS NULL").join(models, "text")
    return ruled.unionByName(rest).select("page_id", "host", "path", "rule", F.col("judged").alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))
