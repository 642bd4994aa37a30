"""Quality rules as a short-circuit cascade. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows, characters of each, and turns on which costs and rejections are estimated. They steer the order of the rules only.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TIMES = 200, 20_000, 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def letter_words(found: Column) -> Column:
    """How many words hold a letter. Those that begin with a basic Latin letter need no pattern."""
    return F.size(F.filter(found, lambda w: w.between("A", "Z~") | w.between("a", "z~") | w.rlike(r"\p{L}")))


def repeated_words(found: Column) -> Column:
    """How many words stand in windows of WINDOW words that the text holds twice or more.

    A window's hash is made of those of its halves, and these of pairs of words. Texts in which no
    half repeats are done; else windows are sorted with their places, and the places of equal
    neighbours are joined to runs. Linear but for the sort, for texts of any length.
    """

    def of_places(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)

    def of_sorted(pairs: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(pairs, k)["h"] == s["h"], F.lit(False))
        doubles = F.filter(pairs, lambda s, k: same(s, k - 1) | same(s, k + 1))
        return let(F.sort_array(F.transform(doubles, lambda s: s["i"])), of_places)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, of_sorted)
        ).otherwise(F.lit(0).cast("long"))

    def doubled(hashes: Column, reach: int) -> Column:
        n = F.size(hashes) - reach
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, reach + 1, n), lambda a, b: F.xxhash64(a, b))

    def of_halves(half: Column) -> Column:
        distinct = F.size(F.array_distinct(half)) == F.size(half)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(doubled(half, WINDOW // 2), of_hashes))

    def of_words(w: Column) -> Column:
        half = let(doubled(w, 1), lambda pairs: doubled(pairs, 2))
        return F.when(F.size(w) > WINDOW, let(half, of_halves)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), of_words)


def measures(text: Column, found: Column) -> dict[str, Column]:
    """What the rules look at, as columns of a text and its words."""
    lines = lines_with_words(text)
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(found),
        "n_letter_words": letter_words(found).cast("long"),
    }


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """name -> what rejects a text, by its measures. Loose bounds, so that only plain junk goes."""
    return {
        "too_few_words": m["n_words"] < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "many_symbols": m["n_symbols"] > m["n_words"],
        "word_length": ~m["word_chars"].between(2 * m["n_words"], 15 * m["n_words"]),
        "repeated_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "few_letters": 10 * m["n_letter_words"] < 4 * m["n_words"],
    }


BASE = ("too_few_words", "repeated_windows")
PUBLISHED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(named: dict[str, Column], order: list[str]) -> Column:
    """True as soon as a rule rejects; later rules are then not looked at."""
    return reduce(lambda rest, name: F.when(named[name], True).otherwise(rest), reversed(order), F.lit(False))


def ordered(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on a sample, the best first.

    The order changes no verdict: a text is kept if no rule rejects it. So the sample is simply the
    first rows that Spark reads, `sample_rows` at most and of each SAMPLE_CHARS characters at most, taken
    from as few partitions as hold them. A rule's cost is the time of a job over the sample, each row
    SAMPLE_TIMES, less that of a job that only splits the words.
    """
    spark = docs.sparkSession
    taken = docs.select(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).take(sample_rows)
    if not taken:
        return list(rules(dict.fromkeys(measures(F.lit(""), F.array(F.lit(""))), F.lit(0))))
    rows = spark.createDataFrame([(r["text"],) for r in taken], "text string")
    rows = rows.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))).alias("turn"))

    def run(name: str | None) -> tuple[float, int]:
        began = time.perf_counter()
        verdict = let(words(F.col("text")), lambda w: rules(measures(F.col("text"), w))[name] if name else F.size(w) < 0)
        rejected = rows.agg(F.count_if(verdict)).first()[0]
        return time.perf_counter() - began, rejected

    run(None)
    least, _ = run(None)
    gain = {}
    for name in rules(measures(F.lit(""), F.array(F.lit("")))):
        took, rejected = run(name)
        gain[name] = rejected / max(1e-3, took - least)
    return sorted(gain, key=lambda name: -gain[name])


def judged(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base measures and verdicts of every document.

    The published measures are asked for of every row; what else a rule looks at is computed only for
    rows that the cascade brings to it. Null and empty texts have no words and fail the base; texts of
    any length are read whole; repeated rows each get their row; an empty table gives none; further
    columns are left aside.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    rows = rows.withColumn("lines", lines_with_words(F.col("text")))
    own = measures(F.col("text"), F.col("words"))
    own["n_dup_lines"] = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    rows = rows.select("doc_id", "words", "lines", *[own[name].alias(name) for name in PUBLISHED])
    named = rules({**{name: F.col(name) for name in PUBLISHED}, "n_lines": F.size("lines"), "n_letter_words": letter_words(F.col("words"))})
    rest = [name for name in ordered(docs, sample_rows) if name not in BASE]
    failed = named["too_few_words"] | named["repeated_windows"]
    return rows.select(
        "doc_id", *PUBLISHED, failed.alias("base_failed"), (~F.when(failed, True).otherwise(cascade(named, rest))).alias("kept")
    )


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    The words of a text are split once; measures stand in the cascade itself, so a rule behind one that
    rejects costs nothing. A null or empty text is rejected for its words; repeated rows are judged
    each; an empty table gives no rows; a null doc_id does not matter.
    """
    order = ordered(docs, sample_rows)
    text = F.coalesce("text", F.lit(""))
    return docs.where(~let(words(text), lambda w: cascade(rules(measures(text, w)), order)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op9. Lists keep the order of the text; windows are compared as lists of words.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 10 * n_letter_words < 4 * n_words) AS kept
FROM b
"""
