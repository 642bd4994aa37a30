"""Prices and other values of findings: offers, accessories, outliers, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import fold

#: Patterns of things that are sold for a product and are not the product.
ACCESSORIES = ["adapter", "backplate", "bracket", "cable", "cooler", "holder", "mount", "riser", "skin", "sticker", "stand", "water ?block"]


def cheapest_offers(offers: DataFrame, per_source: int = 3) -> DataFrame:
    """Of each source the cheapest offer of a product (folded name; the first of equals), then the cheapest few."""
    product = Window.partitionBy("source", "product").orderBy("price", "pos")
    source = Window.partitionBy("source").orderBy("price", "pos")
    rows = offers.withColumn("product", fold(F.col("product")))
    rows = rows.withColumn("nth", F.row_number().over(product)).where("nth = 1")
    return rows.withColumn("nth", F.row_number().over(source)).where(F.col("nth") <= per_source)


def accessory(entity: Column, goal: Column, names: list[str] | None = None) -> Column:
    """Whether an entity names an accessory that the goal does not ask for."""
    words = "|".join(names or ACCESSORIES)
    word = F.regexp_extract(F.coalesce(entity, F.lit("")), rf"(?i)\b({words})s?\b", 0)
    return (word != "") & ~F.contains(F.lower(goal), F.lower(word))


def flag_outliers(rows: DataFrame, group: list[str], amount: str, order: list[str], low: float = 0.5, high: float = 2.5) -> DataFrame:
    """Adds outlier: amount outside [low, high] times the median of the others of its group of three or more.

    The median without one row needs only the three values around the middle of the sorted group,
    which are picked by rank as conditional maxima; no group is gathered.
    """
    by = Window.partitionBy(*group)
    ranked = rows.withColumn("rank", F.row_number().over(by.orderBy(amount, *order)) - 1).withColumn("n", F.count("*").over(by))
    n, r = F.col("n"), F.col("rank")
    even = F.floor((n - 2) / 2)
    odd = F.floor((n - 1) / 2)
    k = F.when(n % 2 == 0, even).otherwise(odd)
    at = lambda d: F.max(F.when(r == k + d, F.col(amount))).over(by)
    ranked = ranked.withColumns({"below": at(-1), "middle": at(0), "above": at(1), "k": k})
    low_one = F.when(r <= F.col("k") - 1, F.col("middle")).otherwise(F.col("below"))
    high_one = F.when(r <= F.col("k"), F.col("above")).otherwise(F.col("middle"))
    median = F.when(n % 2 == 0, high_one * 1.0).otherwise((low_one + high_one) / 2)
    ranked = ranked.withColumn("others_median", F.when(n >= 3, median))
    out = (F.col(amount) < low * F.col("others_median")) | (F.col(amount) > high * F.col("others_median"))
    return ranked.withColumn("outlier", F.coalesce(out, F.lit(False))).drop("rank", "n", "below", "middle", "above", "k")


def flag_values(findings: DataFrame, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """Adds outlier to findings (run_id, pos, trusted, amount, currency, unit): judged are trusted amounts that are no rates, by run and currency."""
    judged = F.col("trusted") & F.col("amount").isNotNull() & F.col("unit").isNull()
    rows = findings.withColumn("money", F.coalesce("currency", F.lit("")))
    flagged = flag_outliers(rows.where(judged), ["run_id", "money"], "amount", ["pos"], low, high).drop("others_median")
    rest = rows.where(~F.coalesce(judged, F.lit(False))).withColumn("outlier", F.lit(False))
    return flagged.unionByName(rest).drop("money")


def offer_findings(offers: DataFrame, per_source: int = 3) -> DataFrame:
    """Findings of the cheapest offers (source, pos, product, price, currency, unit) of each source: claim, quote, attribute and amount."""
    told = cheapest_offers(offers.withColumn("name", F.col("product")), per_source)
    amount = F.concat_ws(" ", F.col("price").cast("string"), "currency")
    amount = F.when(F.col("unit").isNotNull(), F.concat(amount, F.lit(" per "), "unit")).otherwise(amount)
    return told.select(
        "source", F.col("name").alias("entity"), F.lit("price").alias("attribute"), amount.alias("value"), F.concat(F.coalesce("name", F.lit("offer")), F.lit(": "), amount).alias("claim"),
        F.concat(F.lit("- "), F.coalesce("name", F.lit("offer")), F.lit(": "), amount).alias("quote"), F.col("price").alias("amount"), "currency", "unit",
    )


def series(observations: DataFrame, key: list[str], order: list[str], amount: str) -> DataFrame:
    """First, last, lowest and highest amount of each key, and how many points it has."""
    at = F.struct(*order)
    return observations.groupBy(*key).agg(
        F.min_by(amount, at).alias("first"), F.max_by(amount, at).alias("last"), F.min(amount).alias("low"),
        F.max(amount).alias("high"), F.count("*").alias("points"),
    )


def measured_series(observations: DataFrame, order: list[str]) -> DataFrame:
    """(key, currency, unit, label, measure, first, last, low, high, points, percent): a series for each fact and measure.

    observations: key, label, amount, currency, unit. A price that moves to another currency or unit begins a new series. The label is the
    last one; percent is the change from first to last, null from zero; the measure is like "USD per hour".
    """
    by = ["key", "currency", "unit"]
    labels = observations.groupBy(*by).agg(F.max_by("label", F.struct(*order)).alias("label")).withColumnsRenamed({"key": "k", "currency": "c", "unit": "u"})
    rows = series(observations, by, order, "amount").join(labels, F.col("key").eqNullSafe(F.col("k")) & F.col("currency").eqNullSafe(F.col("c")) & F.col("unit").eqNullSafe(F.col("u")))
    measure = F.concat_ws(" ", "currency", F.concat(F.lit("per "), "unit"))
    percent = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100)
    return rows.select(*by, "label", measure.alias("measure"), "first", "last", "low", "high", "points", percent.alias("percent"))


def percent_moves(observations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds percent: how amount moved from the point before; null from zero, for the first, and where currency or unit changed."""
    by = Window.partitionBy(*key).orderBy(*order)
    before = lambda c: F.lag(c).over(by)
    rows = observations.withColumns({"_amount": before("amount"), "_currency": before("currency"), "_unit": before("unit")})
    same = F.col("_currency").eqNullSafe(F.col("currency")) & F.col("_unit").eqNullSafe(F.col("unit")) & (F.col("_amount") != 0)
    return rows.withColumn("percent", F.when(same, (F.col("amount") - F.col("_amount")) / F.col("_amount") * 100)).drop("_amount", "_currency", "_unit")


def moves(observations: DataFrame, key: list[str], order: list[str], amount: str) -> DataFrame:
    """Adds previous: the amount before, null for the first."""
    return observations.withColumn("previous", F.lag(amount).over(Window.partitionBy(*key).orderBy(*order)))
