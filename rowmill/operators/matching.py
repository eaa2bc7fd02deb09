"""Lookups against dictionaries and matches between names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import canon

MAX_BROADCAST = 64 * 2**20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if the planner's estimate of its size (of its files, before filters) is
    at most ``MAX_BROADCAST`` bytes, else as it is; no job is run to find out."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def longest_containment(texts: DataFrame, key: str, text: str, entries: DataFrame, name: str) -> DataFrame:
    """``key``, ``name``: the longest entry whose words stand in the text, word by word; ties: the first in order.

    Texts meet entries on their first word, so no text is compared with all entries.
    """
    heads = entries.select(F.col(name), canon(name).alias("_e")).filter("_e <> ''").withColumn("_h", F.element_at(F.split("_e", " "), 1))
    held = texts.select(key, F.concat(F.lit(" "), canon(text), F.lit(" ")).alias("_t")).withColumn("_h", F.explode(F.array_distinct(F.split(F.trim("_t"), " "))))
    hit = held.join(small(heads), "_h").filter(F.expr("contains(_t, concat(' ', _e, ' '))"))
    best = F.min_by(name, F.struct(-F.length("_e"), "_e", name))
    return hit.groupBy(key).agg(best.alias(name))


def alias_weights(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """``key``, prefix, weight: for each prefix whose alias stands in the text its largest weight.
    aliases: alias, prefix, weight."""
    heads = aliases.select(canon("alias").alias("_e"), "prefix", "weight").withColumn("_h", F.element_at(F.split("_e", " "), 1))
    held = texts.select(key, F.concat(F.lit(" "), canon(text), F.lit(" ")).alias("_t")).withColumn("_h", F.explode(F.array_distinct(F.split(F.trim("_t"), " "))))
    return held.join(small(heads), "_h").filter(F.expr("contains(_t, concat(' ', _e, ' '))")).groupBy(key, "prefix").agg(F.max("weight").alias("weight"))


def exact_or_unique(rows: DataFrame, reference: DataFrame, exact: list[str], part: str, value: str) -> DataFrame:
    """Rows with ``value`` of the reference row that agrees on ``exact``, else of the only one that agrees on ``part``, else null."""
    whole = reference.groupBy(*exact).agg(F.min(value).alias("_w"))
    only = reference.groupBy(part).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a = _b").select(part, "_a")
    return rows.join(whole, exact, "left").join(only, part, "left").withColumn(value, F.coalesce("_w", "_a")).drop("_w", "_a")


def name_overlap(a: str, b: str) -> "F.Column":
    """How many leading words of two names begin alike (one is a prefix of the other)."""
    x, y = F.split(canon(a), " "), F.split(canon(b), " ")
    zipped = F.zip_with(x, y, lambda p, q: F.when(p.isNotNull() & q.isNotNull() & (p.startswith(q) | q.startswith(p)), 1).otherwise(0))
    return F.aggregate(zipped, F.lit(0), lambda s, v: s + v)
