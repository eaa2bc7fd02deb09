"""Queries of problem 3: records of the same flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.addresses import inherit, link_addresses, read_addresses, same_place_pairs
from rowmill.session import written
from rowmill.tables import current, table

KEY = "address_record_id"
PARTS = {"street": "street", "house": "house", "building": "building", "structure": "structure", "flat": "apartment"}


def town_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Town names in the reference list (a fixed table of some hundred entries), and the home town."""
    named = table(spark, sf_dir, "ref_entries").select(F.regexp_extract("canonical_name", r"город ([А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)?)$", 1).alias("t"))
    return sorted({r.t for r in named.distinct().collect() if r.t} | {"Вербоград"})


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address record read into its levels."""
    towns = town_names(spark, sf_dir)
    flats = current(spark, sf_dir, "property_addresses", "street", "house", "building", "structure", "apartment", "full_address")
    gone = current(spark, sf_dir, "departures", KEY, "destination_address").filter(F.col("destination_address").isNotNull() & F.col(KEY).isNotNull())
    one = read_addresses(flats, KEY, "full_address", PARTS, towns)
    return one.unionByName(read_addresses(gone, KEY, "destination_address", {}, towns))


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address record with the id of its place, or, if it ends above the flat, with how
    many places it may be."""
    levels = written(p3_levels(spark, sf_dir), "read")
    return inherit(levels, written(link_addresses(levels, KEY), "places"), KEY)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_place_pairs(link_addresses(p3_levels(spark, sf_dir), KEY), KEY)


QUERIES = {"p3_found": p3_found, "p3_places": p3_places, "p3_levels": p3_levels}
