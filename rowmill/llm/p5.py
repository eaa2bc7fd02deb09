"""Queries of problem 5: variant spellings of persons and of issuing bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.people import bodies, people, variant_pairs
from rowmill.tables import current, table


def p5_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named resident row with the parts of its name and its person."""
    residents = current(spark, sf_dir, "residents", "resident_id", "full_name", "birthday_date", "document_id")
    return people(residents, current(spark, sf_dir, "identity_documents", "document_id", "number"))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card with its issuing body."""
    return bodies(table(spark, sf_dir, "issuer_cards").dropDuplicates(["card_id"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = variant_pairs(p5_people(spark, sf_dir), "person_id", "resident_id", "full_name").select(F.lit("person").alias("entity_kind"), "id_a", "id_b")
    cards = variant_pairs(p5_bodies(spark, sf_dir), "body_id", "card_id", "issued_by").select(F.lit("issuer").alias("entity_kind"), "id_a", "id_b")
    return persons.unionByName(cards)


QUERIES = {"p5_found": p5_found, "p5_people": p5_people, "p5_bodies": p5_bodies}
