"""Queries of problem 7: residents and the register of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.linkage import link
from rowmill.llm.people import people
from rowmill.session import written
from rowmill.tables import current, table


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resident row with the registry rows of the same person, and the confidence."""
    residents = current(spark, sf_dir, "residents", "resident_id", "full_name", "birthday_date", "document_id")
    members = written(people(residents, current(spark, sf_dir, "identity_documents", "document_id", "number")), "members")
    matches = link(table(spark, sf_dir, "registry_persons"), members, residents)
    return members.select("resident_id", "person_id").join(matches, "person_id").select("resident_id", "registry_id", "confidence")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("resident_id", "registry_id")


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches}
