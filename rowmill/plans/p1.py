"""Queries of problem 1: the parsed housing documents as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.operators.nested import EXTRACTED, METADATA, label_nodes, node_table
from rowmill.tables import current

KEYS = ["job_id", "file_index"]
FOUND = ["owner", "ownership_document", "passport", "property_address", "person", "departure", "page_image", "ocr_preview", "trace_person"]
PASSPORT = {c: f"$.{c}" for c in ("document_type", "series", "number", "issued_by", "issue_date", "raw")}
DEPARTURE = {c: f"$.{c}" for c in ("status", "reason", "raw", "death_date", "departure_date", "act_record_number", "act_record_date", "issued_by", "destination_address")} | {
    f"validation_{c}": f"$.validation.{c}" for c in ("scheme", "applicable", "passed")
}
#: node type: (parent types, fields)
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "page_1": ("record", {c: f"$.{c}" for c in ("document_date", "administrative_okrug", "district", "settlement_type", "primary_tenant")} | {"management_company": "$.management_company.name"}),
    "property_address": ("page_1", {c: f"$.{c}" for c in ("street", "house", "building", "structure", "apartment", "full")}),
    "owner": ("page_1", {"full_name": "$.full_name", "ownership_share": "$.ownership_share", "value": "$.value"}),
    "ownership_document": ("page_1", {"value": "$.value"}),
    "person": ("page_2", {"full_name": "$.full_name", "birthday_date": "$.birthday_date"}),
    "passport": ("person/page_1", PASSPORT),
    "departure": ("person", DEPARTURE),
    "page_image": ("record", {"value": "$.value"}),
    "ocr_preview": ("record", {"value": "$.value"}),
    "trace_person": ("record", {c: f"$.{c}" for c in ("full_name", "full_name_confidence", "birthday_date_confidence", "passport_confidence")}),
}


def nodes(spark: SparkSession, sf_dir: str, with_fields: bool = True) -> DataFrame:
    files = current(spark, sf_dir, "job_files", "extracted_data_json", "metadata_json")
    return label_nodes(files, KEYS, {"extracted_data_json": EXTRACTED, "metadata_json": METADATA}, with_fields)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per child node of each file's readable JSON."""
    return nodes(spark, sf_dir, False).filter(F.col("node_type").isin(FOUND)).select(*KEYS, "node_path")


def p1_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose JSON can't be read, with the reason."""
    bad = nodes(spark, sf_dir, False).filter(F.col("node_type") == "unreadable")
    return bad.select(*KEYS, F.col("source").alias("column_name"), "problem")


def p1_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type, and how many of them lie inside a node of the type above."""
    types = F.create_map(*[F.lit(x) for k, (p, _) in TABLES.items() for x in (k, p)])
    found = nodes(spark, sf_dir, False).filter(F.col("node_type").isin(list(TABLES)))
    return found.groupBy("node_type").agg(F.count("*").alias("n_nodes"), F.max("depth").cast("long").alias("max_depth")).withColumn("parent_type", types[F.col("node_type")])


def _table_query(kind: str):
    parent, fields = TABLES[kind]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return node_table(nodes(spark, sf_dir), KEYS, kind, fields, *parent.split("/"))

    query.__doc__ = f"Flat table of the nodes of type {kind}, each with the number of its {parent}."
    return query


QUERIES = {"p1_found": p1_found, "p1_unreadable": p1_unreadable, "p1_node_counts": p1_node_counts} | {f"p1_{k}_table": _table_query(k) for k in TABLES}
