"""Queries over persons brought together from several readings, and the public record with its trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators import identity as D
from rowmill.operators import persons as P
from rowmill.operators import reconcile as R
from rowmill.operators.idoc import one_line
from rowmill.operators.nested import node_table
from rowmill.plans.p1 import KEYS, nodes
from rowmill.plans.sql import current, ws
from rowmill.tables import current as cur

BY = ["job_id", "file_index"]


def people(s, d):
    """Residents as the table has them, with the document of their cell."""
    doc = cur(s, d, "identity_documents", "document_id", "raw").select("document_id", one_line("raw").alias("raw"))
    r = cur(s, d, "residents", "resident_id", "job_id", "file_index", "full_name", "birthday_date", "document_id", "registration_status_raw").join(doc, "document_id", "left")
    return r.select(*BY, F.col("resident_id").alias("key"), "full_name", "birthday_date", D.read_cell(F.col("raw")).alias("document"), (P.registration_status(F.col("registration_status_raw")) == "without_registration").alias("unregistered"))


def recorded(s, d):
    """Persons as the parsed records have them: the other reading of the same documents."""
    fields = {"full_name": "$.full_name", "birthday_date": "$.birthday_date"}
    p = node_table(nodes(s, d), KEYS, "person", fields, "page_2").select(*BY, F.col("pre").cast("long").alias("key"), "full_name", "birthday_date")
    return p.withColumn("document", F.lit(None).cast(D.DOCUMENT))


def page1(s, d):
    t = cur(s, d, "page1_records", "page1_id", "job_id", "file_index", "primary_tenant")
    own = F.when(F.col("primary_tenant").isNotNull(), F.array("primary_tenant")).otherwise(F.array().cast("array<string>"))
    return t.groupBy(*BY).agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("candidates"), F.min("primary_tenant").alias("subject")).withColumn("page1_document", F.lit(None).cast(D.DOCUMENT))


def q_merged(s, d):
    m = R.merge_parses(people(s, d).select(*BY, "key", "full_name", "birthday_date", "document"), recorded(s, d), BY, "key")
    return m.select("key", "full_name", "birthday_date", D.completeness(F.col("document")).cast("long").alias("n_fields"))


def q_reconciled(s, d):
    return R.reconcile(people(s, d), page1(s, d), BY).select("key", "full_name", "birthday_date", "document.number")


def q_registered_names(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").select("resident_id", R.registered_name(F.col("full_name")).alias("full_name"), R.incomplete(F.col("full_name")).alias("incomplete"))


def q_incomplete(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").select("resident_id", R.incomplete(F.col("full_name")).alias("incomplete"))


def q_similar(s, d):
    """How alike each resident's name is to the tenant of page 1."""
    r = cur(s, d, "residents", "resident_id", "job_id", "file_index", "full_name").filter("full_name IS NOT NULL")
    t = cur(s, d, "page1_records", "page1_id", "job_id", "file_index", "primary_tenant").filter("primary_tenant IS NOT NULL").select(*BY, F.col("primary_tenant").alias("tenant")).distinct()
    return r.join(t, BY).select("resident_id", "tenant", R.similarity(F.col("full_name"), F.col("tenant")).cast("long").alias("alike"))


def q_document_points(s, d):
    return people(s, d).select("key", F.round(R.document_points(F.col("document")), 4).alias("points"))


def q_prefers(s, d):
    """Whether the document of a person's first row is to be preferred to that of another row of the same number."""
    p = people(s, d).filter("document.number IS NOT NULL")
    one = p.groupBy("document.number").agg(F.min_by("document", "key").alias("one"))
    x = p.withColumn("number", F.col("document.number")).join(one, "number")
    return x.select("key", R.prefers_page1(F.col("one"), F.col("document")).alias("better"), R.prefers_page1_by_number(F.col("one"), F.col("document")).alias("by_number"))


def q_name_tokens(s, d):
    w = F.split(T.ws("full_name"), " ")
    return cur(s, d, "residents", "resident_id", "full_name").filter("full_name IS NOT NULL").select("resident_id", F.array_join(R.without_noise(R.split_tokens(w)), " ").alias("tokens"))


def q_trace(s, d):
    return R.person_trace(people(s, d).withColumn("method", F.lit("layout")), BY, "method").drop(*BY)


def q_page1_trace(s, d):
    p = cur(s, d, "page1_records", "page1_id", "document_date", "settlement_type", "primary_tenant").join(cur(s, d, "property_addresses", "address_record_id", "page1_id", "full_address").groupBy("page1_id").agg(F.max("full_address").alias("full_address")), "page1_id", "left")
    return R.page1_trace(p.withColumn("n_owners", F.lit(0)), ["page1_id"])


def q_unregistered_trace(s, d):
    r = cur(s, d, "residents", "resident_id", "full_name", "birthday_date", "page_number", "registration_status_raw")
    return r.filter(P.registration_status(F.col("registration_status_raw")) == "without_registration").select("resident_id", "full_name", "birthday_date", F.lit("without_registration").alias("registration_status"), F.col("registration_status_raw").alias("raw"), F.col("page_number").cast("long").alias("source_page"))


_R = current("residents")
_PARTS = lambda c: f"list_filter(string_split(lower({ws(f'replace({c}, chr(45), chr(32))')}), ' '), lambda w: w <> '')"
_BEGIN = lambda i: f"CAST(coalesce(len(x) >= {i} AND len(y) >= {i} AND (starts_with(x[{i}], y[{i}]) OR starts_with(y[{i}], x[{i}])), false) AS INTEGER)"
_STATUS = "contains(regexp_replace(replace(lower(coalesce(registration_status_raw, '')), 'ё', 'е'), '[^а-яa-z0-9]+', '', 'g'), 'безрегистрац')"
_ADDR = "CASE WHEN v = '' THEN 0.0::DOUBLE ELSE round(least(1.0, 0.5 + CASE WHEN contains(v, 'дом') THEN 0.2 ELSE 0 END + CASE WHEN contains(v, 'кв.') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(v, 'ул\\.|бульвар|пр-кт|пер\\.|ш\\.') THEN 0.1 ELSE 0 END)::DOUBLE, 4) END"
QUERIES = {
    "merged_parses": q_merged, "reconciled_people": q_reconciled, "registered_names": q_registered_names, "incomplete_names": q_incomplete, "name_similarity": q_similar, "merge_points": q_document_points, "preferred_documents": q_prefers, "name_noise": q_name_tokens,
    "person_trace": q_trace, "page1_trace": q_page1_trace, "unregistered_trace": q_unregistered_trace,
}
ORACLE = {
    "incomplete_names": f"SELECT resident_id, coalesce(length(full_name) - length(replace(full_name, ' ', '')) < 2 OR contains(full_name, '-'), true) AS incomplete FROM {_R}",
    "name_similarity": f"SELECT resident_id, tenant, CAST(CAST(coalesce(x[1] = y[1], false) AS INTEGER) + {_BEGIN(2)} + {_BEGIN(3)} AS BIGINT) AS alike FROM (SELECT resident_id, tenant, {_PARTS('full_name')} AS x, {_PARTS('tenant')} AS y FROM (SELECT * FROM {_R} WHERE full_name IS NOT NULL) JOIN (SELECT DISTINCT job_id, file_index, primary_tenant AS tenant FROM {current('page1_records')} WHERE primary_tenant IS NOT NULL) USING (job_id, file_index))",
    "page1_trace": f"SELECT page1_id, CASE WHEN coalesce(document_date, '') = '' THEN 0.0::DOUBLE WHEN length(document_date) = 10 AND substr(document_date, 3, 1) = '.' AND substr(document_date, 6, 1) = '.' THEN 1.0 ELSE 0.4 END AS document_date, {_ADDR} AS property_address, CASE WHEN coalesce(trim(settlement_type), '') = '' THEN 0.0::DOUBLE ELSE 0.95 END AS settlement_type, CASE WHEN coalesce(primary_tenant, '') <> '' THEN 'primary_tenant' END AS subject, CAST(coalesce(primary_tenant, '') <> '' AS BIGINT) AS n_subjects, CASE WHEN coalesce(primary_tenant, '') <> '' THEN 1.0::DOUBLE ELSE 0.0 END AS subject_confidence FROM (SELECT p.*, lower(coalesce(f, '')) AS v FROM {current('page1_records')} p LEFT JOIN (SELECT page1_id, max(full_address) AS f FROM {current('property_addresses')} GROUP BY page1_id) USING (page1_id))",
    "unregistered_trace": f"SELECT resident_id, full_name, birthday_date, 'without_registration' AS registration_status, registration_status_raw AS raw, CAST(page_number AS BIGINT) AS source_page FROM {_R} WHERE {_STATUS}",
}
