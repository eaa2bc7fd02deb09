"""Queries over persons, names, lookups and published structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators import matching as M
from rowmill.operators import persons as P
from rowmill.operators.lines import join_continuations
from rowmill.plans.p1 import KEYS, TABLES, nodes
from rowmill.operators.nested import node_table
from rowmill.plans.sql import canon, current, ws
from rowmill.tables import current as cur
from rowmill.tables import table

BY = ["job_id", "file_index"]


def residents(s, d):
    return cur(s, d, "residents", "resident_id", "job_id", "file_index", "person_pos", "full_name", "birthday_date", "document_id", "registration_kind", "registration_status_raw")


def q_name_score(s, d):
    return residents(s, d).select("resident_id", P.name_score(F.col("full_name")).cast("long").alias("score"), P.suspicious(F.col("full_name")).alias("suspicious"))


def parsed(s, d):
    """Residents with what their document's cell gave."""
    return residents(s, d).join(cur(s, d, "identity_documents", "document_id", "raw", "number"), "document_id", "left")


def q_parse_score(s, d):
    return P.parse_score(parsed(s, d), BY)


def q_method(s, d):
    """Two readings of the residents' table: as it is, and with look-alike letters put right."""
    r = parsed(s, d)
    return P.better_parse(r, r.withColumn("full_name", T.cyrillic_lookalikes("full_name")), BY)


def q_registration(s, d):
    return residents(s, d).select("resident_id", P.registration_status(F.col("registration_status_raw")).alias("status"))


def q_anti(s, d):
    r = residents(s, d).withColumn("status", P.registration_status(F.col("registration_status_raw")))
    out = r.filter("status = 'without_registration'").select("resident_id")
    return r.join(out, "resident_id", "left_anti").groupBy(*BY).agg(F.count("*").alias("n_persons"))


def q_semi(s, d):
    docs = cur(s, d, "identity_documents", "document_id", "number").filter("number IS NOT NULL").select("document_id")
    return residents(s, d).join(docs, "document_id", "left_semi").select("resident_id")


def tenants(s, d):
    return cur(s, d, "page1_records", "page1_id", "job_id", "file_index", "primary_tenant").filter("primary_tenant IS NOT NULL")


def q_complete(s, d):
    people = residents(s, d).filter("full_name IS NOT NULL").select(*BY, "resident_id", "full_name")
    return P.complete_names(people, tenants(s, d).select(*BY, F.col("primary_tenant").alias("candidate")).distinct(), BY).filter("matched IS NOT NULL").select("resident_id", "matched")


def q_unused(s, d):
    people = residents(s, d).filter("full_name IS NOT NULL").select(*BY, "resident_id", "full_name")
    c = tenants(s, d).select(*BY, F.col("primary_tenant").alias("candidate")).distinct()
    return P.unused(c, P.complete_names(people, c, BY), BY)


def q_dictionary(s, d):
    entries = table(s, d, "ref_entries").filter("field_name = 'district'").select("canonical_name")
    return M.longest_containment(table(s, d, "documents").filter("text IS NOT NULL"), "doc_id", "text", entries, "canonical_name")


def q_alias(s, d):
    okrugs = table(s, d, "ref_entries").filter("field_name = 'administrative_okrug'")
    alias = okrugs.select(F.col("canonical_name").alias("alias"), F.col("ref_id").cast("string").alias("prefix"), F.lit(3).alias("weight"))
    place = table(s, d, "ref_entries").filter("field_name = 'district'").select(F.col("canonical_name").alias("alias"), F.col("parent_ref_id").cast("string").alias("prefix"), F.lit(1).alias("weight"))
    pages = cur(s, d, "ocr_pages", "page_id", "text").filter("text IS NOT NULL")
    return M.alias_weights(pages, "page_id", "text", alias.unionByName(place)).withColumn("weight", F.col("weight").cast("long"))


def q_unique(s, d):
    """Parts of the next size of each brand: of that brand and size, else the only part of that size."""
    ref = table(s, d, "part").select("p_brand", "p_size", "p_partkey")
    rows = ref.select("p_brand", (F.col("p_size") + 1).alias("p_size")).distinct()
    return M.exact_or_unique(rows, ref, ["p_brand", "p_size"], "p_size", "p_partkey")


def q_offices(s, d):
    o = table(s, d, "ref_offices").select("office_code", "okrug_ref_id")
    names = table(s, d, "ref_entries").select(F.col("ref_id").alias("okrug_ref_id"), "canonical_name")
    p = cur(s, d, "page1_records", "page1_id", "office_code")
    return p.join(M.small(o), "office_code", "left").join(M.small(names), "okrug_ref_id", "left").groupBy("canonical_name").agg(F.count("*").alias("n"))


def q_zip(s, d):
    n = residents(s, d).groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("person_pos", "resident_id", "full_name"))).alias("a"), F.sort_array(F.collect_list(F.struct("person_pos", "resident_id", "birthday_date"))).alias("b"))
    z = F.posexplode(F.zip_with("a", "b", lambda x, y: F.struct(x["full_name"].alias("full_name"), y["birthday_date"].alias("birthday_date"))))
    return n.select(*BY, z.alias("place", "z")).select(*BY, F.col("place").cast("long").alias("place"), "z.full_name", "z.birthday_date")


def q_continued(s, d):
    lines = cur(s, d, "identity_documents", "document_id", "raw").filter("raw IS NOT NULL").select("document_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    return join_continuations(lines, ["document_id"], "line_no", "line", F.col("line").rlike("^[А-ЯЁA-Z0-9п]") | (F.col("line_no") == 0)).select("document_id", F.col("line_no").cast("long").alias("line_no"), "line", "n_parts")


def q_roles(s, d):
    n = nodes(s, d)
    owners = node_table(n, KEYS, "owner", TABLES["owner"][1], "page_1").select(*KEYS, F.col("place").alias("seq"), F.coalesce("full_name", "value").alias("full_name"))
    t = tenants(s, d).select(*BY, F.col("primary_tenant").alias("full_name"))
    r = residents(s, d).select(*BY, "registration_kind", F.col("person_pos").alias("seq"), "full_name")
    return P.roles(owners, t, r).filter("full_name IS NOT NULL")


def q_public(s, d):
    doc = cur(s, d, "identity_documents", "document_id", "document_type", "series", "number", "issue_date")
    p = residents(s, d).join(doc, "document_id", "left")
    person = F.struct(T.ws("full_name").alias("full_name"), "birthday_date", F.struct("document_type", "series", "number", "issue_date").alias("passport"))
    packed = p.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("person_pos", "resident_id", person.alias("p")))).alias("ps"))
    js = packed.select(*BY, F.to_json(F.struct(F.size("ps").alias("count"), F.transform("ps", lambda x: x["p"]).alias("persons"))).alias("j"))
    back = "count int, persons array<struct<full_name string, birthday_date string, passport struct<document_type string, series string, number string, issue_date string>>>"
    return js.select(*BY, F.from_json("j", back).alias("b")).select(*BY, F.col("b.count").cast("long").alias("n_persons"), F.size(F.filter("b.persons", lambda x: x["passport"]["number"].isNotNull())).cast("long").alias("n_numbers"), F.array_join(F.transform("b.persons", lambda x: F.coalesce(x["full_name"], F.lit("-"))), "|").alias("names"))


_R = current("residents")
_W = f"list_filter(string_split({ws('coalesce(full_name, ' + chr(39) * 2 + ')')}, ' '), lambda t: t <> '')"
_SCORED = f"""s AS (SELECT *, CASE WHEN coalesce(full_name, '') = '' THEN -20 ELSE (CASE WHEN len(w) = 3 THEN 12 WHEN len(w) = 2 THEN 4 WHEN len(w) > 3 THEN -6 ELSE 0 END) +
   coalesce(list_sum(list_transform(w, lambda t: (CASE WHEN t IN ('Российская','Федерация','Документ','Россия','Узбекистан','Украина','Москва','Ташкент','Анджелес','Штат','Калифорния','Татарская','Нурлат','Ворошиловград','Алтайского','Барнаул','заявитель') THEN -14 ELSE 0 END) + (CASE WHEN NOT regexp_matches(t, '^[A-ZА-ЯЁ]') THEN -3 ELSE 0 END) + (CASE WHEN length(trim(t, '-')) < 2 THEN -4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[A-Za-z]') THEN -10 ELSE 0 END))), 0) END AS sc,
   len(w) <> 3 OR len(list_filter(w, lambda t: t IN ('Российская','Федерация','Россия','Узбекистан','Украина','Москва','Ташкент','Анджелес','Штат','Калифорния','Татарская','Нурлат','Ворошиловград','Алтайского','Барнаул','заявитель') OR regexp_matches(t, '[A-Za-z]'))) > 0 AS sus FROM (SELECT * EXCLUDE (rdoc), {_W} AS w FROM (SELECT * REPLACE (%NAME% AS full_name) FROM {_R}) r LEFT JOIN (SELECT document_id AS rdoc, raw, number FROM {current('identity_documents')}) ON rdoc = document_id))"""
_LOOK = f"CASE WHEN regexp_matches(full_name, '[A-Za-z]') AND regexp_matches(full_name, '[А-Яа-яЁё]') THEN translate(full_name, '{T.LATIN}', '{T.CYRILLIC}') ELSE full_name END"
_READ, _SECOND = _SCORED.replace("%NAME%", "full_name"), _SCORED.replace("%NAME%", _LOOK).replace("s AS", "s2 AS", 1)
_ONE = "CAST(sum(20 + sc + CASE WHEN regexp_full_match(birthday_date, '\\d{2}\\.\\d{2}\\.\\d{4}') THEN 5 ELSE 0 END + CASE WHEN coalesce(raw, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(number, '') <> '' THEN 3 ELSE 0 END) AS BIGINT) AS score, count(*) FILTER (WHERE sus) AS n_suspicious"
_STATUS = "CASE WHEN contains(regexp_replace(replace(lower(coalesce(registration_status_raw, '')), 'ё', 'е'), '[^а-яa-z0-9]+', '', 'g'), 'безрегистрац') THEN 'without_registration' ELSE 'registered' END"
_TEN = f"(SELECT DISTINCT job_id, file_index, primary_tenant AS candidate FROM {current('page1_records')} WHERE primary_tenant IS NOT NULL)"
_NAME = lambda c: f"list_filter(string_split(lower({ws(f'replace({c}, chr(45), chr(32))')}), ' '), lambda w: w <> '')"
_AS = lambda i: f"(len(x) >= {i} AND len(y) >= {i} AND (starts_with(x[{i}], y[{i}]) OR starts_with(y[{i}], x[{i}])))"
_ALIKE = f"""m AS (SELECT r.job_id, r.file_index, resident_id, full_name, candidate, x, CASE WHEN len(y) >= 2 AND list_contains(x, y[1]) THEN 1 + CAST({_AS(2)} AS INTEGER) + CAST({_AS(3)} AS INTEGER) ELSE 0 END AS n
   FROM (SELECT *, {_NAME('full_name')} AS x FROM {_R} WHERE full_name IS NOT NULL) r JOIN (SELECT *, {_NAME('candidate')} AS y FROM {_TEN}) c ON r.job_id = c.job_id AND r.file_index = c.file_index),
  k AS (SELECT job_id, file_index, resident_id, candidate AS matched FROM m WHERE len(x) >= 3 AND n >= 3 OR len(x) = 2 AND n >= 2 OR n = 1 AND (length(full_name) - length(replace(full_name, ' ', '')) < 2 OR contains(full_name, '-')))"""
_HELD = "contains(' ' || t || ' ', ' ' || e || ' ')"
QUERIES = {
    "name_scores": q_name_score, "parse_scores": q_parse_score, "method_choice": q_method, "registration_status": q_registration, "anti_unregistered": q_anti, "semi_documents": q_semi, "complete_names": q_complete, "unused_candidates": q_unused,
    "dictionary_match": q_dictionary, "alias_weights": q_alias, "unique_lookup": q_unique, "office_okrugs": q_offices, "positional_zip": q_zip, "continued_lines": q_continued, "union_roles": q_roles, "public_struct": q_public,
}
ORACLE = {
    "name_scores": f"WITH {_READ} SELECT resident_id, CAST(sc AS BIGINT) AS score, sus AS suspicious FROM s",
    "parse_scores": f"WITH {_READ} SELECT job_id, file_index, {_ONE} FROM s GROUP BY ALL",
    "method_choice": f"WITH {_READ}, {_SECOND}, a AS (SELECT job_id, file_index, {_ONE} FROM s GROUP BY ALL), b AS (SELECT job_id, file_index, {_ONE} FROM s2 GROUP BY ALL) SELECT job_id, file_index, CASE WHEN NOT a.n_suspicious < b.n_suspicious AND b.score > a.score THEN 'fallback' ELSE 'primary' END AS method FROM a JOIN b USING (job_id, file_index)",
    "registration_status": f"SELECT resident_id, {_STATUS} AS status FROM {_R}",
    "anti_unregistered": f"SELECT job_id, file_index, count(*) AS n_persons FROM {_R} WHERE {_STATUS} = 'registered' GROUP BY ALL",
    "semi_documents": f"SELECT resident_id FROM {_R} WHERE document_id IN (SELECT document_id FROM identity_documents WHERE number IS NOT NULL)",
    "complete_names": f"WITH {_ALIKE} SELECT resident_id, matched FROM k",
    "unused_candidates": f"WITH {_ALIKE} SELECT job_id, file_index, candidate FROM {_TEN} c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.job_id = c.job_id AND k.file_index = c.file_index AND k.matched = c.candidate)",
    "dictionary_match": f"SELECT doc_id, arg_min(canonical_name, {{'a': -length(e), 'b': e}}) AS canonical_name FROM (SELECT doc_id, {canon('text')} AS t FROM documents WHERE text IS NOT NULL) JOIN (SELECT canonical_name, {canon('canonical_name')} AS e FROM ref_entries WHERE field_name = 'district') ON {_HELD} GROUP BY doc_id",
    "alias_weights": f"SELECT page_id, prefix, CAST(max(weight) AS BIGINT) AS weight FROM (SELECT page_id, {canon('text')} AS t FROM {current('ocr_pages')} WHERE text IS NOT NULL) JOIN (SELECT {canon('alias')} AS e, prefix, weight FROM (SELECT canonical_name AS alias, CAST(ref_id AS VARCHAR) AS prefix, 3 AS weight FROM ref_entries WHERE field_name = 'administrative_okrug' UNION ALL SELECT canonical_name, CAST(parent_ref_id AS VARCHAR), 1 FROM ref_entries WHERE field_name = 'district')) ON {_HELD} GROUP BY ALL",
    "unique_lookup": "WITH w AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY ALL), o AS (SELECT p_size, min(p_partkey) AS k FROM part GROUP BY ALL HAVING min(p_partkey) = max(p_partkey)) SELECT p.p_brand, p.p_size, coalesce(w.k, o.k) AS p_partkey FROM (SELECT DISTINCT p_brand, p_size + 1 AS p_size FROM part) p LEFT JOIN w ON p.p_brand = w.p_brand AND p.p_size = w.p_size LEFT JOIN o ON p.p_size = o.p_size",
    "office_okrugs": f"SELECT canonical_name, count(*) AS n FROM {current('page1_records')} p LEFT JOIN ref_offices o USING (office_code) LEFT JOIN ref_entries e ON e.ref_id = o.okrug_ref_id GROUP BY ALL",
    "positional_zip": f"SELECT job_id, file_index, row_number() OVER (PARTITION BY job_id, file_index ORDER BY person_pos, resident_id) - 1 AS place, full_name, birthday_date FROM {_R}",
    "continued_lines": f"WITH e AS (SELECT document_id, CAST(unnest(range(len(a))) AS BIGINT) AS line_no, unnest(a) AS line FROM (SELECT document_id, string_split(raw, chr(10)) AS a FROM {current('identity_documents')} WHERE raw IS NOT NULL)), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[А-ЯЁA-Z0-9п]') OR line_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no) AS g FROM e) SELECT document_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line, count(*) AS n_parts FROM g GROUP BY document_id, g",
    "public_struct": f"SELECT job_id, file_index, count(*) AS n_persons, count(number) AS n_numbers, string_agg(coalesce({ws('full_name')}, '-'), '|' ORDER BY person_pos, resident_id) AS names FROM {_R} r LEFT JOIN (SELECT document_id, number FROM {current('identity_documents')}) USING (document_id) GROUP BY ALL",
}
