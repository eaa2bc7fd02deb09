"""Queries of the scalar functions over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.plans.sql import canon, clean_lines, current, ws
from rowmill.operators.lines import clean_lines as lines_of
from rowmill.operators.lines import keep_first, records, slice_between
from rowmill.tables import current as cur
from rowmill.tables import table


def q_ws(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.ws("text")).alias("squeezed"))


def q_canon(s, d):
    return cur(s, d, "identity_documents", "document_id", "issued_by").select("document_id", T.canon("issued_by").alias("issuer_key"))


def q_lookalikes(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").select("resident_id", T.cyrillic_lookalikes("full_name").alias("full_name"))


def q_decimal(s, d):
    v = F.explode(F.regexp_extract_all("text", F.lit(r"(\d+,\d+) кв"), F.lit(1)))
    return table(s, d, "documents").select("doc_id", v.alias("area")).select("doc_id", "area", T.decimal_text("area").alias("area_text"))


def q_phone(s, d):
    v = F.explode(F.regexp_extract_all("text", F.lit(r"(\+7[0-9 ().-]{10,16}[0-9])"), F.lit(1)))
    return table(s, d, "documents").select("doc_id", v.alias("written")).select("doc_id", "written", T.phone("written").alias("phone"))


def q_file_name(s, d):
    return cur(s, d, "job_files", "job_id", "file_index", "filename").select("job_id", "file_index", F.format_string("%03d_%s", "file_index", T.file_name("filename")).alias("saved_as"))


def q_saved_name(s, d):
    v = q_file_name(s, d)
    return v.select("job_id", "file_index", F.regexp_extract("saved_as", r"^(\d{3})_", 1).cast("int").alias("parsed_index"), F.regexp_extract("saved_as", r"^\d{3}_(.*)$", 1).alias("parsed_name"))


def q_latest_date(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.dates_in("text")).cast("long").alias("n_dates"), F.date_format(T.latest_date("text"), "yyyy-MM-dd").alias("latest_date"))


def q_partial_dates(s, d):
    return table(s, d, "registry_persons").select("registry_id", T.partial_date("birth_date").alias("birth_date"))


def q_ocr_dates(s, d):
    return cur(s, d, "page1_records", "page1_id", "document_date").select("page1_id", T.ocr_date(F.translate("document_date", "015", "OIS")).alias("document_date"))


def q_check_digit(s, d):
    n = F.explode(F.regexp_extract_all("text", F.lit(r"акта (\d{21}) "), F.lit(1)))
    return table(s, d, "documents").select("doc_id", n.alias("act")).select("doc_id", "act", T.check_digit(F.substring("act", 1, 20)).alias("expected"), (T.check_digit(F.substring("act", 1, 20)) == F.substring("act", 21, 1).cast("int")).alias("holds"))


def q_name_split(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").filter("full_name IS NOT NULL").select("resident_id", T.name_parts("full_name").alias("p")).select("resident_id", "p.*")


def q_title_case(s, d):
    return cur(s, d, "page1_records", "page1_id", "district").filter("district IS NOT NULL").select("page1_id", T.title_case("district").alias("district"))


def q_merge_hyphens(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").filter("full_name IS NOT NULL").select("resident_id", T.merge_hyphens("full_name").alias("full_name"))


LITERALS = [("гор. ", "город "), ("р-ну", "району"), ("р-на", "района"), ("Отд.", "Отдел"), ("внутр.", "внутренних")]
PATTERNS = [(r"О\.? ?В\.? ?Д\.?", "Отдел внутренних дел"), (r"г\. ?([А-Я])", "город $1"), (r" +", " "), (r" код [0-9]+$", "")]
FAMILIES = [(["отделение", "миграц"], "migration"), (["паспортн", "стол"], "passport_desk"), (["внутр", "дел"], "police"), (["овд"], "police"), (["о.в.д"], "police"), (["ому"], "migration"), (["п/с"], "passport_desk")]


def issuers(s, d):
    return cur(s, d, "identity_documents", "document_id", "issued_by").filter("issued_by IS NOT NULL")


def q_rules_literal(s, d):
    return issuers(s, d).select("document_id", T.apply_literals(F.col("issued_by"), LITERALS).alias("issued_by"))


def q_rules_pattern(s, d):
    return issuers(s, d).select("document_id", T.apply_patterns(F.col("issued_by"), PATTERNS).alias("issued_by"))


def q_rules_contains(s, d):
    return issuers(s, d).select("document_id", T.apply_contains_all(F.col("issued_by"), FAMILIES).alias("family"))


def q_confidence_names(s, d):
    return cur(s, d, "residents", "resident_id", "full_name").select("resident_id", T.name_confidence("full_name").alias("confidence"))


def q_confidence_addresses(s, d):
    return cur(s, d, "property_addresses", "address_record_id", "full_address").select("address_record_id", T.address_confidence("full_address").alias("confidence"))


def q_confidence_documents(s, d):
    x = cur(s, d, "identity_documents", "document_id", "document_type", "series", "number", "issued_by", "issue_date", "raw")
    return x.select("document_id", T.document_confidence(*[F.col(c) for c in ("document_type", "series", "number", "issued_by", "issue_date", "raw")]).alias("confidence"))


def q_confidence_fields(s, d):
    x = cur(s, d, "page1_records", "page1_id", "document_date", "settlement_type", "management_company")
    return x.select("page1_id", T.date_confidence("document_date").alias("date_confidence"), T.enum_confidence("settlement_type").alias("type_confidence"), T.text_confidence("management_company").alias("company_confidence"))


def page_lines(s, d):
    return cur(s, d, "ocr_pages", "page_id", "text").filter("text IS NOT NULL").select(F.col("page_id").alias("doc_id"), lines_of("text").alias("lines"))


def q_clean_lines(s, d):
    return page_lines(s, d).select("doc_id", F.posexplode("lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


START, END = "^Ф\\. И\\. О\\.", "^(Организация|на основании)"


def q_marker_slice(s, d):
    cut = slice_between(F.col("lines"), START, END)
    return page_lines(s, d).select("doc_id", F.size(cut).cast("long").alias("n_lines"), F.array_join(cut, "|").alias("block"))


def q_records(s, d):
    return records(q_clean_lines(s, d), "^[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ \\d").withColumn("record_no", F.col("record_no").cast("long"))


def q_keep_first(s, d):
    return keep_first(q_clean_lines(s, d), ["doc_id"], T.canon("line"), "line_no")


_LINES = f"l AS (SELECT page_id AS doc_id, {clean_lines('text')} AS lines FROM {current('ocr_pages')} WHERE text IS NOT NULL), e AS (SELECT doc_id, CAST(unnest(range(len(lines))) AS BIGINT) AS line_no, unnest(lines) AS line FROM l)"


def _fold(x, rules, f):
    for a, b in rules:
        x = f(x, a, b)
    return x


def _digit(n: str, k: int) -> str:
    return "CAST(((10 - (" + " + ".join(f"(CASE WHEN CAST(substr({n},{i},1) AS INTEGER)*{2 - i % 2} > 9 THEN CAST(substr({n},{i},1) AS INTEGER)*{2 - i % 2} - 9 ELSE CAST(substr({n},{i},1) AS INTEGER)*{2 - i % 2} END)" for i in range(1, k + 1)) + ") % 10) % 10) AS INTEGER)"


_TOK = f"list_filter(list_transform(string_split({ws('full_name')}, ' '), lambda t: trim(t, ' ,.;:()[]{{}}\"''')), lambda t: t <> '')"
_ANY = lambda cond: f"len(list_filter(t, lambda a: {cond})) > 0"


def _score(start, parts):
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {start}::DOUBLE + " + " + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v in parts) + ")), 4)"


_HAS = lambda c: f"coalesce({c}, '') <> ''"
_DOC = ("document_type", "series", "number", "issued_by", "issue_date")
_NO = "('Российская', 'Федерация', 'Документ')"
QUERIES = {
    "ws_normalize": q_ws, "canonical_key": q_canon, "name_lookalikes": q_lookalikes, "decimal_text": q_decimal, "phone_text": q_phone, "file_name": q_file_name, "saved_name": q_saved_name, "latest_valid_date": q_latest_date, "partial_dates": q_partial_dates,
    "ocr_dates": q_ocr_dates, "check_digit": q_check_digit, "name_split": q_name_split, "title_case": q_title_case, "merge_hyphens": q_merge_hyphens, "rules_literal": q_rules_literal, "rules_pattern": q_rules_pattern, "rules_contains_all": q_rules_contains,
    "confidence_names": q_confidence_names, "confidence_addresses": q_confidence_addresses, "confidence_documents": q_confidence_documents, "confidence_fields": q_confidence_fields, "clean_lines": q_clean_lines, "marker_slice": q_marker_slice, "record_split": q_records, "keep_first": q_keep_first,
}
_SAVED = f"SELECT job_id, file_index, printf('%03d_%s', file_index, coalesce(nullif(trim(regexp_replace(coalesce(filename, ''), '[^0-9A-Za-zА-Яа-яЁё._ -]+', '_', 'g')), ''), 'document.pdf')) AS saved_as FROM {current('job_files')}"
_PD = "replace(replace(trim(birth_date), '/', '.'), '-', '.')"
_P = lambda i: f"regexp_extract({_PD}, '^(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{2}}|\\d{{4}})$', {i})"
_OD = "regexp_replace(translate(upper(translate(document_date, '015', 'OIS')), 'OОILZSBЗ', '00117583'), '\\D', '', 'g')"
ORACLE = {
    "ws_normalize": f"SELECT doc_id, md5({ws('text')}) AS squeezed FROM documents",
    "canonical_key": f"SELECT document_id, {canon('issued_by')} AS issuer_key FROM {current('identity_documents')}",
    "name_lookalikes": f"SELECT resident_id, CASE WHEN regexp_matches(full_name, '[A-Za-z]') AND regexp_matches(full_name, '[А-Яа-яЁё]') THEN translate(full_name, '{T.LATIN}', '{T.CYRILLIC}') ELSE full_name END AS full_name FROM {current('residents')}",
    "decimal_text": "SELECT doc_id, area, split_part(area, ',', 1) || '.' || rpad(substr(split_part(area, ',', 2), 1, 2), 2, '0') AS area_text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(\\d+,\\d+) кв', 1)) AS area FROM documents)",
    "phone_text": "SELECT doc_id, written, CASE WHEN regexp_full_match(d, '7\\d{10}') THEN '+7(' || substr(d,2,3) || ')' || substr(d,5,3) || '-' || substr(d,8,2) || '-' || substr(d,10,2) ELSE written END AS phone FROM (SELECT *, regexp_replace(written, '\\D', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(\\+7[0-9 ().-]{10,16}[0-9])', 1)) AS written FROM documents))",
    "file_name": _SAVED,
    "saved_name": f"SELECT job_id, file_index, CAST(regexp_extract(saved_as, '^(\\d{{3}})_', 1) AS INTEGER) AS parsed_index, regexp_extract(saved_as, '^\\d{{3}}_(.*)$', 1) AS parsed_name FROM ({_SAVED})",
    "latest_valid_date": "SELECT doc_id, CAST(len(x) AS BIGINT) AS n_dates, strftime(list_max(list_transform(x, lambda v: CAST(try_strptime(v, '%d.%m.%Y') AS DATE))), '%Y-%m-%d') AS latest_date FROM (SELECT doc_id, regexp_extract_all(text, '\\d{2}\\.\\d{2}\\.\\d{4}') AS x FROM documents WHERE text IS NOT NULL)",
    "partial_dates": f"SELECT registry_id, CASE WHEN {_P(1)} <> '' THEN lpad({_P(1)}, 2, '0') || '.' || lpad({_P(2)}, 2, '0') || '.' || CASE WHEN length({_P(3)}) = 4 THEN {_P(3)} WHEN {_P(3)} > '30' THEN '19' || {_P(3)} ELSE '20' || {_P(3)} END END AS birth_date FROM registry_persons",
    "ocr_dates": f"SELECT page1_id, CASE WHEN regexp_full_match({_OD}, '\\d{{8}}') AND substr({_OD},1,2) BETWEEN '01' AND '31' AND substr({_OD},3,2) BETWEEN '01' AND '12' AND substr({_OD},5,4) BETWEEN '2000' AND '2099' THEN substr({_OD},1,2) || '.' || substr({_OD},3,2) || '.' || substr({_OD},5,4) END AS document_date FROM {current('page1_records')}",
    "check_digit": f"SELECT doc_id, act, {_digit('act', 20)} AS expected, {_digit('act', 20)} = CAST(substr(act, 21, 1) AS INTEGER) AS holds FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'акта (\\d{{21}}) ', 1)) AS act FROM documents)",
    "name_split": f"SELECT resident_id, nullif(w[1], '') AS last_name, w[2] AS first_name, nullif(array_to_string(w[3:], ' '), '') AS middle_name FROM (SELECT resident_id, string_split({ws('full_name')}, ' ') AS w FROM {current('residents')} WHERE full_name IS NOT NULL)",
    "title_case": f"SELECT page1_id, array_to_string(list_transform(regexp_extract_all(lower(district), '[^a-zа-яё]+|[a-zа-яё]+'), lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '') AS district FROM {current('page1_records')} WHERE district IS NOT NULL",
    "rules_literal": f"SELECT document_id, {_fold('issued_by', LITERALS, lambda x, a, b: f'''replace({x}, '{a}', '{b}')''')} AS issued_by FROM {current('identity_documents')} WHERE issued_by IS NOT NULL",
    "rules_pattern": f"SELECT document_id, {_fold('issued_by', [(a, b.replace('$1', chr(92) + '1')) for a, b in PATTERNS], lambda x, a, b: f'''regexp_replace({x}, '{a}', '{b}', 'g')''')} AS issued_by FROM {current('identity_documents')} WHERE issued_by IS NOT NULL",
    "rules_contains_all": "SELECT document_id, CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(issued_by), '{p}')" for p in ps) + f" THEN '{v}'" for ps, v in FAMILIES) + f" END AS family FROM {current('identity_documents')} WHERE issued_by IS NOT NULL",
    "confidence_names": f"SELECT resident_id, CASE WHEN full_name IS NULL OR len(t) = 0 THEN 0.0::DOUBLE ELSE " + _score(0.5, [("len(t) >= 2", 0.15), ("len(t) >= 3", 0.2), (f"NOT {_ANY('NOT regexp_matches(a, ' + chr(39) + '[A-Za-zА-Яа-яЁё]' + chr(39) + ')')}", 0.1), (f"NOT {_ANY('regexp_matches(a, ' + chr(39) + '[0-9]' + chr(39) + ')')}", 0.05), (_ANY(f"a IN {_NO}"), -0.25), (_ANY("length(a) <= 1"), -0.15), ("ends_with(rtrim(full_name), '-')", -0.1)]) + f" END AS confidence FROM (SELECT *, {_TOK} AS t FROM {current('residents')})",
    "confidence_addresses": "SELECT address_record_id, CASE WHEN v = '' THEN 0.0::DOUBLE ELSE " + _score(0.5, [("contains(v, 'дом')", 0.2), ("contains(v, 'кв.')", 0.15), (" OR ".join(f"contains(v, '{p}')" for p in ("ул.", "бульвар", "пр-кт", "пер.", "ш.")), 0.1)]) + f" END AS confidence FROM (SELECT address_record_id, lower(coalesce(full_address, '')) AS v FROM {current('property_addresses')})",
    "confidence_documents": "SELECT document_id, CASE WHEN " + " OR ".join(_HAS(c) for c in (*_DOC, "raw")) + " THEN " + _score(0.25, [*[(_HAS(c), 0.15) for c in _DOC], (f"len(string_split({ws('trim(coalesce(raw, ' + chr(39) * 2 + '))')}, ' ')) >= 2", 0.05), ("lower(trim(coalesce(raw, ''))) IN ('паспорт', 'паспорт рф', 'справка', 'свидетельство о рождении') AND NOT (" + " OR ".join(_HAS(c) for c in _DOC[1:]) + ")", -0.15)]) + f" ELSE 0.0::DOUBLE END AS confidence FROM {current('identity_documents')}",
    "confidence_fields": "SELECT page1_id, CASE WHEN coalesce(document_date, '') = '' THEN 0.0::DOUBLE WHEN length(document_date) = 10 AND substr(document_date, 3, 1) = '.' AND substr(document_date, 6, 1) = '.' THEN 1.0 ELSE 0.4 END AS date_confidence, CASE WHEN coalesce(trim(settlement_type), '') = '' THEN 0.0::DOUBLE ELSE 0.95 END AS type_confidence, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE " + _score(0.5, [("len(t) >= 3", 0.2), (_ANY("regexp_matches(a, '^[A-ZА-ЯЁ]')"), 0.1), ("regexp_matches(management_company, '[0-9]')", 0.1), (_ANY(f"a IN {_NO}"), -0.2)]) + f" END AS company_confidence FROM (SELECT *, list_filter(string_split({ws('coalesce(management_company, ' + chr(39) * 2 + ')')}, ' '), lambda a: a <> '') AS t FROM {current('page1_records')})",
    "clean_lines": f"WITH {_LINES} SELECT * FROM e",
    "marker_slice": f"""WITH {_LINES}, m AS (SELECT doc_id, coalesce(max(line_no) FILTER (WHERE regexp_matches(line, '{START}')), -1) AS a FROM e GROUP BY doc_id),
      z AS (SELECT m.doc_id, a, min(line_no) FILTER (WHERE regexp_matches(line, '{END}') AND line_no > a) AS b FROM m JOIN e USING (doc_id) GROUP BY ALL)
      SELECT z.doc_id, count(e.line) AS n_lines, coalesce(string_agg(e.line, '|' ORDER BY e.line_no), '') AS block FROM z LEFT JOIN e ON e.doc_id = z.doc_id AND e.line_no > a AND e.line_no < coalesce(b, 1000000) GROUP BY z.doc_id""",
    "record_split": f"WITH {_LINES}, r AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS record_no FROM e) SELECT doc_id, record_no, string_agg(line, ' ' ORDER BY line_no) AS record_text, count(*) AS n_lines FROM r WHERE record_no > 0 GROUP BY ALL",
    "keep_first": f"WITH {_LINES} SELECT doc_id, line_no, line FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, {canon('line')} ORDER BY line_no) = 1",
}
