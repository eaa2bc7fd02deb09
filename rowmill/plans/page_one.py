"""Queries over page 1: streets, addresses, companies, tenancies, owners, documents, managed buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators import housing as H
from rowmill.operators.lines import clean_lines
from rowmill.operators.page1 import block
from rowmill.plans.sql import canon, current, ws
from rowmill.tables import current as cur

PARTS = ("street", "house", "building", "structure", "apartment")


def addresses(s, d):
    return cur(s, d, "property_addresses", "address_record_id", *PARTS, "full_address")


def lines(s, d):
    return cur(s, d, "ocr_pages", "page_id", "page_number", "text").filter("page_number = 1 AND text IS NOT NULL").select("page_id", clean_lines("text").alias("l"))


def q_streets(s, d):
    return addresses(s, d).filter("street IS NOT NULL").select("address_record_id", H.street(F.col("street")).alias("street"))


def q_composed(s, d):
    c = [F.col(p) for p in PARTS]
    return addresses(s, d).select("address_record_id", H.compose(*c).alias("address"), H.compose(H.public_street(c[0]), *c[1:], house_sign="дом № ").alias("public_address"))


def q_tokens(s, d):
    return addresses(s, d).select("address_record_id", *[H.token(F.col(p)).alias(p) for p in PARTS[1:]])


def q_street_lines(s, d):
    return addresses(s, d).filter("full_address IS NOT NULL").select("address_record_id", H.is_street_line(F.col("full_address")).alias("is_street_line"))


def q_page1_addresses(s, d):
    return lines(s, d).select("page_id", H.address(block(F.col("l"), "address")).alias("a")).select("page_id", "a.*")


def q_companies(s, d):
    return lines(s, d).select("page_id", H.company(block(F.col("l"), "company")).alias("c")).select("page_id", "c.*")


def q_company_names(s, d):
    return cur(s, d, "page1_records", "page1_id", "management_company").select("page1_id", H.company_name(F.col("management_company")).alias("company"))


def q_tenancies(s, d):
    k = F.col("settlement_type")
    return cur(s, d, "page1_records", "page1_id", "settlement_type").select("page1_id", H.rented(k).alias("rented"), H.social(k).alias("social"), H.private(k).alias("private"))


def q_owners(s, d):
    kind = T.ws(F.regexp_extract(F.array_join("l", "\n"), r"Вид заселения:[ \t]*([^\n]+)", 1))
    own = H.owners(block(F.col("l"), "owners"), kind, H.applicant(F.col("l")))
    return lines(s, d).select("page_id", F.posexplode_outer(own).alias("place", "o"), H.tenant(block(F.col("l"), "owners"), kind).alias("tenant"), H.applicant(F.col("l")).alias("applicant")).select("page_id", F.col("place").cast("long").alias("place"), "o.*", "tenant", "applicant")


def q_document_lines(s, d):
    own = F.filter(H.document_lines(block(F.col("l"), "documents")), lambda x: ~H.stops_documents(x))
    return lines(s, d).select("page_id", F.size(own).cast("long").alias("n_lines"), F.array_join(own, "|").alias("document_lines"))


def q_passport_lines(s, d):
    return lines(s, d).select("page_id", F.array_join(H.passport_lines(F.col("l")), "|").alias("passport_lines"))


def q_shares(s, d):
    x = F.explode(F.filter("l", lambda v: v.rlike("^\\d+(?:[,.]\\d{1,2})?$")))
    return lines(s, d).select("page_id", x.alias("written")).select("page_id", "written", H.share(F.col("written")).alias("share"))


def q_buildings(s, d):
    """Addresses with house and building as the list of buildings has them; the list: all buildings documented three times or more."""
    a = addresses(s, d)
    managed = a.filter("street IS NOT NULL AND house IS NOT NULL").groupBy("street", "house", "building").agg(F.count("*").alias("n")).filter("n >= 3").select("street", "house", "building")
    return H.resolve_buildings(a.filter("street IS NOT NULL").select("address_record_id", "street", "house", "building"), managed).select("address_record_id", "house", "building")


def q_building_keys(s, d):
    return addresses(s, d).filter("full_address IS NOT NULL").select("address_record_id", H.building_key(F.col("full_address")).alias("building_key"))


_A = current("property_addresses")
_PART = lambda sign, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '{sign}' || {c} END"
_LINE = lambda street, sign: "nullif(array_to_string(list_filter([" + ", ".join([f"nullif({street}, '')", _PART(sign, "house"), _PART("корп. ", "building"), _PART("строение ", "structure"), _PART("кв. ", "apartment")]) + "], lambda x: x IS NOT NULL), ', '), '')"
_PUBLIC = "CASE WHEN starts_with(street, 'б-р ') THEN substr(street, 5) || ' бульвар' WHEN starts_with(street, 'пр-кт ') THEN substr(street, 7) || ' пр-кт' ELSE street END"
_CLEAN = lambda c: f"regexp_replace(regexp_replace(trim({c}), '([0-9])A$', '\\1А'), '([0-9])a$', '\\1а')"
_TOKEN = lambda c: f"CASE WHEN regexp_full_match({_CLEAN(c)}, '_*') OR {canon(_CLEAN(c))} IN ('корп', 'строение', 'кв', 'дом') OR regexp_full_match({_CLEAN(c)}, '[^0-9]') THEN NULL ELSE {_CLEAN(c)} END AS {c}"
_KIND = canon("settlement_type")
_BKEY = "lower(full_address)"
for _x, _y in (("ё", "е"), ("бульвар", "б-р"), ("пр-д.", "пр-д"), ("пр-кт.", "пр-кт"), ("ул.", "ул"), ("д.", "д"), ("к.", "к")):
    _BKEY = f"replace({_BKEY}, '{_x}', '{_y}')"
QUERIES = {
    "street_forms": q_streets, "composed_addresses": q_composed, "address_tokens": q_tokens, "street_lines": q_street_lines, "page1_addresses": q_page1_addresses, "companies": q_companies, "company_names": q_company_names, "tenancies": q_tenancies, "owner_shares": q_owners,
    "document_lines": q_document_lines, "passport_lines": q_passport_lines, "share_texts": q_shares, "managed_buildings": q_buildings, "building_keys": q_building_keys,
}
ORACLE = {
    "composed_addresses": f"SELECT address_record_id, {_LINE('street', 'дом ')} AS address, {_LINE(f'({_PUBLIC})', 'дом № ')} AS public_address FROM {_A}",
    "address_tokens": f"SELECT address_record_id, {', '.join(_TOKEN(c) for c in PARTS[1:])} FROM {_A}",
    "tenancies": f"SELECT page1_id, regexp_matches({_KIND}, '{'|'.join(H.TENANCIES)}') AS rented, regexp_matches({_KIND}, 'социальный на[ей]м') AS social, {_KIND} = 'частная собственность' AS private FROM {current('page1_records')}",
    "building_keys": f"SELECT address_record_id, {ws(f'''regexp_replace({_BKEY}, '[^0-9a-zа-я\\s-]+', ' ', 'g')''')} AS building_key FROM {_A} WHERE full_address IS NOT NULL",
}
