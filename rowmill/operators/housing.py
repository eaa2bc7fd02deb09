"""Page 1 beyond its labels: streets and addresses in one form, the managing company, the
applicant and their document, kinds of tenancy, lines of ownership documents, and the lookup
of a building in the list of managed ones. Expressions over columns, one join for the lookup."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import apply_literals, apply_patterns, canon, cyrillic_lookalikes, decimal_text, let, phone, ws
from rowmill.operators.identity import blank, has

# Spellings of a street's type after and before its name, and the type as it is written in front.
STREET_TYPES = [
    ("ул(?:ица)?\\.?", "ул(?:ица)?\\.?", "ул."), ("пр(?:-?кт|осп(?:ект)?)\\.?", "пр(?:-?кт|осп(?:ект)?)\\.?", "пр-кт"), ("бульвар\\.?", "б-р", "б-р"), ("пер(?:еулок)?\\.?", "пер(?:еулок)?\\.?", "пер."), ("шоссе\\.?", "ш(?:оссе)?\\.?", "ш."), ("проезд\\.?", "пр(?:оезд)?\\.?", "пр."),
]
# Misread signs of addresses, and the signs.
ADDRESS_SIGNS = [("(?iuU)\\b[uU][лЛ]\\.?", "ул. "), ("(?iuU)\\bul\\.", "ул. "), ("(?uU)\\b[KК][BВ]\\.?\\s*", "кв. "), ("(?iuU)\\b(\\d{6})\\s+г(?![\\wа-яё])", "$1")]
ADDRESS_WORDS = [("дом.", "дом"), ("дом №", "дом "), ("дом Ng", "дом "), ("дом No", "дом "), ("кор.", "корп."), ("кор:", "корп. "), ("ул:", "ул. "), ("г:", "г. "), ("б-р;", "б-р"), ("б-р,", "б-р")]
FULL_NAME = "^[А-ЯЁ][а-яё-]+(?:\\s+[А-ЯЁ][а-яё-]+){2}$"
PHONE = "(\\+7\\s*\\(?\\d{3}\\)?\\s*\\d[\\d\\-()]{6,})"
TENANCIES = ["социальный наем", "социальный найм", "безвозмездное пользование", "коммерческий наем", "коммерческий найм"]


def parseable(x: Column) -> Column:
    """An address with its misread signs put right."""
    return apply_literals(apply_patterns(ws(x), ADDRESS_SIGNS), ADDRESS_WORDS)


def street(x: Column) -> Column:
    """A street with its type, in one spelling, in front of its name."""
    v = F.regexp_replace(cyrillic_lookalikes(F.btrim(ws(x), F.lit(","))), "(?iuU)^(?:[uU][лЛ]|ul)\\.?(?=\\s|$)", "ул.")
    v = F.regexp_replace(F.rtrim(F.regexp_replace(v, "(?iu)(?<![\\wа-яё])бульв\\.?(?![\\wа-яё])", "бульвар")), "[:;,]+$", "")
    v = F.regexp_replace(v, "(?iu)^ул\\s*\\.\\s+(?=.+\\s(?:бульвар|просп\\.?)$)", "")

    def typed(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for behind, front, short in STREET_TYPES:  # behind the name, with or without a type in front
            name = F.regexp_extract(s, f"(?iu)^(?:{front}\\s+)?(.+?)\\s+{behind}[:;,]?$", 1)
            out = out.when(name != "", F.concat(F.lit(short + " "), name))
        for _, front, short in STREET_TYPES:  # in front only
            name = F.regexp_extract(s, f"(?iu)^{front}\\s+(.+)$", 1)
            out = out.when(name != "", F.concat(F.lit(short + " "), name))
        return out.otherwise(s)

    done = let(v, typed)
    return F.btrim(ws(F.regexp_replace(done, "\\s+,", ",")), F.lit(" ,;:"))


def token(x: Column) -> Column:
    """A house, building or flat without Latin look-alikes; null for blanks, bare labels and single letters."""
    v = F.regexp_replace(F.regexp_replace(F.trim(x), "(?<=\\d)A$", "А"), "(?<=\\d)a$", "а")
    return let(v, lambda t: F.when((t == "") | t.rlike("^_+$") | canon(t).isin("корп", "строение", "кв", "дом") | t.rlike("^\\D$"), F.lit(None).cast("string")).otherwise(t))


def found(x: Column, pattern: str) -> Column:
    """The first group of ``pattern`` in an address, as a token."""
    return token(blank(F.regexp_extract(x, f"(?iuU){pattern}", 1)))


def compose(street_: Column, house: Column, building: Column, structure: Column, flat: Column, house_sign: str = "дом ") -> Column:
    """The parts of an address in one line; null if there are none."""
    part = lambda sign, c: F.when(has(c), F.concat(F.lit(sign), c))
    return blank(F.concat_ws(", ", part("", street_), part(house_sign, house), part("корп. ", building), part("строение ", structure), part("кв. ", flat)))


def public_street(x: Column) -> Column:
    """A street as it is published: boulevards and avenues have their type behind the name."""
    return F.when(x.startswith("б-р "), F.concat(F.substring(x, F.lit(5), F.length(x)), F.lit(" бульвар"))).when(x.startswith("пр-кт "), F.concat(F.substring(x, F.lit(7), F.length(x)), F.lit(" пр-кт"))).otherwise(x)


def is_street_line(x: Column) -> Column:
    return canon(parseable(x)).rlike("ул|б р|бульвар|просп|пер|ш ")


def relevant_lines(lines: Column, most: int = 6) -> Column:
    """From the first line with a word of an address on, six lines at most (an address block has no more)."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when(canon(parseable(x)).rlike("дом|ул|кв|корп|строение"), i)), lambda i: i.isNotNull())
    return let(F.array_min(starts), lambda i: F.when(i.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, i + 1, F.lit(most))))


def leading_number(lines: Column) -> Column:
    """A number of up to four digits alone on one of the first two lines."""
    return F.get(F.filter(F.slice(lines, 1, 2), lambda x: x.rlike("^\\d{1,4}$")), F.lit(0))


def standalone_number(lines: Column, but: Column) -> Column:
    """The first number of up to six digits alone on its line, other than ``but``."""
    return F.get(F.filter(lines, lambda x: x.rlike("^\\d{1,6}$") & ~x.eqNullSafe(but)), F.lit(0))


def address(lines: Column) -> Column:
    """struct<full, street, house, building, structure, apartment> of the lines of page 1's address block."""
    own = relevant_lines(lines)

    def read(ls: Column) -> Column:
        flat = parseable(F.array_join(ls, " "))
        line = F.get(F.filter(ls, is_street_line), F.lit(0))
        parts = F.struct(
            street(F.regexp_replace(line, "(?iu)[,\\s]+(?:дом|корп|строение|кв)(?![а-яё]).*$", "")).alias("street"), F.when(found(flat, "дом\\s*(?:№|ng|no)?\\s*([\\w/-]+)") != "N", found(flat, "дом\\s*(?:№|ng|no)?\\s*([\\w/-]+)")).alias("house"), found(flat, "кор(?:п\\.?|:)?\\s*([\\w/-]+)").alias("building"),
            found(flat, "строение\\s*([\\w/-]+)").alias("structure"), found(flat, "кв\\.?\\s*(\\d+)").alias("flat"), leading_number(ls).alias("lead"),
        )
        whole = lambda p: let(F.coalesce(p["flat"], p["lead"], standalone_number(ls, p["house"])), lambda f: F.struct(
            compose(p["street"], p["house"], p["building"], p["structure"], f).alias("full"), p["street"].alias("street"), p["house"].alias("house"), p["building"].alias("building"), p["structure"].alias("structure"), f.alias("apartment")
        ))
        return F.when(line.isNotNull(), let(parts, whole))

    return let(own, read)


# The company -------------------------------------------------------------------------------


def company_name(x: Column) -> Column:
    """A company's name: zeros read for О, angle brackets and other signs for quotes, quotes in pairs."""
    v = F.translate(ws(F.replace(x, F.lit(":"), F.lit(""))), "<>", '""')
    v = apply_patterns(v, [("^О00(?!\\w)", "ООО"), ("(?<=\\s)c(?=\\s)", "с"), ("Домами[хж]$", 'Домами"'), ("ж$", '"'), ("['\"]+$", "")])
    return F.when(F.length(F.regexp_replace(v, '[^"]', "")) % 2 == 1, F.concat(v, F.lit('"'))).otherwise(v)


def line_priority(x: Column) -> Column:
    """In which order the lines behind a company's name belong together."""
    k = canon(x)
    return F.when(k.startswith("адрес"), 0).when(k.rlike("ул|москва|россия"), 1).when(k.contains("б р"), 2).when(k.rlike("дом|кор"), 3).when(k.contains("телефон"), 4).otherwise(5)


def company_address(x: Column) -> Column:
    """Postcode, country, town, street, house and building of a company, each once, in this order; the text if it has none of them."""
    v = F.regexp_replace(parseable(x), "(?iu)^адрес\\s*:\\s*", "")
    v = ws(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, PHONE, ""), "(?iu)[,;]?\\s*телефон\\s*:?", ""), "(?iu)(?<![\\wа-яё])г москва", "г. Москва"))

    def parts(t: Column) -> Column:
        low = F.lower(t)
        line = blank(F.regexp_extract(t, "(?iu)(ул[.:]?\\s*[А-ЯЁа-яё0-9 .-]+?(?:\\s+б-р)?)(?=\\s+дом|,?\\s+дом|$)", 1))
        house = F.coalesce(found(t, "дом[:\\s]*([\\w/-]+)"), found(t, "\\b(\\d{1,3})\\b(?=,?\\s*корп?[.:\\s])"))
        building = F.regexp_replace(F.coalesce(found(t, "корп\\.?\\s*([\\w/-]+)"), found(t, "\\bкор[:\\s]*([0-9]{1,3})\\b")), "[^0-9/-].*$", "")
        items = F.array_compact(F.array(
            blank(F.regexp_extract(t, "(?<!\\d)(\\d{6})(?!\\d)", 1)), F.when(low.contains("страна россия"), "страна Россия"), F.when(low.contains("москва"), "г. Москва"),
            F.when(line.isNotNull(), street(line)), F.when(house.isNotNull(), F.concat(F.lit("дом "), house)), F.when(has(building), F.concat(F.lit("корп. "), building)),
        ))
        return let(items, lambda a: F.when(F.size(a) > 0, F.array_join(F.array_distinct(a), ", ")).otherwise(blank(F.btrim(t, F.lit(" ,;")))))

    return let(v, parts)


def company(lines: Column) -> Column:
    """struct<name, address, phone> of the lines of page 1's company block."""
    clean = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" :"))), lambda x: x != "")

    def read(ls: Column) -> Column:
        rest = F.array_sort(F.transform(F.slice(ls, F.lit(2), F.size(ls)), lambda x: F.struct(line_priority(x).alias("p"), canon(x).alias("k"), x.alias("x"))))
        tail = F.array_join(F.transform(rest, lambda r: r["x"]), " ")
        return F.when(F.size(ls) > 0, let(tail, lambda t: F.struct(company_name(ls[0]).alias("name"), company_address(t).alias("address"), phone(blank(F.regexp_extract(t, PHONE, 1))).alias("phone"))))

    return let(clean, read)


# Owners, tenants, documents ----------------------------------------------------------------


def rented(kind: Column) -> Column:
    """Whether the kind of settlement is one of people who aren't owners."""
    k = canon(kind)
    return functools.reduce(lambda a, b: a | b, [k.contains(t) for t in TENANCIES])


def social(kind: Column) -> Column:
    return canon(kind).rlike("социальный на[ей]м")


def private(kind: Column) -> Column:
    return canon(kind) == "частная собственность"


def share(x: Column) -> Column:
    return F.when(F.lower(x).contains("без"), "без опред. долей").otherwise(decimal_text(x))


def owners(lines: Column, kind: Column, applicant: Column) -> Column:
    """array<struct<full_name, share>>: none where people rent; a lone private owner has all of it, and the applicant stands in for owners that weren't read."""
    names = F.filter(lines, lambda x: x.rlike(FULL_NAME))
    shares = F.transform(F.filter(lines, lambda x: F.lower(x).contains("без опред") | x.rlike("^\\d+(?:[,.]\\d{1,2})?$")), share)
    own = F.coalesce(private(kind), F.lit(False))
    paired = lambda n: F.transform(n, lambda x, i: F.struct(x.alias("full_name"), F.coalesce(F.get(shares, i), F.when((F.size(n) == 1) & own, "100.00")).alias("share")))
    none = F.array().cast("array<struct<full_name:string,share:string>>")
    return F.when(F.coalesce(rented(kind), F.lit(False)), none).otherwise(let(names, lambda n: F.when((F.size(n) == 0) & own & applicant.isNotNull(), F.array(F.struct(applicant.alias("full_name"), F.lit("100.00").alias("share")))).otherwise(paired(n))))


def tenant(lines: Column, kind: Column) -> Column:
    """The first full name of the settlement block, where people rent."""
    return F.when(rented(kind), F.get(F.filter(lines, lambda x: x.rlike(FULL_NAME)), F.lit(0)))


def applicant(lines: Column) -> Column:
    """The first full name before the passport's label (of the first twenty lines, if there is no label)."""
    label = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(canon(x).rlike("паспортные.*данные|данные.*паспортные"), i)), lambda i: i.isNotNull()))
    head = F.slice(lines, F.lit(1), F.coalesce(label, F.lit(20)))
    return F.get(F.filter(F.transform(head, lambda x: F.trim(F.substring_index(x, ",", 1))), lambda x: x.rlike(FULL_NAME)), F.lit(0))


def stops_documents(x: Column) -> Column:
    """Whether a line of the documents' block is a note of the form."""
    return x.startswith("(") | canon(x).rlike("указы|oama|дата|кем выдан|иной документ|основанием для открытия|лицевого счета|субар")


def document_lines(lines: Column) -> Column:
    """Lines in which the register's name, that slipped before its extract, stands behind it again."""
    step = lambda acc, x: F.when(canon(x).startswith("государственного реестра"), F.struct(acc["out"].alias("out"), x.alias("held"))).when(
        acc["held"].isNotNull() & canon(x).startswith("выписка"), F.struct(F.array_append(acc["out"], F.concat_ws(" ", x, acc["held"])).alias("out"), F.lit(None).cast("string").alias("held"))
    ).otherwise(F.struct(F.array_append(acc["out"], x).alias("out"), acc["held"].alias("held")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))
    return F.aggregate(F.transform(lines, ws), start, step, lambda acc: F.when(acc["held"].isNotNull(), F.array_append(acc["out"], acc["held"])).otherwise(acc["out"]))


def passport_lines(lines: Column) -> Column:
    """The lines of the present passport: from the first that names one (the label doesn't) to the first with a date, and a lone quoted word behind it; the first two if none names one."""
    at = lambda p: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    first = F.array_min(at("(?iu)паспорт(?!н)"))
    dated = F.array_min(F.filter(at("\\d{2}\\.\\d{2}\\.\\d{4}"), lambda i: i >= first))
    again = F.array_min(F.filter(at("(?iu)паспорт(?!н)"), lambda i: i > first))
    last = F.least(F.coalesce(dated, F.size(lines) - 1), F.coalesce(again - 1, F.size(lines) - 1))
    behind = F.get(lines, last + 1)
    more = F.when((last == dated) & behind.rlike("^[\"'«]?[А-ЯЁа-яё-]{3,}[\"'»]?$") & ~behind.rlike("(?iu)паспорт(?!н)"), 1).otherwise(0)
    return F.when(first.isNull(), F.slice(lines, 1, 2)).otherwise(F.slice(lines, first + 1, last - first + 1 + more))


# Managed buildings -------------------------------------------------------------------------


def building_key(x: Column) -> Column:
    v = apply_literals(F.translate(F.lower(x), "ё", "е"), [("бульвар", "б-р"), ("пр-д.", "пр-д"), ("пр-кт.", "пр-кт"), ("ул.", "ул"), ("д.", "д"), ("к.", "к")])
    return ws(F.regexp_replace(v, "[^0-9a-zа-я\\s-]+", " "))


def resolve_buildings(rows: DataFrame, managed: DataFrame) -> DataFrame:
    """Rows with house and building as the list of managed buildings has them: of the building that agrees in
    street, house and building; else of the only one of the street with the part that is known; else unchanged.

    rows: street, house, building and more; managed: street, house, building, distinct. The list
    is aggregated by each key first, so each row meets at most one entry of each kind.
    """
    m = managed.select(building_key(F.col("street")).alias("_s"), F.col("house").alias("_h"), F.col("building").alias("_b")).withColumn("_hk", building_key(F.col("_h"))).withColumn("_bk", building_key(F.coalesce("_b", F.lit(""))))
    one = lambda alias: F.when(F.count("*") == 1, F.min(F.struct(F.col("_h"), F.coalesce("_b", F.lit("")).alias("_b")))).alias(alias)
    r = rows.withColumn("_s", building_key(F.col("street"))).withColumn("_hk", building_key(F.col("house"))).withColumn("_bk", building_key(F.col("building")))
    r = r.join(m.groupBy("_s", "_hk", "_bk").agg(F.min(F.struct(F.col("_h"), F.coalesce("_b", F.lit("")).alias("_b"))).alias("whole")), ["_s", "_hk", "_bk"], "left")
    r = r.join(m.groupBy("_s", "_hk").agg(F.min(F.struct(F.col("_h"), F.coalesce("_b", F.lit("")).alias("_b"))).alias("by_house")), ["_s", "_hk"], "left")
    r = r.join(m.groupBy("_s", "_bk").agg(one("by_building")), ["_s", "_bk"], "left").join(m.groupBy("_s").agg(one("alone")), "_s", "left")
    hit = F.when(has(F.col("house")) & has(F.col("building")), F.col("whole")).when(has(F.col("house")), F.col("by_house")).when(has(F.col("building")), F.col("by_building")).otherwise(F.col("alone"))
    return r.withColumn("_hit", hit).select(*[c for c in rows.columns if c not in ("house", "building")], F.coalesce("_hit._h", "house").alias("house"), F.when(F.col("_hit").isNotNull(), blank(F.col("_hit._b"))).otherwise(F.col("building")).alias("building"))
