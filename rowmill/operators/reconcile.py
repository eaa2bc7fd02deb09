"""Persons of one document from several readings: two parses brought together, names completed
by page 1, broken names mended, documents of the applicant preferred, and the public record
with its trace. Joins are on the document (and the birthday), expressions do the rest."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import address_confidence, date_confidence, enum_confidence, let, name_confidence, ws
from rowmill.operators import identity as D
from rowmill.operators.persons import PATRONYMIC

# Endings of misread patronymics, and what they were for women and men.
BROKEN_ENDINGS = [("ьеб", "ьевна", "ьевич"), ("еб", "евна", "евич"), ("об", "овна", "ович"), ("б", "вна", "вич")]
FEMALE_SURNAME, FEMALE_FIRST = "(?:ова|ева|ина|ая)$", "(?:а|я|на)$"


def name_key(x: Column) -> Column:
    """A name for comparisons: small letters, hyphens as spaces."""
    return F.lower(ws(F.translate(F.coalesce(x, F.lit("")), "-", " ")))


def parts(x: Column) -> Column:
    return F.filter(F.split(name_key(x), " "), lambda w: w != "")


def _begins_alike(x: Column, y: Column) -> Column:
    return F.coalesce(x.startswith(y) | y.startswith(x), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """0 to 3: equal first words, and second and third words of which one begins the other."""
    nth = lambda x, i: F.get(x, F.lit(i))
    return let(F.struct(parts(a).alias("a"), parts(b).alias("b")), lambda s: F.coalesce((nth(s["a"], 0) == nth(s["b"], 0)).cast("int"), F.lit(0)) + _begins_alike(nth(s["a"], 1), nth(s["b"], 1)).cast("int") + _begins_alike(nth(s["a"], 2), nth(s["b"], 2)).cast("int"))


def document_points(d: Column) -> Column:
    """Confidence in a document, more for a whole series and a registry office, less for an issuer that begins mid-name."""
    series, by = F.coalesce(d["series"], F.lit("")), F.trim(F.coalesce(d["issued_by"], F.lit("")))
    born = F.when(series.rlike(f"^{D.NUMERALS}-[А-ЯЁ]{{2}}$"), 0.2).when(series.rlike(f"^{D.NUMERALS}$"), -0.15).otherwise(0.0) + F.when(F.upper(by).contains("ЗАГС"), 0.15).otherwise(0.0)
    cut = F.when(by.rlike("^(?:[a-zа-яё])"), 0.3).otherwise(0.0)
    own = F.when(d["document_type"] == D.CERTIFICATE, born).when((d["document_type"] == D.REFERENCE) & (by != ""), 0.05).otherwise(0.0)
    return F.when(d.isNull(), 0.0).otherwise(D.confidence(d) + own - cut)


def merge_parses(layout: DataFrame, fallback: DataFrame, by: list[str], key: str) -> DataFrame:
    """Persons of the layout parse with the better document and name of the fallback parse.

    A person's counterpart has its birthday: the only one of that birthday, else the one of
    exactly the name, else the likest name (at least one part alike; ties: the first in
    order). Both: ``by``, ``key``, full_name, birthday_date, document. Persons without a
    birthday keep what they have.
    """
    other = fallback.filter("birthday_date IS NOT NULL").select(*by, "birthday_date", F.col("full_name").alias("n2"), F.col("document").alias("d2"), F.col(key).alias("k2"))
    counts = other.groupBy(*by, "birthday_date").agg(F.count("*").alias("alone"))
    met = layout.join(other.join(counts, [*by, "birthday_date"]), [*by, "birthday_date"])
    exact = name_key(F.col("full_name")) == name_key(F.col("n2"))
    rank = F.when(F.col("alone") == 1, 9).when(exact, 8).otherwise(similarity(F.col("full_name"), F.col("n2")))
    best = met.withColumn("_r", rank).filter("_r >= 1").groupBy(key).agg(F.max_by(F.struct("n2", "d2"), F.struct("_r", -F.col("k2"))).alias("m"))
    joined = layout.join(best, key, "left")
    document = F.when(document_points(F.col("m.d2")) > document_points(F.col("document")), F.col("m.d2")).otherwise(F.col("document"))
    name = F.when(~D.has(F.col("full_name")) | (name_confidence(F.col("m.n2")) > name_confidence(F.col("full_name"))), F.coalesce("m.n2", "full_name")).otherwise(F.col("full_name"))
    return joined.withColumn("document", document).withColumn("full_name", F.when(F.col("m").isNull(), F.col("full_name")).otherwise(name)).select(*layout.columns)


# Names -------------------------------------------------------------------------------------


def incomplete(x: Column) -> Column:
    """A name of fewer than three words, or with a hyphen."""
    return F.coalesce((F.length(F.regexp_replace(x, "[^ ]", "")) < 2) | x.contains("-"), F.lit(True))


def best_candidate(name: Column, candidates: Column) -> Column:
    """The candidate a person's name stands for. Its first word must be one of the name's words; then
    second and third words count that begin alike. Names of three words need all three, names of two
    need two; failing that, an incomplete name takes the only candidate of its surname."""

    def chosen(own: Column) -> Column:
        scored = F.filter(
            F.transform(candidates, lambda c, i: let(parts(c), lambda w: F.struct(
                F.when((F.size(w) < 2) | ~F.array_contains(own, F.get(w, F.lit(0))), 0).otherwise(1 + _begins_alike(F.get(own, F.lit(1)), F.get(w, F.lit(1))).cast("int") + _begins_alike(F.get(own, F.lit(2)), F.get(w, F.lit(2))).cast("int")).alias("score"),
                (-i).alias("order"), c.alias("name"),
            ))), lambda s: s["score"] > 0)
        of = lambda s: F.when((F.size(own) >= 3) & (F.array_max(s)["score"] >= 3) | (F.size(own) == 2) & (F.array_max(s)["score"] >= 2), F.array_max(s)["name"]).when(
            (F.array_max(s)["score"] == 1) & (F.size(s) == 1) & incomplete(name), s[0]["name"]
        )
        return let(scored, of)

    return F.when(D.has(name), let(parts(name), chosen))


def too_young_to_match(name: Column, birthday: Column, raw: Column) -> Column:
    """Incomplete names of people born from 2010 on, without a document, aren't matched with page 1."""
    return ~D.has(raw) & incomplete(name) & (F.length(birthday) == 10) & F.coalesce(F.right(birthday, F.lit(4)).try_cast("int") >= 2010, F.lit(False))


def mended_patronymic(word: Column, female: Column) -> Column:
    """A patronymic whose ending was misread, with the ending it had; null if it wasn't."""
    w = F.btrim(word, F.lit("-"))
    out = F.when(F.length(w) < 3, F.lit(None).cast("string"))
    for bad, woman, man in BROKEN_ENDINGS:
        out = out.when(F.lower(w).endswith(bad) & (F.length(w) > len(bad)), F.concat(F.left(w, F.length(w) - len(bad)), F.when(female, woman).otherwise(man)))
    return out


def female_name(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(0)).rlike(FEMALE_SURNAME), F.lit(False)) | F.coalesce(F.get(words, F.lit(1)).rlike(FEMALE_FIRST), F.lit(False))


def rejoined(x: Column) -> Column:
    """Three words of which the last begins small: the last two are one, parted before its inner capital."""
    def glued(w: Column) -> Column:
        both = F.regexp_replace(F.concat(w[1], w[2]), "(?<=[а-яё])(?=[А-ЯЁ])", " ")
        return F.when((F.size(w) == 3) & ~F.coalesce(F.get(w, F.lit(2)), F.lit("A")).rlike("^[A-ZА-ЯЁ]") & (F.size(F.split(both, " ")) == 2), F.concat_ws(" ", w[0], both)).otherwise(x)

    return let(F.split(ws(x), " "), lambda w: F.when(F.size(w) == 3, glued(w)).otherwise(x))


def registered_name(x: Column, whole: dict[str, str] | None = None, patronymics: dict[str, tuple[str, str]] | None = None) -> Column:
    """A resident's name with what scanning broke mended. whole: beginnings and the names they stand
    for; patronymics: misread patronymics and what they are for women and for men."""

    def mended(v: Column) -> Column:
        def three(w: Column) -> Column:
            known = functools.reduce(lambda acc, r: acc.when(w[2] == r[0], F.when(w[0].rlike("(?:ова|ева|ина)$"), r[1][0]).otherwise(r[1][1])), (patronymics or {}).items(), F.when(F.lit(False), F.lit(None).cast("string")))
            return F.concat_ws(" ", w[0], w[1], F.coalesce(known, mended_patronymic(w[2], female_name(w)), w[2]))

        fixed = functools.reduce(lambda acc, r: acc.when(v.startswith(r[0]), F.lit(r[1])), (whole or {}).items(), F.when(F.lit(False), F.lit(None).cast("string")))
        return F.coalesce(fixed, let(F.split(ws(v), " "), lambda w: F.when(F.size(w) == 3, three(w)).otherwise(v)))

    return F.when(~D.has(x), x).otherwise(let(rejoined(x), mended))


def split_tokens(tokens: Column) -> Column:
    """Words that run together are parted at their capitals; a word that ends in its only hyphen stays."""
    inner = lambda t: F.regexp_extract_all(t, F.lit("([А-ЯЁ][а-яё-]*)"), F.lit(1))
    part = lambda t: F.when(t.rlike("^[^-]*-$"), F.array(t)).when((F.size(inner(t)) >= 2) & (F.array_join(inner(t), "") == F.replace(t, F.lit("-"), F.lit(""))), inner(t)).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, part))


# Words of the form that get into names.
FORM_WORDS = ["Документ", "Федерация", "Российская", "заявитель"]


def without_noise(tokens: Column) -> Column:
    """Words of the form, repeated words, and short words after the first that are no patronymics are left out."""
    keep = lambda acc, t: F.when(t.isin(FORM_WORDS) | (F.size(acc) > 0) & ((t == F.element_at(acc, -1)) | (F.length(t) <= 3) & ~t.rlike(PATRONYMIC)), acc).otherwise(F.array_append(acc, t))
    return F.aggregate(tokens, F.array().cast("array<string>"), keep)


# Page 1 and the people of page 2 ------------------------------------------------------------


def prefers_page1(one: Column, two: Column) -> Column:
    """Whether the applicant's document of page 1 is better than the resident's: more confidence, or the
    same and more points, or a longer issuer that begins like the other."""
    family = ~D.has(one["document_type"]) | ~D.has(two["document_type"]) | (F.lower(one["document_type"]) == F.lower(two["document_type"]))
    by1, by2 = ws(F.coalesce(one["issued_by"], F.lit(""))), ws(F.coalesce(two["issued_by"], F.lit("")))
    longer = (by1 != "") & (by2 != "") & (F.length(by1) > F.length(by2)) & by1.startswith(by2)
    facts = F.struct(D.confidence(one).alias("a"), D.confidence(two).alias("b"), (document_points(one) > document_points(two)).alias("points"))
    return let(facts, lambda f: F.coalesce(family & ((f["a"] > f["b"]) | (f["a"] == f["b"]) & (longer | f["points"])), F.lit(False)))


def prefers_page1_by_number(one: Column, two: Column, better: Column | None = None) -> Column:
    """The same for documents of one number: another series, or an issuer that reads like an address.
    better: :func:`prefers_page1`, if it is known."""
    by = F.coalesce(two["issued_by"], F.lit(""))
    same = D.has(one["number"]) & (ws(one["number"]) == ws(two["number"]))
    other = D.has(one["series"]) & D.has(two["series"]) & (ws(one["series"]) != ws(two["series"]))
    spoilt = by.rlike(r"\d|(?iu)ул\.|дом|кв\.|мкр") | by.rlike("MOCK|MVD|HC|p-ne|p/o")
    family = ~D.has(one["document_type"]) | ~D.has(two["document_type"]) | (F.lower(one["document_type"]) == F.lower(two["document_type"]))
    return F.coalesce(family & same & (other | spoilt | (prefers_page1(one, two) if better is None else better)), F.lit(False))


def subject_document(one: Column, two: Column, person: Column, subject: Column) -> Column:
    """The document a resident is published with: page 1's if it is of the same number and better, or of
    the applicant (equal names) and better."""
    named = D.has(person) & D.has(subject) & (name_key(person) == name_key(subject))
    return let(prefers_page1(one, two), lambda better: F.when(prefers_page1_by_number(one, two, better) | named & better, one).otherwise(two))


def reconcile(people: DataFrame, page1: DataFrame, by: list[str]) -> DataFrame:
    """People as they are published: ``by``, key, full_name, birthday_date, document, without those
    that have no registration.

    people: ``by``, key, full_name, birthday_date, document, unregistered; page1: ``by``,
    candidates (array of owners and tenant), subject, page1_document; one row a document.
    """
    j = people.join(page1, by, "left")
    none = F.array().cast("array<string>")
    names = F.coalesce("candidates", none)
    young = too_young_to_match(F.col("full_name"), F.col("birthday_date"), F.col("document.raw"))
    met = F.when(~young, best_candidate(F.col("full_name"), names))
    left = j.groupBy(*by).agg(F.collect_set("full_name").alias("written"))  # the people of one document
    j = j.join(left, by, "left").withColumn("_m", met)
    spare = F.array_except(names, F.coalesce("written", none))
    only = F.when(~young & F.col("_m").isNull() & incomplete(F.col("full_name")) & (F.size(spare) == 1), spare[0])
    j = j.filter(~F.coalesce("unregistered", F.lit(False))).withColumn("_young", young).withColumn("_name", registered_name(F.coalesce("_m", only, "full_name")))
    document = F.when(F.col("_young"), F.col("document")).otherwise(subject_document(F.col("page1_document"), F.col("document"), F.col("_name"), F.col("subject")))
    return j.withColumn("_document", document).select(*by, "key", F.col("_name").alias("full_name"), "birthday_date", F.coalesce("_document", "document").alias("document"))


def person_trace(people: DataFrame, by: list[str], method: str) -> DataFrame:
    """``by``, key and the confidence in each person's name, birthday and document, with the parse they come from."""
    return people.select(
        *by, "key", "full_name", name_confidence("full_name").alias("full_name_confidence"), F.when(D.has(F.col("birthday_date")), 1.0).otherwise(0.0).alias("birthday_date_confidence"),
        F.coalesce(D.confidence(F.col("document")), F.lit(0.0)).alias("passport_confidence"), F.col(method).alias("name_source_method"),
    )


def page1_trace(page1: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and, for each field of page 1, its value's confidence; what the subject is and how many there are."""
    owners = F.coalesce("n_owners", F.lit(0))
    kind = F.when(owners > 0, "owners").when(D.has(F.col("primary_tenant")), "primary_tenant")
    return page1.select(
        *by, date_confidence("document_date").alias("document_date"), address_confidence("full_address").alias("property_address"), enum_confidence("settlement_type").alias("settlement_type"), kind.alias("subject"),
        F.when(owners > 0, owners).when(D.has(F.col("primary_tenant")), 1).otherwise(0).cast("long").alias("n_subjects"), F.when(kind.isNotNull(), 1.0).otherwise(0.0).alias("subject_confidence"),
    )
