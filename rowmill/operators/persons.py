"""Persons of a document: cells to rows, methods compared, candidates reconciled, one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import NAME_STOPS, NO_NAMES, ws

# Endings of patronymics.
PATRONYMIC = "(?iu)(ич|вич|ович|евич|ична|овна|евна|кызы)$"


def name_score(full_name: Column) -> Column:
    """Points for a name by the number and the look of its words."""
    n = F.coalesce(full_name, F.lit(""))
    w = F.filter(F.split(ws(n), " "), lambda t: t != "")
    size = F.when(F.size(w) == 3, 12).when(F.size(w) == 2, 4).when(F.size(w) > 3, -6).otherwise(0)
    word = lambda t: (
        F.when(t.isin(NO_NAMES + NAME_STOPS), -14).otherwise(0) + F.when(~t.rlike("^[A-ZА-ЯЁ]"), -3).otherwise(0) + F.when(F.length(F.btrim(t, F.lit("-"))) < 2, -4).otherwise(0) + F.when(t.rlike("[A-Za-z]"), -10).otherwise(0)
    )
    return F.when(n == "", -20).otherwise(size + F.aggregate(w, F.lit(0), lambda a, t: a + word(t)))


def suspicious(full_name: Column) -> Column:
    """A name that isn't three words, or has a word that names a place or is in Latin letters."""
    w = F.filter(F.split(ws(F.coalesce(full_name, F.lit(""))), " "), lambda t: t != "")
    return (F.size(w) != 3) | F.exists(w, lambda t: t.isin(NAME_STOPS) | t.rlike("[A-Za-z]"))


def parse_score(persons: DataFrame, by: list[str]) -> DataFrame:
    """``by``, score, n_suspicious of a parse: 20 a person, its name, 5 a birthday, 4 a document's text, 3 its number.
    persons: ``by``, full_name, birthday_date, raw, number."""
    one = 20 + name_score(F.col("full_name")) + F.when(F.col("birthday_date").rlike(r"^\d{2}\.\d{2}\.\d{4}$"), 5).otherwise(0) + F.when(F.coalesce("raw", F.lit("")) != "", 4).otherwise(0) + F.when(F.coalesce("number", F.lit("")) != "", 3).otherwise(0)
    return persons.groupBy(*by).agg(F.sum(one).cast("long").alias("score"), F.count_if(suspicious(F.col("full_name"))).alias("n_suspicious"))


def better_parse(primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """``by``, method: the primary parse if it has fewer suspicious names, else the one with the higher score, the primary of equal ones."""
    a = parse_score(primary, by).select(*by, F.col("score").alias("s1"), F.col("n_suspicious").alias("n1"))
    b = parse_score(fallback, by).select(*by, F.col("score").alias("s2"), F.col("n_suspicious").alias("n2"))
    second = ~F.coalesce(F.col("n1") < F.coalesce("n2", F.lit(0)), F.lit(False)) & (F.coalesce("s2", F.lit(0)) > F.coalesce("s1", F.lit(0)))
    return a.join(b, by, "full").select(*by, F.when(F.coalesce(second, F.lit(False)), "fallback").otherwise("primary").alias("method"))


def complete_names(people: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """People with ``matched``: the candidate of their document that their name stands for (see
    :func:`rowmill.operators.reconcile.best_candidate`). candidates: by, candidate."""
    from rowmill.operators.reconcile import best_candidate

    own = candidates.groupBy(*by).agg(F.sort_array(F.collect_set("candidate")).alias("_c"))  # the owners and tenant of one document
    return people.join(own, by, "left").withColumn("matched", best_candidate(F.col("full_name"), F.col("_c"))).drop("_c")


def unused(candidates: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that no person of their document took."""
    return candidates.join(matched.filter("matched IS NOT NULL").select(*by, F.col("matched").alias("candidate")), [*by, "candidate"], "left_anti")


def roles(owners: DataFrame, tenants: DataFrame, residents: DataFrame) -> DataFrame:
    """One long table of persons: job_id, file_index, role, seq, full_name."""
    cols = ["job_id", "file_index", "role", "seq", "full_name"]
    one = owners.withColumn("role", F.lit("owner")).select(*cols)
    two = tenants.withColumn("role", F.lit("tenant")).withColumn("seq", F.lit(0)).select(*cols)
    three = residents.withColumn("role", F.when(F.col("registration_kind") == "constant", "registered_permanent").otherwise("registered_temporary")).select(*cols)
    return one.unionByName(two).unionByName(three)


def registration_status(raw: Column) -> Column:
    """``without_registration`` if the text says so, whatever its signs, breaks and ending, else ``registered``."""
    letters = F.regexp_replace(F.translate(F.lower(F.coalesce(raw, F.lit(""))), "ё", "е"), "[^а-яa-z0-9]+", "")
    return F.when(letters.contains("безрегистрац"), "without_registration").otherwise("registered")
