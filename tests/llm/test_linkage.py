from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm.linkage import LabelModel, birth_parts, candidates, link, persons_of
from rowmill.llm.people import people


@pytest.mark.parametrize(("text", "want"), [("1982-06-12", ("82", "06-12", "1982")), ("2.7.2005", ("05", "07-02", "2005")), ("19/07/48", ("48", "07-19", None)), ("2016", ("16", "", "2016")), ("", (None, "", None)), (None, (None, "", None)), ("мая", (None, "", None))])
def test_birth_parts(spark, text, want):
    r = spark.createDataFrame([(text,)], "d string").select(birth_parts("d").alias("b")).first().b
    assert (r.yy, r.md, r.year) == want


def test_label_model_recovers_hidden_labels():
    rng = np.random.default_rng(4)
    n = 20000
    y = rng.random(n) < 0.3
    hit = lambda p, q: np.where(y, rng.random(n) < p, rng.random(n) < q).astype(int)
    a, b, c = hit(0.9, 0.1), hit(0.85, 0.2), hit(0.8, 0.05)
    d = np.where(rng.random(n) < 0.9, b, hit(0.5, 0.5))  # follows b
    votes = np.stack([a, b, c, d], 1)
    patterns, where = np.unique(votes, axis=0, return_inverse=True)
    model = LabelModel([(2, -1)] * 4)
    post = model.fit(patterns, np.bincount(where.ravel()).astype(float))[where.ravel()]
    assert (1, 3) in model.edges
    assert ((post > 0.5) == y).mean() > 0.9
    bins = (post > 0.8) & (post < 1)
    assert abs(y[bins].mean() - post[bins].mean()) < 0.07


def test_silent_votes_say_nothing():
    model = LabelModel([(3, 1), (3, 1)])
    votes = np.array([[2, 2], [0, 0], [2, 1], [1, 0], [1, 1]])
    post = model.fit(votes, np.array([100.0, 100.0, 50.0, 50.0, 1.0]))
    assert post[0] > post[2] > 0.5 > post[3] > post[1] and abs(post[4] - 0.5) < 0.1
    assert len(LabelModel([(2, -1)]).fit(np.zeros((0, 1), int), np.zeros(0))) == 0


FIRST = ["Иван", "Пётр", "Олег", "Юрий"]
STEMS = ["Зоркин", "Волков", "Сидоров", "Лапин", "Медников", "Гусев", "Тарасов", "Крылов", "Фомин", "Шилов"]


def world():
    res, reg, truth = [], [], set()
    n = 0
    for i, s in enumerate(STEMS * 8):
        f, p = FIRST[i % 4], FIRST[(i // 4) % 4].replace("Пётр", "Петр").replace("Юрий", "Юрье").replace("ий", "ье") + ("вич" if FIRST[(i // 4) % 4] == "Юрий" else "ович")
        date, number = f"{i % 27 + 1:02d}.{i % 12 + 1:02d}.{1950 + i % 60}", f"{100000 + 7919 * i % 899999}"
        res.append((i, f"{s} {f} {p}", date if i % 9 else None, i, "x"))
        d, m, y = date.split(".")
        if i % 3 == 0:
            reg.append((1000 + n, f"{s.upper()} {f[0]}. {p[0]}.", f"{y}-{m}-{d}", f"12 34 {number}", "x"))
            truth.add((1000 + n, i))
        elif i % 3 == 1:
            reg.append((1000 + n, f"{f} {p} {s}", y if i % 2 else f"{d}/{m}/{y[2:]}", f"**{number[-4:]}", "x"))
            truth.add((1000 + n, i))
        else:
            reg.append((1000 + n, f"{s} {f} {p}", f"{1900 + i}-11-{d}", f"{999999 - i * 31}", "x"))
        n += 1
    return res, reg, truth


def test_link(spark):
    res, reg, truth = world()
    reg += [(5000, None, "1990-01-01", "123456", "x"), (5001, "", None, None, "x"), reg[0]]
    residents = spark.createDataFrame(res, "resident_id long, full_name string, birthday_date string, document_id long, person_id string")
    docs = spark.createDataFrame([(r[3], f"{100000 + 7919 * r[0] % 899999}") for r in res], "document_id long, number string")
    members = people(residents, docs)
    found = link(spark.createDataFrame(reg, "registry_id long, full_name string, birth_date string, document_number string, person_id string"), members, residents)
    got = {(r.registry_id, r.resident_id) for r in members.join(found, "person_id").select("registry_id", "resident_id").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    assert found.groupBy("registry_id").count().filter("count > 1").count() == 0
    assert found.filter(~F.col("confidence").between(0.5, 1.0)).count() == 0
    assert link(spark.createDataFrame([], "registry_id long, full_name string, birth_date string, document_number string"), members, residents).count() == 0


def test_one_person_under_two_ids(spark):
    res, reg, truth = world()
    residents = spark.createDataFrame(res, "resident_id long, full_name string, birthday_date string, document_id long, x string")
    docs = spark.createDataFrame([(r[3], f"{100000 + 7919 * r[0] % 899999}") for r in res], "document_id long, number string")
    members = people(residents, docs)
    registry = spark.createDataFrame(reg, "registry_id long, full_name string, birth_date string, document_number string, person_id string")
    twice = {i for i in (4, 10, 12) if (1000 + i, i) in truth}
    copies = members.filter(F.col("resident_id").isin(list(twice))).withColumn("person_id", F.col("resident_id") - 90000)
    ids = [i - 90000 for i in twice]
    found = link(registry, members.unionByName(copies), residents)
    assert {(r.registry_id - 1000, r.person_id) for r in found.filter(F.col("person_id").isin(ids)).collect()} == {(i, i - 90000) for i in twice}
    assert found.filter(~F.col("person_id").isin(ids)).count() == link(registry, members, residents).count()
    brother = copies.withColumn("first", F.lit("тимур"))
    assert link(registry, members.unionByName(brother), residents).filter(F.col("person_id").isin(ids)).count() == 0


def test_undated_ids_of_one_name(spark):
    members = spark.createDataFrame([(1, "01.02.1980"), (2, None), (3, "07.03.1981"), (4, "05.05.1960"), (5, None)], "person_id long, birthday string")
    name = F.when(F.col("person_id") < 3, "зорин").otherwise("волков").alias("surname")
    members = members.select("person_id", name, F.lit("пётр").alias("first"), F.lit("ильич").alias("father"), "birthday", F.lit(None).cast("string").alias("number"))
    registry = spark.createDataFrame([(1, "зорин", "пётр", "ильич", "1980-02-01", None), (2, "волков", "пётр", "ильич", None, None)], "registry_id long, surname string, first string, father string, birth_date string, document_number string")
    assert {(r.registry_id, r.person_id) for r in candidates(registry, persons_of(members)).collect()} == {(1, 1), (1, 2)}
