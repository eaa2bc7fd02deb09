"""Operators of issuers, documents, departures, rows, page 1 and reconciliation: what the stated
cases of ``plans/cases.py`` don't hold (nulls, empty and long texts, ties, repeated rows, clashing columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import departures as P
from rowmill.operators import housing as H
from rowmill.operators import identity as D
from rowmill.operators import issuers as I
from rowmill.operators import reconcile as R
from rowmill.operators import rows as W


def each(spark, values, *operators):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*[o(F.col("x")).alias(f"c{i}") for i, o in enumerate(operators)]).collect()]


def test_nulls_empty_and_long_texts(spark):
    values = [None, "", "слово " * 20000]
    for row in each(spark, values, I.registered_issuer, I.civil_issuer, I.district)[:1]:
        assert row == (None, None, None)
    kinds = each(spark, values, D.kind, P.act_number, H.street)
    assert kinds[0] == (None, None, None) and kinds[2][0] is None
    assert each(spark, values, lambda x: D.read_cell(x)["number"], lambda x: P.read(x)["reason"]) == [(None, None)] * 3
    assert each(spark, ["слово " * 5000 + "паспорт РФ № 114735 45 23, выдан УФМС 01.09.2022"], lambda x: D.read_cell(x)["number"]) == [("114735",)]


def test_candidates_by_hints(spark):
    raw = "паспорт № 114735 4523, выдан УФМС 01.09.2022"
    hinted = F.create_map(F.lit("46"), F.lit(3))
    got = spark.range(1).select(D.best_passport(F.lit(raw), F.lit("01.09.2022")).alias("a"), D.best_passport(F.lit(raw), F.lit("01.09.2022"), hinted).alias("b"), D.best_passport(F.lit("45 10 слова 123456"), F.lit(None).cast("string")).alias("c")).first()
    assert (got.a.series, got.b.series, got.c.series, got.c.number) == ("45 23", "46 23", "45 10", "123456")


def test_merge_points_and_completeness(spark):
    none = F.lit(None).cast(D.DOCUMENT)
    one = D.document(document_type=F.lit(D.PASSPORT), series=F.lit("45 23"), number=F.lit("114735"))
    got = spark.range(1).select(D.completeness(none), D.merge_points(none), D.completeness(one), D.merge_points(one), D.best_of(D.merge_points, none, one, one)["number"], W.quality(none), W.read_again(one), W.replaces(one, none)).first()
    assert tuple(got) == (0, 0, 3, 42, "114735", 0.0, True, True)


def test_departures_compared(spark):
    none = F.lit(None).cast(P.DEPARTURE)
    short = P.read(F.lit("умер 01.02.2020 а/з 123"))
    full = P.read(F.lit("умер 01.02.2020 а/з 170219770000100080007 от 03.02.2020 оф. Отдел ЗАГС"))
    got = spark.range(1).select(P.completeness(none), P.completeness(short), P.better(full, short), P.better(none, short), P.may_go_on(short), P.read_again(short), P.quality(full), P.continued(short, F.lit(""), none)["act_record_number"]).first()
    assert tuple(got) == (0, 3, True, False, True, True, 3.2, "123")


def test_rows_cut_and_crop(spark):
    words = [(1, 100, "Зорин", 20, 90), (1, 100, "Пётр", 130, 90), (1, 136, "Ильич", 20, 90), (1, 100, "01.02.1990", 520, 150), (1, 100, "паспорт", 1200, 100), (1, 136, "№", 1200, 20), (1, 136, "114735", 1230, 120), (1, 136, "умер", 2100, 60), (2, 100, "слово", 20, 80)]
    df = spark.createDataFrame([(d, top, i, t, left, w, 24, "x") for i, (d, top, t, left, w) in enumerate(words)], "id int, top int, ord int, text string, left int, width int, height int, words string")
    rows = W.row_words(df.drop("words"), ["id"]).withColumn("anchor_top", F.lit(100))
    got = {r.id: r for r in W.read_rows(rows).collect()}
    assert list(got) == [1] and (got[1].full_name, got[1].birthday_date, got[1].document.document_type, got[1].departure.reason) == ("Зорин Пётр Ильич", "01.02.1990", D.PASSPORT, "death")
    w = F.col("words")
    r = rows.filter("id = 1").select(W.box(w).alias("b"), F.size(W.clusters(w)).alias("n"), W.crop("row_right", F.lit(None).cast("struct<left:int,top:int,width:int,height:int>"), W.box(w), 2480, 3508).alias("c"), W.begins_departure(w).alias("gone")).first()
    assert tuple(r.b) == (20, 100, 2140, 60) and r.n == 4 and tuple(r.c) == (20 + 963 - 80, 76, 2240, 184) and r.gone
    empty = W.row_words(df.limit(0).drop("words"), ["id"]).withColumn("anchor_top", F.lit(1))
    assert W.read_rows(empty).count() == 0
    adaptive = W.adaptive_columns(rows.filter("id = 1").withColumn("doc", F.lit(1)), ["doc"]).first()
    assert (adaptive.birth_left, adaptive.document_left) == (485, 1170)


def test_bounds_are_worked_out_once_a_row_in_the_filter(spark):
    rows = W.row_words(spark.createDataFrame([(1, 100, 0, "слово", 20, 80, 24)], "id int, top int, ord int, text string, left int, width int, height int"), ["id"]).withColumn("anchor_top", F.lit(100))
    lines = W.read_rows(rows)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [line for line in lines if line.lstrip(" :+-").startswith("Filter")]
    n = filters[-1].count("паспорт|свидетель|выдан|мвд")  # what a row's bounds look for
    assert 0 < n <= 4, n


PEOPLE = f"key long, d int, full_name string, birthday_date string, document {D.DOCUMENT}, unregistered boolean"


def test_parses_merge_by_birthday(spark):
    doc = lambda n: (D.PASSPORT, "45 10", n, "УФМС", "01.02.2010", "паспорт РФ")
    one = spark.createDataFrame([(1, 7, "Зорин П", "01.01.1990", None, False), (2, 7, "Волков Иван Ильич", None, None, False), (3, 7, "Лапин Олег", "02.02.1991", None, False), (4, 8, None, "01.01.1990", None, False)], PEOPLE)
    two = spark.createDataFrame([(11, 7, "Зорин Пётр Ильич", "01.01.1990", doc("123456"), False), (12, 7, "Лапин Олег Ильич", "02.02.1991", doc("222222"), False), (13, 7, "Серов Иван Ильич", "02.02.1991", doc("333333"), False)], PEOPLE)
    got = {r.key: (r.full_name, r.document and r.document.number) for r in R.merge_parses(one, two, ["d"], "key").collect()}
    assert got == {1: ("Зорин Пётр Ильич", "123456"), 2: ("Волков Иван Ильич", None), 3: ("Лапин Олег Ильич", "222222"), 4: (None, None)}
    assert R.merge_parses(one.limit(0), two, ["d"], "key").count() == 0 and R.merge_parses(one, two.limit(0), ["d"], "key").count() == 4


def test_reconcile(spark):
    people = spark.createDataFrame([(1, 7, "Зорин Пётр", "01.01.1990", None, False), (2, 7, "Волкова А", "01.01.1980", None, True), (3, 7, "Серов", "01.01.2015", None, False), (4, 8, "Лапин Ол-", "01.01.1970", None, False)], PEOPLE)
    page = spark.createDataFrame([(7, ["Зорин Пётр Ильич", "Серов Иван Олегович"], None, None), (8, ["Громов Иван Ильич"], None, None)], f"d int, candidates array<string>, subject string, page1_document {D.DOCUMENT}")
    got = {r.key: r.full_name for r in R.reconcile(people, page, ["d"]).collect()}
    assert got == {1: "Зорин Пётр Ильич", 3: "Серов", 4: "Громов Иван Ильич"}  # 2 has no registration, 3 is too young to be matched
    assert R.reconcile(people.limit(0), page, ["d"]).count() == 0


def test_managed_buildings(spark):
    rows = spark.createDataFrame([(1, "ул. Мира", "5", None), (2, "улица Мира", None, "2"), (3, "ул. Мира", "9", None), (4, "Луговой пр-д.", None, None), (5, None, "5", None), (6, "УЛ. МИРА", "5", "1")], "id int, street string, house string, building string")
    managed = spark.createDataFrame([("ул. Мира", "5", "1"), ("ул. Мира", "7", "2"), ("Луговой пр-д", "12", "2")], "street string, house string, building string")
    got = {r.id: (r.house, r.building) for r in H.resolve_buildings(rows, managed).collect()}
    assert got == {1: ("5", "1"), 2: (None, "2"), 3: ("9", None), 4: ("12", "2"), 5: ("5", None), 6: ("5", "1")}


def test_page_lines(spark):
    lines = F.array(*[F.lit(x) for x in ("Зорин Пётр Ильич, адрес", "Паспортные данные:", "паспорт РФ 45 23", "998632 выдан ОВД 30.01.2004", "«Марьино»", "паспорт РФ 11 11")])
    docs = F.array(*[F.lit(x) for x in ("Государственного реестра прав", "Выписка из", "Договор 1", "(указывается)")])
    got = spark.range(1).select(H.applicant(lines), F.array_join(H.passport_lines(lines), "|"), F.array_join(H.document_lines(docs), "|"), H.stops_documents(F.lit("(указывается)")), H.leading_number(F.array(F.lit("12"), F.lit("x"))), H.standalone_number(F.array(F.lit("x"), F.lit("7"), F.lit("8")), F.lit("7"))).first()
    assert tuple(got) == ("Зорин Пётр Ильич", "паспорт РФ 45 23|998632 выдан ОВД 30.01.2004|«Марьино»", "Выписка из Государственного реестра прав|Договор 1|(указывается)", True, "12", "8")
