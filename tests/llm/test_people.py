from __future__ import annotations

import itertools

import numpy as np
import pytest

from rowmill.llm.names import Lexicon, likelihood, read_name
from rowmill.llm.people import BodyWords, COSTS, SIGNS, bodies, body_channel, learn_body_words, people, read_body, roots, variant_pairs

FIRST = {"иван": 50, "петр": 50, "анна": 50, "олга": 50, "зинаида": 20, "алина": 20, "алла": 20, "олег": 30}
FATHER = {"иванович": 50, "петрович": 40, "ивановна": 50, "петровна": 40, "олегович": 20, "олеговна": 20}
LEX = Lexicon(FIRST, FATHER)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Зорькин Иван Петрович", ("зоркин", "иван", "петрович")), ("ИВАН ПЕТРОВИЧ ЗОРЬКИН", ("зоркин", "иван", "петрович")), ("Zorkin Ivan Petrovich", ("зоркин", "иван", "петрович")),
        ("ЗорькинИван Петрович", ("зоркин", "иван", "петрович")), ("Зорькин Иванпетрович", ("зоркин", "иван", "петрович")), ("Зорь- кин И. П.", ("зоркин", "и.", "п.")), ("И.П. Зорькин", ("зоркин", "и.", "п.")),
        ("Зорькина Зина", ("зоркина", "зинаида", "")), ("Зорькина Аля Петр.", ("зоркина", "алина|алла", "петр.")), ("Зорькин Ивна Петрвоич", ("зоркин", "иван", "петрович")), ("Зорькин Олег Петровб", ("зоркин", "олег", "петрович")),
        ("Halbrick, Clemens", ("клеменс халбрикк", "", "")), ("", ("", "", "")), (None, ("", "", "")), ("...", ("", "", "")),
    ],
)
def test_read_name(text, want):
    assert read_name(text, LEX) == want


def test_long_name_does_not_hang():
    assert read_name("Зорькин " * 5000, LEX)[0]
    assert read_name("барон фон дер " + "Зорькин " * 9 + "Иван Петрович", LEX)[1:] == ("иван", "петрович")


def test_likelihood():
    full = ("зоркин", "иван", "петрович")
    assert likelihood(full, full, LEX) == 0
    assert likelihood(("зоркин", "и.", ""), full, LEX) > likelihood(("зоркен", "и.", ""), full, LEX) > -5
    for other in (("зоркин", "петр", "петрович"), ("зоркин", "иван", "иванович"), ("волков", "иван", "петрович"), ("зоркин", "о.", "петрович")):
        assert likelihood(other, full, LEX) is None


RESIDENTS = "resident_id long, full_name string, birthday_date string, document_id long, number string"


def test_people(spark):
    names = ["Зорькин Иван Петрович"] * 3 + ["Зорькин И. П.", "Зоркьин Иван Петрович", "Zorkin Ivan Petrovich", "Иван Петрович Зорькин"]
    rows = [(i, n, "01.01.1990", None, "x") for i, n in enumerate(names)]
    rows += [(10, "Зорькин Пётр Петрович", "01.01.1990", None, "x"), (11, "Зорькина Анна Петровна", "01.01.1990", None, "x"), (12, "Зорькин Иван Петрович", "02.02.1991", 5, "x"), (13, "Зорькин Иван", None, 6, "x"), (14, None, "01.01.1990", None, "x"), (15, "Волков Олег Иванович", None, None, "x"), (16, "ВОЛКОВ ОЛЕГ ИВАНОВИЧ", "03.03.1993", None, "x"), (17, "", None, None, "x")]
    rows += [(100 + i, f"Сидоров{'а' if i % 2 else ''} {f} {p}", "05.05.1970", None, "x") for i, (f, p) in enumerate([("Иван", "Петрович"), ("Анна", "Петровна"), ("Пётр", "Иванович"), ("Анна", "Ивановна"), ("Олег", "Олегович"), ("Алла", "Олеговна")] * 8)]
    docs = spark.createDataFrame([(5, "12З456", None), (6, "123456", None), (7, None, None)], "document_id long, number string, full_name string")
    got = people(spark.createDataFrame(rows, RESIDENTS), docs)
    who = {r.resident_id: r.person_id for r in got.collect()}
    assert len({who[i] for i in range(7)}) == 1
    assert len({who[0], who[10], who[11], who[12]}) == 4
    assert who[13] == who[12]  # by the number of the document
    assert who[15] == who[16]  # the only person of that name
    assert 14 not in who and len(who) == len(rows) - 1
    pairs = {tuple(r) for r in variant_pairs(got.filter("resident_id < 7"), "person_id", "resident_id", "full_name").collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(range(7), 2) if names[a] != names[b]}


def test_empty(spark):
    df = spark.createDataFrame([], RESIDENTS)
    assert people(df, df.select("document_id", "number")).count() == 0
    assert bodies(spark.createDataFrame([], "card_id long, issued_by string, n_docs int")).count() == 0


WORDS = BodyWords(tuple("сельский отдел записи учета граждан поселковый паспортный пункт".split()))


@pytest.mark.parametrize(
    ("text", "want"),
    [("Сельский отдел записи и учёта граждан № 018, посёлок Ивовка", ("18", "созуг", "ивовка")), ("(ИВОВКА), СЕЛ. ОТД. ЗАПИСИ И УЧАТА ГР-Н N 18", ("18", "созуг", "ивовка")), ("СОЗУГ номер 18 п.Ивовка", ("18", "созуг", "ивовка")), ("Поселковый п/пункт Ивовка №7", ("7", "ппп", "ивовка")), (None, ("", "", "")), ("", ("", "", ""))],
)
def test_read_body(text, want):
    assert read_body(text, WORDS) == want


def test_bodies(spark):
    rows = [(1, "Управление миграционного учёта № 7, посёлок Нижнеивовка", 9), (2, "УМУ N 07 Нижнеивовка", 1), (3, "Упр. миграц. учёта п. Нжинеивовка № 7", 1), (4, "Управление миграционного учёта № 8, посёлок Нижнеивовка", 2), (5, "Поселковый паспортный пункт № 7, посёлок Нижнеивовка", 2), (6, "Управление миграционного учёта № 7, посёлок Старопрудье", None), (7, None, 1)]
    got = {r.card_id: r.body_id for r in bodies(spark.createDataFrame(rows, "card_id long, issued_by string, n_docs int")).collect()}
    assert got[1] == got[2] == got[3] and len(set(got.values())) == 4 and 7 not in got


def test_body_words_are_learned(spark):
    kinds = ["Управление миграционного учёта", "Поселковый паспортный пункт"]
    rows = [(i, f"{kinds[i % 2]} № {i % 40 + 1}, посёлок Ново{'абвгдежзик'[i % 10]}рск{'овоинская'[i % 7 : i % 7 + 3]}", 1) for i in range(400)]
    got = learn_body_words(spark.createDataFrame(rows, "card_id long, issued_by string, n_docs int"))
    assert got == ("миграционного", "паспортный", "поселковый", "пункт", "управление", "учета")


def test_channel_is_learned():
    seen = np.zeros((COSTS, SIGNS))
    seen[1:4, 0] = 200, 150, 90  # typing errors
    seen[3:, 1:] = 40  # other bodies
    seen[0, 3], seen[COSTS - 1, 0] = 10, 30
    like, post = body_channel(seen, 0.2)
    assert (post[1:4, 0] > 0.5).all() and post[0, 3] < 0.5 and post[COSTS - 1, 0] < 0.5 and (np.diff(like[1:5, 0]) < 0).all()


def test_roots_follow_long_chains(spark):
    n = 100
    nodes = spark.range(n).withColumnRenamed("id", "node")
    parents = nodes.filter("node > 0").selectExpr("node", "node - 1 AS parent")
    assert {(r.node, r.root) for r in roots(nodes, parents).collect()} == {(i, 0) for i in range(n)}
