from __future__ import annotations

import itertools

import pytest

from rowmill.llm.addresses import house_number, inherit, known_town, link_addresses, parse, read_addresses, same_place_pairs, town_index
from rowmill.llm.chars import deletes, osa, plain

TOWNS = ["Вербоград", "Усолинск", "Сычёвка"]
INDEX = town_index(TOWNS)
LEVELS = ("town", "kind", "street", "house", "building", "structure", "flat")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("010155, г. Вербоград, Лётчика Искрукова,д. 59,корп. 4,кв 96", "вербоград None летчика_искрукова 59 4 None 96"),
        ("страна Россия, г. Усолинск, у. Инж. Рослобцева 23к2с3 - 10", "усолинск ул инженера_рослобцева 23 2 3 10"),
        ("Ручейное ш. 50, 173, гор. Вебоград", "вербоград ш ручейное 50 None None 173"),
        ("Г.ВЕРБОГРАД, КВ. 369, У.АМБАРНАЯ, Д. 27 К. 5", "вербоград ул амбарная 27 5 None 369"),
        ("Сычёвка, пер 2-й Ольховый д.65/2 стр. - кв. № 58", "сычевка пер 2-я_ольховый 65/2 None None 58"),
        ("Мас. Ломедина пр-д 58Б - 268", "None пр-д мастера_ломедина 58б None None 268"),
        ("ул. Снежная, дом № 8８, корп. ____, кв. 1​2", "None ул снежная 88 None None 12"),
        ("", " ".join(["None"] * 7)),
        (None, " ".join(["None"] * 7)),
    ],
)
def test_parse(text, want):
    got = parse(text, INDEX)
    assert " ".join(str(got[k]).replace(" ", "_") for k in LEVELS) == want


def test_small_parts():
    assert house_number("З0") == "30" and house_number("0О".replace("0", "1")) == "10" and house_number(" _ ") is None and house_number("12A") == "12а"
    assert known_town("усолниск", INDEX) == "усолинск" and known_town("дома", INDEX) is None
    assert plain("№ 5​ x") == "№ 5 x" and osa("ab", "ba") == 1 and osa("abc", "xyz", 1) == 2 and deletes("ab", 2) == {"ab", "a", "b", ""}


def test_long_text_is_read_whole():
    assert parse("слово " * 20000 + "ул. Снежная, д. 5, кв. 7", INDEX)["flat"] == "7"


COLUMNS = "address_record_id long, street string, house string, building string, structure string, apartment string, full_address string, place_id string"


def test_links_like_brute_force(spark):
    rows = [
        (1, "ул. Снежная", "5", None, None, "7", "г. Вербоград, ул. Снежная, дом № 5, кв. 7", "x"),
        (2, None, None, None, None, None, "Снежная 5 - 7", "x"),
        (3, "ул. Снежная", "5", "____", "-", "7", None, "x"),
        (4, "ул. Сежная", "5", "", None, "7", "Вербоград, Сежная ул, д 5, кв. 7", "x"),
        (5, "ул. Снежная", "5", "1", None, "7", None, "x"),
        (6, "ул. Снежная", "5", None, "1", "7", None, "x"),
        (7, "пер. Снежный", "5", None, None, "7", None, "x"),
        (8, None, "5", None, None, None, "г. Усолинск, ул. Снежная, дом № 5, кв. 7", "x"),
        (9, None, None, None, None, None, None, "x"),
        (10, "ул. 2-я Снежная", "5", None, None, "7", None, "x"),
        (11, "ул. Снежная", "5", None, None, None, None, "x"),
        (12, None, None, None, None, None, "Снежная улица 5/2 - 7", "x"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    parts = {"street": "street", "house": "house", "building": "building", "structure": "structure", "flat": "apartment"}
    levels = read_addresses(df, "address_record_id", "full_address", parts, TOWNS)
    places = link_addresses(levels, "address_record_id")
    got = {tuple(r) for r in same_place_pairs(places, "address_record_id").collect()}
    assert got == set(itertools.combinations((1, 2, 3, 4), 2))
    assert places.count() == 10  # 9 and 11 don't reach down to a flat
    assert link_addresses(levels.limit(0), "address_record_id").count() == 0


def test_missing_levels_inherit_candidates(spark):
    rows = [(i, None, None, None, None, None, a, "x") for i, a in enumerate(["ул. Снежная, д. 5, кв. 7", "ул. Снежная, д. 5, кв. 8", "ул. Снежная, д. 6, кв. 1", "ул. Снежная, д. 5", "ул. Снежная, д. 6", "ул. Снежная", "ул. Дальняя, д. 1", "Снежная, кв. 8", None])]
    levels = read_addresses(spark.createDataFrame(rows, COLUMNS), "address_record_id", "full_address", {}, TOWNS)
    places = link_addresses(levels, "address_record_id")
    got = {r.address_record_id: (r.place_id, r.n_candidates) for r in inherit(levels, places, "address_record_id").collect()}
    assert got[3] == (None, 2) and got[5] == (None, 3) and got[6] == (None, 0) and got[4] == (got[2][0], 1) and got[7] == (got[1][0], 1) and 8 not in got


def test_established_streets_stay_apart(spark):
    rows = [(i, None, None, None, None, None, f"ул. Мастера {n}, д. 1, кв. 1", "x") for i, n in enumerate(["Брусарина"] * 6 + ["Брусаркина"] * 6 + ["Бпусарина"])]
    levels = read_addresses(spark.createDataFrame(rows, COLUMNS), "address_record_id", "full_address", {}, TOWNS)
    ids = {r.address_record_id: r.place_id for r in link_addresses(levels, "address_record_id").collect()}
    assert len({ids[i] for i in range(6)}) == 1 and ids[12] == ids[0] != ids[6]


def test_open_street_types_stay_sets(spark):
    texts = ["ул. Дубомина, д. 1, кв. 1", "пер. Дубомина, д. 2, кв. 1", "Дубомина, д. 2, кв. 1", "ул. Дубомина, д. 3, кв. 1", "пер. Дубомина, д. 3, кв. 1", "Дубомина, д. 3, кв. 1"]
    texts += ["Дубомина, д. 4, кв. 1", "Дубомина, д. 4, кв. 1", "Дубомина, д. 3", "пер. Дубомина, д. 3", "пр. Лазурный, д. 1, кв. 1", "пр-д Лазурный, д. 2, кв. 1", "пр-т Лазурный, д. 1, кв. 1"]
    rows = [(i, None, None, None, None, None, a, "x") for i, a in enumerate(texts)]
    levels = read_addresses(spark.createDataFrame(rows, COLUMNS), "address_record_id", "full_address", {}, TOWNS)
    places = link_addresses(levels, "address_record_id")
    got = {tuple(r) for r in same_place_pairs(places, "address_record_id").collect()}
    assert got == {(1, 2), (6, 7), (10, 12)}  # 5 may be 3 or 4
    ids = {r.address_record_id: (r.place_id, r.n_candidates) for r in inherit(levels, places, "address_record_id").collect()}
    assert len(ids) == len(texts) and ids[5] == (None, 2) == ids[8] and ids[9] == (ids[4][0], 1)
