from __future__ import annotations

import re

import pytest

from rowmill.llm.addresses import town_index
from rowmill.llm.pii import evidence, mentions, redact, scan, split_names

TOWNS = ["Вербоград", "Усолинск"]
INDEX = town_index(TOWNS)


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("EMAIL", "Почта ⟦kv1+x@box.invalid⟧."), ("EMAIL", "⟦a.ivanov (собака) mail.verbograd.example⟧ (редко)"), ("EMAIL", "на ⟦tamara48[at]korr.example⟧."), ("EMAIL", "⟦e.g @\nuprava.test⟧"),
        ("PHONE", "тел. ⟦+7 157 840.70.15⟧."), ("PHONE", "⟦8(201)168-71-41⟧ —"), ("PHONE", "(⟦8 (158) 441-50-74 доб. 58⟧)"), ("PHONE", "⟦8 170 676 49\n09⟧ —"), ("PHONE", "тел ⟦(265) 1564929⟧,"), ("PHONE", "после: ⟦211-49-32⟧,"), ("PHONE", "⟦+70743155427⟧."),
        ("ID_NUMBER", "паспорт ⟦21 58 № 565008⟧ x"), ("ID_NUMBER", "⟦0937№903057⟧;"), ("ID_NUMBER", "⟦II-ЕЕ № 683410⟧ выдан"), ("ID_NUMBER", "СНИЛС ⟦022-884-067 41⟧ внесён"), ("ID_NUMBER", "ИНН ⟦001117854066⟧ указан"),
        ("ADDRESS", "по адресу: ⟦г. Усолинск, ул. Док. Вяранкина,дом №26А,квартира 175⟧ пустует"), ("ADDRESS", "адрес ⟦страна Россия, г. Вербоград, Инж. Севилина пр-т, д 107, кор. 3, квартира 33⟧, конт"),
        ("ADDRESS", "(⟦гор. Вербоград Художника Роследцева 53Бк3 - 98⟧)"), ("ADDRESS", "адресу ⟦2-Й СТОРОЖЕВЫЙ ПЕР., ДОМ 14, КВАРТИРА 246⟧."), ("ADDRESS", "⟦Лазурный прзд,д. 95,квартира 268, город Вербоград⟧, конт"),
    ],
)
def test_settled_forms(kind, text):
    s, e = text.index("⟦"), text.index("⟧") - 1
    assert (kind, s, e) in scan(re.sub("[⟦⟧]", "", text), INDEX)[0]


@pytest.mark.parametrize(
    "text",
    ["Прибор учёта № 49-751090 опломбирован 14.03.2016.", "Кадастровый номер помещения 00:61:4939403:560.", "Номер записи акта 973525093526082503327 занесён", "регистрационный номер 90-26/7.",
     "На ул. 2-я Малиновая проведена сверка 68 карточек.", "Улица Мастера Ломедина в карточке записана", "Лицевой счёт 664480954348 закрыт", "По району Сиреневый Кут", ""],
)
def test_no_cases(text):
    assert scan(text, INDEX)[0] == []


def test_frames():
    assert evidence(["Зорин", "Пётр", "Ильич"]) == [("зорин", "S"), ("пётр", "F")]
    assert evidence(["Отправитель", "Зорин", "П.", "И."]) == [("отправитель", "?"), ("зорин", "?")]
    assert evidence(["Зорин", "П."]) == [("зорин", "S")] and evidence(["Улица"]) == [("улица", "-")]


def corpus():
    docs = []
    people = ["Зоринов", "Петрунов", "Сидоринов", "Кузнетов", "Лапинов", "Марков"]
    for i in range(60):
        p = people[i % 6]
        docs.append((i, f"Подпись: {p} А. Б.. Отправитель {p} В. Вид. Снят с учёта: {p} Пётр Иванович. Улица Ткацкая в карточке. Отправитель Н. О. {p} ушёл, спросить Вадик {p}, паспорт 12 34 № 567890; паспорт 1234567890, квитанция 1234567890 не оплачена.", "x"))
    return [*docs, (900, None, "x"), (901, "", "x"), (902, docs[0][1], "x"), (903, "слово " * 30000 + "a@b.cd", "x")]


def test_mentions_and_redaction(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, pii_type string")
    found = mentions(df, TOWNS).cache()
    text = {r[0]: r[1] for r in corpus()}
    got = {(r.pii_type, text[r.doc_id][r.start_pos : r.end_pos]) for r in found.filter("doc_id = 0").collect()}
    p = "Зоринов"
    assert got == {("NAME", x) for x in (f"{p} А. Б.", f"{p} В.", f"{p} Пётр Иванович", f"Н. О. {p}", f"Вадик {p}")} | {("ID_NUMBER", "12 34 № 567890"), ("ID_NUMBER", "1234567890")}
    assert {(r.start_pos, r.pii_type) for r in found.filter("doc_id = 903").collect()} == {(180000, "EMAIL")}
    same = [sorted(tuple(r[1:]) for r in found.filter(f"doc_id = {d}").collect()) for d in (0, 902)]
    assert same[0] == same[1]
    clean = {r.doc_id: r for r in redact(df, found).collect()}
    assert clean[0].text.startswith("Подпись: [NAME]. Отправитель [NAME] Вид. Снят с учёта: [NAME]. Улица Ткацкая") and "квитанция 1234567890" in clean[0].text
    assert clean[900].text is None and clean[901].text == "" and len(clean) == 64


def test_empty(spark):
    assert mentions(spark.createDataFrame([], "doc_id long, text string"), TOWNS).count() == 0


@pytest.mark.parametrize(("kinds", "cuts"), [("WII", []), ("IIW", []), ("WIIWII", [3]), ("WIIIIW", [3]), ("IIWIIW", [3]), ("WWPWWP", [3]), ("WPWWPW", [3]), ("WIIW", []), ("WWP", []), ("WPW", []), ("WWPWII", [3])])
def test_second_names(kinds, cuts):
    assert split_names(kinds) == cuts


def test_every_name_of_a_run(spark):
    rows = [*corpus(), (910, "Подпись: Зоринов П.Р. Перезвонить Е. Р. Петрунов", "x"), (911, "Подпись: П.Т.Зоринов\nВручено Маркову Лапинов А. В.", "x")]
    found = mentions(spark.createDataFrame(rows, "doc_id long, text string, pii_type string"), TOWNS).filter("doc_id >= 910")
    text = {r[0]: r[1] for r in rows}
    assert {text[r.doc_id][r.start_pos : r.end_pos] for r in found.collect()} == {"Зоринов П.Р.", "Е. Р. Петрунов", "П.Т.Зоринов", "Лапинов А. В."}


def test_what_stands_in_most_texts_discloses_nobody(spark):
    footer = "Справочная +7 900 111-22-33."
    own = {i: f"Звоните +7 9{i % 90 + 10} 555-{i // 90 + 10}-{i % 90 + 10}, спасибо. " for i in range(6000)}
    texts = [(i, own[i] + (footer if i % 20 else "")) for i in range(6000)]
    third = [(i, t + (" Запасной 8-900-222-33-44." if i % 3 == 0 else "")) for i, t in texts]
    found = mentions(spark.createDataFrame(third, "doc_id long, text string"), []).collect()
    text = dict(third)
    said = [text[r.doc_id][r.start_pos : r.end_pos] for r in found]
    assert not any("111-22-33" in x for x in said)  # in 19 of 20 texts
    assert sum("222-33-44" in x for x in said) == 2000  # a third of all texts have it: still a person's
    assert sum("555" in x for x in said) == 6000
    none = mentions(spark.createDataFrame(texts, "doc_id long, text string"), [], least_bits=0.0).count()
    assert none == 6000 + 5700
