from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowmill.llm.boosting import Boosted
from rowmill.llm.scans import _WHOLE, Forms, candidate_pairs, clean, close_words, corrections, count_corpus, cut_marks, difference, examine, fit_judges, furniture, hyphened_words, joined, noisy_token, odd_tokens, page_mark

FORMS = Forms(["форма учёта жильцов", "единый бланк продолжение"], ["субсидия нет"], ["кто-нибудь", *[f"{a}-{b}" for a in ("зорин", "север", "жилищно") for b in ("волков", "запад", "бытовой")]])
KNOWN = {"квартиры", "дом", "собственник", "просит", "справку", "проживания", "управление", "показал"}.__contains__


def sample():
    """Pages that leave no doubt: marks and headers, values of names, numbers before labels, words broken and closed."""
    out = []
    for i in range(80):
        out.append(f"Форма учёта жильцов\nЗорин Пётр Ильич\n{i % 90 + 10}\nОрганизация не указана.\nстр. {i % 9 + 1}\nтекст собственник квар-\nтиры просит справку\n{i % 7}\nСубсидия: нет\nтекст про дом - управление просит")
        out.append(f"Организация не указана.\nЛист {i % 9 + 1}\nтекст собственник\nВолков Иван\n{i % 50 + 10}\nуправ- ление показал")
    return out


JUDGES = fit_judges(sample(), FORMS, KNOWN)


@pytest.mark.parametrize(("token", "noisy"), [("свид€тельство", True), ("рай0на", True), ("форrnы", True), ("адp,есу", True), ("миr'рационного", True), ("па(порт", True), ("Наследііик", True), ("подал(а)", False), ("23к2с3", False), ("2-я", False), ("59/2", False), ("слово", False), ("№18", False)])
def test_tokens(token, noisy):
    assert noisy_token(token) == noisy


@pytest.mark.parametrize(("line", "mark"), [("Лист 2", True), ("— 1 —", True), ("[3]", True), ("с. 2/3", True), ("Страница 1 из 3", True), ("стр. 5", True), ("Лис7 2", True), ("50", False), ("1/2", False), ("кв. 5", False), ("Договор № 5", False), ("", False)])
def test_page_marks(line, mark):
    assert page_mark(line) == mark


def test_furniture_and_values():
    lines = ["Форма учёта жильцов   01.02.2030", "Зорин Пётр Ильич", "50", "Волков Иван", "ФОРМА УЧЁТА ЖИЛЬЦ0В", "33", "Организация не указана.", "7", "текст", "4", "Субсидия: нет"]
    assert furniture(lines, FORMS, JUDGES[0]) == ["header", "", "", "", "header", "", "", "pagenum", "", "", ""]


def test_words_are_closed_around_furniture():
    assert close_words(["собственник квар-", "тиры просит"], FORMS, KNOWN, JUDGES[1]) == (["собственник квартиры", "просит"], True)
    assert close_words(["кто-", "нибудь пришёл"], FORMS, KNOWN, JUDGES[1]) == (["кто-", "нибудь пришёл"], False)
    assert close_words(["Зорин-", "Волков Иван"], FORMS, KNOWN, JUDGES[1]) == (["Зорин-", "Волков Иван"], False)
    assert close_words(["квар- тиры"], FORMS, KNOWN, JUDGES[1]) == (["квартиры"], True)
    assert close_words(["дом - управление", "квар¬ тиры"], FORMS, KNOWN, JUDGES[1]) == (["дом - управление", "квартиры"], True)


def test_the_classifier_decides():
    # Without the classifier's verdict nothing is furniture and nothing is closed.
    never = lambda x: False
    assert furniture(["Форма учёта жильцов", "стр. 5"], FORMS, never) == ["", ""] and close_words(["квар-", "тиры"], FORMS, KNOWN, never)[1] is False
    empty = fit_judges([], Forms([], [], []), KNOWN)
    assert furniture(["стр. 5"], Forms([], [], []), empty[0]) in (["pagenum"], [""])


def test_difference():
    assert difference("домсвой", "домовой") == ("с", "о", 3, 3) and difference("а", "а") == ("", "", 1, 0)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    model = Boosted().fit(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:].astype(bool)).mean() > 0.95
    assert Boosted().fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5


WORDS = "собственник квартиры просит внести исправления заявитель приложил документы согласно журналу регистрации начисления произведены полностью".split()


def pages(n: int = 160):
    r = random.Random(2)
    rows, truth = [], {}
    for i in range(n):
        kinds = set()
        lines = ["Вид заселения:"]
        for _ in range(4):
            ws = r.choices(WORDS, k=7)
            lines += [" ".join(ws[:4]).capitalize(), " ".join(ws[4:]) + "."]
        if i % 4 == 0:
            lines[2] = lines[2].replace("о", "с", 1) if "о" in lines[2] else lines[2].replace("и", "п", 1)
            kinds.add("chars")
        if i % 5 == 0:
            a = lines[3]
            cut = r.randrange(3, 7)
            lines[3] = a[:cut].capitalize() + r.choice(["-", "¬", "- "])
            lines.insert(4, a[cut:])
            kinds.add("hyphen")
        if i % 2 == 0:
            lines.insert(r.choice([0, 3 if i % 5 else 0, len(lines)]), "Единый бланк (продолжение)")
            kinds.add("header")
        if i % 3 == 0:
            lines.append(f"Лист {i % 4 + 1}")
            kinds.add("pagenum")
        rows.append(("f", str(i), "\n".join(lines), "clash"))
        truth[str(i)] = kinds
    rows += [("f", "n", None, "x"), ("f", "e", "", "x"), ("f", "l", "слово " * 30000, "x"), ("g", "0", rows[0][2], "x")]
    return rows, truth


def test_clean(spark):
    rows, truth = pages()
    got = {(r.field_name, r.record_key): r for r in clean(spark.createDataFrame(rows, "field_name string, record_key string, text string, noise_kinds string"), repaired=True).collect()}
    assert len(got) == len(rows)
    wrong = [(k, set(got["f", k].noise_kinds), v) for k, v in truth.items() if set(got["f", k].noise_kinds) != v]
    assert len(wrong) <= 0.06 * len(truth), wrong[:5]
    assert got["f", "n"].noise_kinds == [] and got["f", "n"].text is None and got["f", "e"].text == ""
    assert got["g", "0"].noise_kinds == got["f", "0"].noise_kinds
    assert "бланк" not in got["f", "0"].text and "-" not in got["f", "5"].text


def test_empty(spark):
    assert clean(spark.createDataFrame([], "field_name string, record_key string, text string")).count() == 0


def test_short_words_meet(spark):
    pairs = [("вылан", "выдан"), ("отлел", "отдел"), ("дага", "дата"), ("вил", "вид"), ("пе", "не"), ("домы", "дом"), ("дм", "дом"), ("гоорд", "город")]
    words = spark.createDataFrame([(a, 2) for a, _ in pairs] + [(b, 900) for b in {b for _, b in pairs}], "key string, n long")
    got = {(r.word, r.meant) for r in candidate_pairs(words).collect()}
    assert set(pairs) <= got


def test_short_words_are_whole(spark):
    texts = spark.createDataFrame([("серия V-НВ номер 5, па(портист, пе8ать на дом",)], "text string")
    assert {r.key for r in count_corpus(texts).filter("kind = 'word'").collect()} == {"серия", "номер", "портист", "на", "дом", "па(портист", "пе8ать"}
    fixes = {"нв": "на", "вылан": "выдан", "пе": "не"}
    plain = Boosted().fit(np.zeros((0, 9)), np.zeros(0))
    assert examine("Серия V-НВ вылан", FORMS, fixes, {}.__contains__, JUDGES, plain) == ({"chars"}, "Серия V-НВ выдан")
    assert examine("Серия V-НВ", FORMS, fixes, {}.__contains__, JUDGES, plain) == (set(), "Серия V-НВ") and examine("пе дом", FORMS, fixes, {}.__contains__, JUDGES, plain)[1] == "не дом"


def test_corrections_end_at_a_right_word(spark):
    words = [("начисления", 5000), ("нацисления", 60), ("нациоления", 2), *[(w, 800) for w in WORDS]]
    r = random.Random(1)
    words += [(w.replace("с", "о", 1), r.randint(3, 9)) for w in WORDS if "с" in w] + [(w.replace("ч", "ц", 1), 8) for w in WORDS if "ч" in w and w != "начисления"]
    words = [x for x in words if x[0] != "начисления" or x[1] == 5000]
    fixes = {r.word: r.meant for r in corrections(spark.createDataFrame(words, "key string, n long"))[0].collect()}
    assert not set(fixes.values()) & set(fixes) and fixes.get("нациоления") in (None, "начисления")


@pytest.mark.parametrize(
    ("line", "rest", "kinds"),
    [
        ("паспорт 31 71 номер стр. 2 Единый бланк (продолжение) 836366, выдан", "паспорт 31 71 номер 836366, выдан", {"header", "pagenum"}),
        ("паспорт ФОРМА УЧЁТА ЖИЛЬЦ0В лист 3 из 6 выдан", "паспорт выдан", {"header", "pagenum"}), ("выдан - 2 - отделом", "выдан отделом", {"pagenum"}), ("выдан С7раница 3 отделом", "выдан отделом", {"pagenum"}),
        ("дом № 38, корпус 1, стр. 2, квартира 34", "дом № 38, корпус 1, стр. 2, квартира 34", set()), ("д. 4 стр. 2 кв. 3", "д. 4 стр. 2 кв. 3", set()), ("ул. Зорина, д. 4 - 98", "ул. Зорина, д. 4 - 98", set()),
        ("записано на листе 3 книги", "записано на листе 3 книги", set()), ("новая форма учёта жильцов введена", "новая форма учёта жильцов введена", set()),
    ],
)
def test_marks_inside_lines(line, rest, kinds):
    got = cut_marks(line, FORMS)
    assert (got[0], got[2]) == (rest, kinds)
    assert kinds <= examine(line, FORMS, {}, {}.__contains__, JUDGES)[0]


def test_no_hyphenated_word_is_left_out(spark):
    counts = spark.range(100_050).selectExpr("'hyphened' AS kind", "concat('кто-', id) AS key", "3L AS n", "0L AS hits")
    assert len(hyphened_words(counts)) == 100_050


def test_patterns_mean_what_they_say():
    rng = np.random.default_rng(11)
    signs = list("абвядисткоЁАФВІѵіaxZſ19037-¬ \n.,:(/')€@<№«_")
    token, suspect = re.compile(r"[^\s\"«»;:!?№\[\]]+"), re.compile(r"[іѵІѴ€@<]|[а-яё][A-Za-z'(/\d]|[A-Za-z'][а-яё]", re.I)
    whole = re.compile(r"[а-яё]{4,}|(?<![,\w@€<('/¬-])[а-яё]{2,3}(?![\w@€<('/¬-])")
    for _ in range(3000):
        text = "".join(rng.choice(signs, 40))
        assert odd_tokens(text) == [t for t in token.findall(text) if suspect.search(t) and noisy_token(t) and re.search("[а-яё]", t, re.I)]
        assert _WHOLE.findall(text.lower()) == whole.findall(text.lower())
        assert joined(text) == re.sub(r"(?<=[а-яё])\s?[-¬]\s?\n\s*(?=[а-яё])", "", text)


def test_counts_of_batches_are_handed_on_together(spark):
    texts = ["Сведения о жильцах\nпаспорт 12", "Сведения о жильцах\nпаспорт 13", None, ""] * 50
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = []

    class Seen:  # takes the Python stage out of the plan
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            batches = (pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10], pa.string())], names=["text"]) for i in range(0, len(texts), 10))
            rows.extend(r for b in run(batches) for r in b.to_pylist())
            return df.sparkSession.createDataFrame([(r["kind"], r["key"], r["n"], r["hits"]) for r in rows], schema)

    got = {tuple(r) for r in count_corpus(Seen()).collect()}
    assert len(rows) == len(got) and ("word", "паспорт", 100, 0) in got and got == {tuple(r) for r in count_corpus(df).collect()}
