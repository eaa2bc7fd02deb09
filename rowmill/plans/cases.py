"""Queries over stated cases: literals in, and in the SQL the literal results they must have.

The other queries run the same operators over whole tables; these hold what an operator has to
make of texts that the tables don't have, so that operator and SQL can't share a misreading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions import text as T
from rowmill.operators import departures as P
from rowmill.operators import housing as H
from rowmill.operators import identity as D
from rowmill.operators import issuers as I
from rowmill.operators import persons as N
from rowmill.operators import reconcile as R
from rowmill.operators import rows as W
from rowmill.operators.jobs import final_status

MOSCOW = "ГУ МВД России по г. Москве"
LYUBLINO = "Люблинский отдел ЗАГС Управления ЗАГС Москвы"
# (text, result)
ISSUERS = [
    ("по г. Москве Люблинский", MOSCOW), ("TPI N3 ОУФМС России по Московской обл. в Haрo- Фоминском p-ne", "ТП №3 ОУФМС России по Московской обл. в Наро-Фоминском р-не"), ("ГУ МВД России по г. Москкве", MOSCOW),
    ("ОТДЕЛЕНИЕМ ПО РАЙОНУ МАРЬИНО УФМС РОССИИ ПО ГОР. МОСКВЕ В ЮВАО", "ОТДЕЛЕНИЕМ ПО РАЙОНУ МАРЬИНО УФМС РОССИИ ПО ГОР. МОСКВЕ В ЮВАО"), ("ОТДЕЛОМ УФМС РОС СИИ ПО ГОР. MOCKBE ПО РАЙОНУ МА- РЬИНО", "ОТДЕЛОМ УФМС РОССИИ ПО ГОР. МОСКВЕ ПО РАЙОНУ МАРЬИНО"),
    ("Отделением по р-ну Выхино ОУФМС России по г. Москве в ЮВАО", "Отделением по р-ну Выхино ОУФМС России по г. Москве в ЮВАО"), ('ОВД "Лефортово" города Москвы', "ОВД Лефортово гор. Москвы"), ("ГУ МВД России по Воронежской области", "ГУ МВД России по Воронежской области"),
    ("УМВД России по Тверской области", "УМВД РОССИИ по Тверской области"), ("посольство", "посольство"), (None, None),
]
CIVIL = [
    ("Люблинский отдел ЗАГС Управления ЗАГС Моск- вы", LYUBLINO), ("3АГС Чертановский отдел гор. Москвы", "Чертановский отдел ЗАГС Управления ЗАГС Москвы"), ("Министерство, Ашкелон, Израиль", "Отдел ведения населения г. Ашкелон, Израиль"),
    ("НЕИЗВЕСТЕН. конверт ация", "неизвестен. конвертация"), ("ГЛАВНОЕ УПРАВЛЕНИЕ ЗАГС РЯЗАНСКОЙ ОБЛАСТИ", "Главное управление ЗАГС Рязанской области"), (None, None),
]
FAMILIES = [(MOSCOW, "GU_MVD"), ("УФМС России", "UFMS"), ("МВД России УФМС", "UFMS"), ("Азнакаевским ГРОВД", "OVD"), ("ЗАГС", None)]
DISTRICTS = [('ОВД "МАРЬИНО" г. Москвы', "Марьино"), ("УФМС по району ВЫХИНО-ЖУЛЕБИНО ГОР. Москвы", "Выхино-Жулебино"), ("ОВД Сокольники г. Москвы", "Сокольники"), ("ЗАГС", None)]
# (text, kind, series, number, issued_by, issue_date)
DOCUMENTS = [
    (f"IV-МЮ № 711341 {LYUBLINO} 19.05.2009", D.CERTIFICATE, "IV-МЮ", "711341", LYUBLINO, "19.05.2009"),
    (f"паспорт РФ № 114735 45 23, выдан {MOSCOW} 01.09.2022", D.PASSPORT, "45 23", "114735", MOSCOW, "01.09.2022"),
    ("паспорт РФ 45 23 998632 выдан ГУ МВД России по г. Москкве 30.01.2024", D.PASSPORT, "45 23", "998632", MOSCOW, "30.01.2024"),
    ("паспорт РФ № 111111 4510, выдан ОВД 01.02.2003 паспорт РФ № 222222 4511, выдан УФМС 05.06.2011", D.PASSPORT, "45 11", "222222", "УФМС", "05.06.2011"),
    ("справка № 123456 45 01, выдан неизвестен конвертация 02.03.2001", D.REFERENCE, "45 01", "123456", "неизвестен. конвертация", "02.03.2001"),
    ("слова без документа", None, None, None, None, None),
]
UNMARKED = [(f"IV-МЮ № 711341 {LYUBLINO} 19.05.2009", "19.05.2009", LYUBLINO), ("паспорт РФ № 114735 45 23 УФМС 01.09.2022", "01.09.2022", "45 23 УФМС"), ("ЗАГС города 01.09.2022", None, None)]
SERIES = [("IV - МЮ", "IV-МЮ", 3), ("Х-АB", "X-АВ", 3), ("II-", "II-", 2), ("45", "45", 1)]
NAMES = [
    ("Наумова Вален тинаФоминична", "Наумова Валентина Фоминична"), ("Пучков Константин Валентиноб", "Пучков Константин Валентинович"), ("Иванов Александр Михайлоб", "Иванов Александр Михайлович"), ("Данильченко Дмитрий Юрьеб", "Данильченко Дмитрий Юрьевич"),
    ("Зорина Анна Петроб", "Зорина Анна Петровна"), ("Зорин", "Зорин"), (None, None),
]
SCRIPTS = [("Дмiтrиevич", "Дмитриевич"), ("Ha", "На"), ("Moscow", "Moscow"), ("Кукса Максим Дмiтrиevич", "Кукса Максим Дмитриевич"), (None, None)]
# (name, candidates, result)
CANDIDATES = [
    ("Зорин Пётр Ильич", "Зорин Пётр Ильич|Волков Иван Олегович", "Зорин Пётр Ильич"), ("Зорин П И", "Зорин Пётр Ильич|Волков Иван Олегович", "Зорин Пётр Ильич"), ("Зорин Пётр", "Зорин Пётр Ильич", "Зорин Пётр Ильич"),
    ("Волков", "Зорин Пётр Ильич|Волков Иван Олегович", "Волков Иван Олегович"), ("Зорин", "Зорин Пётр Ильич|Зорин Олег Ильич", None), ("Зорина Анна Ильинична", "Зорин Пётр Ильич", None), (None, "Зорин Пётр Ильич", None),
]
REGISTERED = [("без реги- страции", "without_registration"), ("без\nрегистрации.", "without_registration"), ("Без регистрац", "without_registration"), ("снят", "registered"), (None, "registered")]
# (text, reason, death_date, departure_date, act number, act date, issued_by, destination, scheme)
DEPARTURES = [
    ("умер 01.02.2020, a/3 17020 00001 от 03.02.2020 оф. Отдел ЗАГС", "death", "01.02.2020", None, "1702000001", "03.02.2020", "Отдел ЗАГС", None, "pre_egr_local_record"),
    ("дата смерти 05.01.2021 а/з 170219770000100080007 от 06.01.2021", "death", "05.01.2021", None, "170219770000100080007"[:21], "06.01.2021", None, None, "egr_zags_2018"),
    ("умерла 05.01.19", "death", "05.01.2019", None, None, None, None, None, "unknown"),
    ("по отрывному талону формы 6, г. Тверь, ул. Мира, д. 1, 05.06.2019", "form_6_stub", None, "05.06.2019", None, None, None, "г. Тверь, ул. Мира, д. 1", None),
    ("Выбыла", "other", None, None, None, None, None, None, None), ("проживает", None, None, None, None, None, None, None, None),
]
DATES = [("01.02.2020", "01.02.2020"), ("01.02.20", "01.02.2020"), ("01022020.2020", "01.02.2020"), ("2020.02.01", None), (None, None)]
STREETS = [
    ("ул. Подольская ул.", "ул. Подольская"), ("ул. Новочеркасский бульвар", "б-р Новочеркасский"), ("ul. Донецкая", "ул. Донецкая"), ("Рязанский просп.", "пр-кт Рязанский"), ("Перерва улица", "ул. Перерва"), ("Луговой проезд", "пр. Луговой"), ("Кривой переулок:", "пер. Кривой"), (None, None),
]
# (lines, full, street, house, building, structure, apartment)
ADDRESSES = [
    ("ул. Подольская ул. дом № 25 корп. ____ строение ____ кв. 252", "ул. Подольская, дом 25, кв. 252", "ул. Подольская", "25", None, None, "252"),
    ("ненужное зачеркнуть|257|ул. Перерва|дом № 12A корп. 3 кв.", "ул. Перерва, дом 12А, корп. 3", "ул. Перерва", "12А", "3", None, None),
    ("слова", None, None, None, None, None, None),
]
COMPANIES = [
    ('ООО "Управление Многоквартирными Домами"|адрес: 109651, страна Россия, г. Москва, ул. Новочеркасский б-р, дом. 20, кор. 3, телефон: +7(495)7294310', 'ООО "Управление Многоквартирными Домами"', "109651, страна Россия, г. Москва, ул. Новочеркасский б-р, дом 20, корп. 3", "+7(495)729-43-10"),
    ("О00 <Дом>", 'ООО "Дом"', None, None),
]
OWNERS = [
    ("Гуманцев Андрей Викторович|без опред. долей|Гуманцев Виктор Андреевич|без опред. долей", "частная собственность", None, "Гуманцев Андрей Викторович=без опред. долей|Гуманцев Виктор Андреевич=без опред. долей"),
    ("Зорин Пётр Ильич", "частная собственность", None, "Зорин Пётр Ильич=100.00"), ("Зорин Пётр Ильич", "социальный наем", None, ""), ("слова", "частная собственность", "Зорин Пётр Ильич", "Зорин Пётр Ильич=100.00"), ("Зорин Пётр Ильич|50,5", "ЖСК", None, "Зорин Пётр Ильич=50.50"),
]
STATES = [(2, 2, 0, "completed"), (2, 1, 1, "completed_with_errors"), (2, 0, 2, "completed_with_errors"), (2, 1, 0, "running")]
LEFT = [("паспорт", 1180, 100, 120), ("РФ", 1310, 100, 60), ("№", 1180, 136, 30), ("114735", 1220, 136, 120), ("45", 1360, 136, 50), ("23", 1420, 136, 50), ("ГУ", 1180, 172, 50), ("МВД", 1240, 172, 80), ("России", 1330, 172, 110), ("по", 1450, 172, 40), ("г.", 1500, 172, 30), ("Москве", 1540, 172, 110), ("01.09.2022", 1180, 208, 150)]
SECOND = [("паспорт", 1660, 100, 120), ("РФ", 1790, 100, 60), ("№", 1660, 136, 30), ("514299", 1700, 136, 120), ("45", 1840, 136, 50), ("23", 1900, 136, 50)]
REST = [("Отделом", 1246, 471, 160), ("УФМС", 1246, 525, 120), ("по", 1246, 579, 40), ("району", 1330, 579, 130), ("Выхино-Жулебино", 1246, 633, 300), ("26.08.2011", 1246, 687, 180), ("Отделением", 1494, 471, 210), ("по", 1494, 525, 40), ("р-ну", 1545, 525, 70), ("Выхино", 1494, 579, 130), ("19.05.2010", 1494, 687, 180)]
ROWS = {
    "two_documents": LEFT + SECOND, "continuation": REST,
    "mixed_name": [("Кукса", 120, 100, 120), ("Максим", 260, 100, 120), ("Дмiтrиevич", 120, 136, 180)],
    "split_name": [("Максимова", 120, 100, 170), ("Све-", 320, 100, 90), ("тлана", 120, 136, 110), ("Николаев-", 250, 136, 170), ("Ha", 120, 172, 60)],
    "birth_place": [("Авдонян", 120, 100, 160), ("Анна", 310, 100, 110), ("Альбертовна", 120, 136, 220), ("04.11.1970", 520, 100, 150), ("Баку", 710, 94, 100)],
}
# (case, name, birthday, series, number, leftmost words)
READ = [
    ("two_documents", None, None, "45 23", "114735", None), ("continuation", None, None, None, None, "Отделом УФМС по району Выхино-Жулебино 26.08.2011"), ("mixed_name", "Кукса Максим Дмитриевич", None, None, None, None),
    ("split_name", "Максимова Светлана Николаевна", None, None, None, None), ("birth_place", "Авдонян Анна Альбертовна", "04.11.1970", None, None, None),
]
BEFORE = ("паспорт", "45 10", "016428", "тинская, ОВД РАЙООТДЕЛЕЖарминНА МАРЬИНИЕМ ПО p-н п/o ский RAЙOUV шо гоrо г", "18.09.1998", "паспорт РФ № 016428 45 10, выдан тинская ... 18.09.1998")
UFMS_NAME = "ОТДЕЛЕНИЕМ ПО РАЙОНУ МАРЬИНО УФМС РОССИИ ПО ГОР. МОСКВЕ В ЮВАО"
AFTER = ("паспорт", "45 10", "016428", UFMS_NAME, "09.02.2009", f"паспорт РФ № 016428 45 10, выдан {UFMS_NAME} 09.02.2009")
SHORT = ("паспорт", "45 11", "386018", None, None, None)
CLEAN = ("паспорт", None, None, "Отделом УФМС России по гор. Москве по району Выхино-Жулебино", "26.08.2011", None)
NOISY = ("паспорт", "45 11", "386018", "Отделением по р-ну Выхино ОУФМС России по г. Москве в ЮВАО", "26.08.2011", None)
CHILD = (D.CERTIFICATE, "IV-МЮ", "711341", LYUBLINO, "19.05.2009", f"свидетельство о рождении № 711341 IV-МЮ, выдан {LYUBLINO} 19.05.2009")
CUT = (D.CERTIFICATE, "IV-МЮ", "711341", "СКВЫ", "19.05.2009", "СКВЫ 19.05.2009")


def _frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {columns}")


def _one(rows: list[tuple], operator):
    return lambda s, d: _frame(s, [r[:1] for r in rows], "x string").select("id", operator(F.col("x")).cast("string").alias("got"))


def q_documents(s, d):
    return _frame(s, [r[:1] for r in DOCUMENTS], "x string").select("id", D.read_cell(F.col("x")).alias("d")).select("id", "d.document_type", "d.series", "d.number", "d.issued_by", "d.issue_date")


def q_unmarked(s, d):
    return _frame(s, [r[:2] for r in UNMARKED], "x string, at string").select("id", D.issuer_without_mark(F.col("x"), F.col("at")).alias("got"))


def q_series(s, d):
    made = D.certificate_series(F.col("x"))
    return _frame(s, [r[:1] for r in SERIES], "x string").select("id", made.alias("got"), D.series_quality(made).cast("long").alias("quality"))


def q_candidates(s, d):
    return _frame(s, [r[:2] for r in CANDIDATES], "x string, c string").select("id", R.best_candidate(F.col("x"), F.split("c", "\\|")).alias("got"))


def q_departures(s, d):
    x = _frame(s, [r[:1] for r in DEPARTURES], "x string").select("id", P.read(F.col("x")).alias("d"))
    return x.select("id", *[F.col(f"d.{c}") for c in ("reason", "death_date", "departure_date", "act_record_number", "act_record_date", "issued_by", "destination_address", "scheme")])


def q_addresses(s, d):
    return _frame(s, [r[:1] for r in ADDRESSES], "x string").select("id", H.address(F.split("x", "\\|")).alias("a")).select("id", "a.*")


def q_companies(s, d):
    return _frame(s, [r[:1] for r in COMPANIES], "x string").select("id", H.company(F.split("x", "\\|")).alias("c")).select("id", "c.*")


def q_owners(s, d):
    own = H.owners(F.split("x", "\\|"), F.col("kind"), F.col("who"))
    return _frame(s, [r[:3] for r in OWNERS], "x string, kind string, who string").select("id", F.array_join(F.transform(own, lambda o: F.concat_ws("=", o["full_name"], o["share"])), "|").alias("got"))


def q_states(s, d):
    return _frame(s, [r[:3] for r in STATES], "total int, completed int, failed int").select("id", final_status(F.col("total"), F.col("completed"), F.col("failed")).alias("got"))


def q_rows(s, d):
    words = [(c, t, top, left, w) for c, ws in ROWS.items() for t, left, top, w in ws]
    df = _frame(s, words, "case string, text string, top int, left int, width int").withColumn("ord", F.col("id").cast("int")).withColumn("height", F.lit(24))
    r = W.row_words(df, ["case"])
    w = F.col("words")
    document = F.when(F.col("case") == "two_documents", W.document_of(w))
    name = F.when(F.col("case").isin("mixed_name", "split_name", "birth_place"), W.full_name(F.filter(w, lambda x: x["left"] < 560)))
    birthday = F.when(F.col("case") == "birth_place", W.primary_date(w, F.lit(100), 500, 930)["text"])
    return r.select("case", name.alias("full_name"), birthday.alias("birthday"), document.alias("d"), F.when(F.col("case") == "continuation", W.raw_text(W.leftmost_cluster(w))).alias("leftmost")).select("case", "full_name", "birthday", "d.series", "d.number", "leftmost")


def _document(row: tuple):
    return D.document(**{f: F.lit(v) for f, v in zip(D.FIELDS, row)})


def q_merges(s, d):
    one = s.range(1)
    rest = F.lit(f"№ 016428 45 10, выдан {UFMS_NAME} 09.02.2009")
    at = lambda n, c: one.select(F.lit(n).alias("case"), c["issued_by"].alias("issued_by"), c["issue_date"].alias("issue_date"))
    return at("continued", D.continued(_document(BEFORE), rest, _document(AFTER))).unionByName(at("enriched", D.enrich_passport(_document(SHORT), _document(CLEAN), _document(NOISY)))).unionByName(
        at("subject", R.subject_document(_document(CHILD), _document(CUT), F.lit("Евдокимова Арина Викторовна"), F.lit("Евдокимова Арина Викторовна")))
    )




def _values(rows: list[tuple], columns: list[str], types: dict[str, str] | None = None) -> str:
    """SQL of the stated rows."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    kind = lambda c: (types or {}).get(c, "VARCHAR")
    return f"SELECT {', '.join(f'CAST({c} AS {kind(c)}) AS {c}' for c in columns)} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def _numbered(rows: list[tuple], columns: list[str], types: dict[str, str] | None = None) -> str:
    return _values([(i, *r) for i, r in enumerate(rows)], ["id", *columns], {"id": "BIGINT"} | (types or {}))


_ONES = {
    "issuer_cases": (ISSUERS, I.registered_issuer), "civil_issuer_cases": (CIVIL, I.civil_issuer), "family_cases": (FAMILIES, I.family), "district_cases": (DISTRICTS, I.district), "name_cases": (NAMES, R.registered_name), "script_cases": (SCRIPTS, T.name_words),
    "registration_cases": (REGISTERED, N.registration_status), "date_cases": (DATES, P.whole_date), "street_cases": (STREETS, H.street),
}
QUERIES = {k: _one(rows, f) for k, (rows, f) in _ONES.items()} | {
    "document_cases": q_documents, "unmarked_issuer_cases": q_unmarked, "series_cases": q_series, "candidate_cases": q_candidates, "departure_cases": q_departures, "address_cases": q_addresses, "company_cases": q_companies, "owner_cases": q_owners, "state_cases": q_states, "row_cases": q_rows, "merge_cases": q_merges,
}
ORACLE = {k: _numbered([r[1:] for r in rows], ["got"]) for k, (rows, _) in _ONES.items()} | {
    "document_cases": _numbered([r[1:] for r in DOCUMENTS], ["document_type", "series", "number", "issued_by", "issue_date"]), "unmarked_issuer_cases": _numbered([r[2:] for r in UNMARKED], ["got"]), "series_cases": _numbered([r[1:] for r in SERIES], ["got", "quality"], {"quality": "BIGINT"}),
    "candidate_cases": _numbered([r[2:] for r in CANDIDATES], ["got"]), "departure_cases": _numbered([r[1:] for r in DEPARTURES], ["reason", "death_date", "departure_date", "act_record_number", "act_record_date", "issued_by", "destination_address", "scheme"]),
    "address_cases": _numbered([r[1:] for r in ADDRESSES], ["full", "street", "house", "building", "structure", "apartment"]).replace("full", '"full"'), "company_cases": _numbered([r[1:] for r in COMPANIES], ["name", "address", "phone"]), "owner_cases": _numbered([r[3:] for r in OWNERS], ["got"]), "state_cases": _numbered([r[3:] for r in STATES], ["got"]),
    "row_cases": _values(READ, ["case", "full_name", "birthday", "series", "number", "leftmost"]).replace("case", '"case"'),
    "merge_cases": _values([("continued", UFMS_NAME, "09.02.2009"), ("enriched", CLEAN[3], "26.08.2011"), ("subject", LYUBLINO, "19.05.2009")], ["case", "issued_by", "issue_date"]).replace("case", '"case"'),
}
