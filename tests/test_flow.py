from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from rowmill.operators import pipeline as L
from rowmill.sources import ports
from rowmill.sources.sinks import save_attempts

TEXT1 = "по состоянию на 22.01.2026 г.\nЗорин Пётр Ильич, заявитель\nпо адресу:\nул. Подольская ул. дом № 25 кв. 252\nПрежнее наименование\nВид заселения: частная собственность\nФ. И. О. владельца\nЗорин Пётр Ильич\n100\nна основании:\nДоговор 1"
TEXT2 = "Фамилия Имя Дата рождения Паспорт\n" + "Зорин Пётр".ljust(44) + "01.02.1990" + " " * 50 + "паспорт РФ № 114735 45 23, выдан УФМС 01.09.2022\nСубсидия: нет"


def test_parse_from_pages_to_record(spark):
    rows = [(1, 1, None, TEXT1.encode()), (1, 2, None, TEXT2.encode()), (2, 1, "x.png", b""), (3, 1, None, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, image_path string, image binary")
    got = {r.doc_id: r for r in L.parse(pages).collect()}
    assert set(got) == {1, 2, 3} and got[1].pages == 2
    one = got[1]
    assert (one.page_1.document_date, one.page_1.settlement_type, one.page_1.owners[0].full_name, one.page_1.property_address.apartment) == ("22.01.2026", "частная собственность", "Зорин Пётр Ильич", "252")
    people = one.page_2.registered_persons_constantly.persons
    assert [(p.full_name, p.birthday_date) for p in people] == [("Зорин Пётр Ильич", "01.02.1990")] and one.page_2.benefits == "нет"
    assert list(one.warnings) == [] and list(got[2].warnings) == ["page_1 is missing"] and got[3].page_2.registered_persons_constantly["count"] == 0
    assert one.metadata.extraction_trace.persons[0].full_name_confidence == 1.0 and set(one.metadata.ocr_preview) == {"page_1", "page_2"}
    assert L.parse(pages.limit(0)).count() == 0


def test_temporary_people(spark):
    text = f"x {L.TEMPORARY[0]}: Волкова Анна 01.01.1980 Петровна паспорт Серов Олег 02.02.1990 {L.TEMPORARY[1]} Лапин Иван 03.03.1993"
    got = spark.range(1).select(L.temporary_people(F.lit(text)).alias("p"), L.temporary_people(F.lit("нет")).alias("n"), L.benefits(F.lit(text)).alias("b"), L.benefits(F.lit(None).cast("string")).alias("z")).first()
    assert [(p.full_name, p.birthday_date) for p in got.p] == [("Волкова Анна Петровна", "01.01.1980"), ("Серов Олег", "02.02.1990")] and got.n == [] and got.b == "нет" and got.z is None


def test_callbacks(spark):
    jobs = spark.createDataFrame([("a", "completed", "u", None), ("b", "failed", "u", None), ("c", "completed", None, None), ("d", "running", "u", None), ("e", "completed_with_errors", "u", "broken")], "job_id string, status string, callback_url string, error string")
    files = spark.createDataFrame([("a", 2, "z", "completed", "{}", None), ("a", 1, "y", "completed", "{}", None), ("b", 1, "x", "failed", None, "bad"), ("e", 1, "w", "failed", None, "worse")], "job_id string, file_index int, filename string, status string, extracted_data_json string, error string")
    got = {r.job_id: (r.status, r.filename, r.error) for r in L.callbacks(jobs, files).collect()}
    assert got == {"a": ("completed", "y", None), "b": ("failed", None, "bad"), "e": ("failed", None, "broken")}


def test_ports_and_attempts(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, None, "слово два".encode())], "doc_id long, page_number int, image_path string, image binary")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 0, 10, 10), (1, 1, 1, 0, 0, 5, 5)], "doc_id long, page_number int, crop int, left int, top int, right int, bottom int")
    parts = ports.crops(pages, boxes, lambda image, box: image if box[2] > 5 else b"x")
    assert {(r.crop, r.text) for r in ports.crop_texts(parts, "mock").collect()} == {(0, "слово два"), (1, "x")}
    assert ports.recognize(pages, "tesseract").count() == 0
    for bad in (lambda: ports.preprocess(pages, ("x",)), lambda: ports.recognize(pages, "x")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    save_attempts(spark.createDataFrame([("a.pdf", 1)], "filename string, page_count int"), str(tmp_path / "out"), "20320101_000000")
    assert spark.read.json(str(tmp_path / "out")).first().attempt == "20320101_000000_a"
    assert L.inspect(spark.createDataFrame([("a",)], "filename string")).first().page_count == 0


def test_engine_hands_on_words_in_small_batches(monkeypatch):
    monkeypatch.setattr(ports, "BATCH_WORDS", 100, raising=False)
    texts = [f"слово{i}  два\n три" for i in range(1000)] + [None, "", "я " * 250]
    pages = pa.RecordBatch.from_arrays([pa.array(range(1003), pa.int64()), pa.array([1] * 1003, pa.int32()), pa.array([t and t.encode() for t in texts], pa.binary())], names=["doc_id", "page_number", "image"])
    got = list(ports.mock()(iter([pages])))
    assert max(len(b) for b in got) <= 350  # a line isn't divided
    rows = [r for b in got for r in b.to_pylist()]
    assert len(rows) == 3250 and [(r["ord"], r["text"], r["polygon"]) for r in rows[:3]] == [
        (0, "слово0", [[0, 0], [72, 0], [72, 24], [0, 24]]), (1, "два", [[96, 0], [132, 0], [132, 24], [96, 24]]), (2, "три", [[12, 40], [48, 40], [48, 64], [12, 64]])
    ]
