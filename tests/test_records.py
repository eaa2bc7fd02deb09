from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from rowmill.operators import idoc as D
from rowmill.operators import jobs as J
from rowmill.operators import matching as M
from rowmill.operators import persons as P
from rowmill.operators.page1 import read_page1
from rowmill.sources import ports, sinks
from rowmill.streaming import jobs as S
from rowmill.tables import latest


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("паспорт: серия 06 09 номер 398771, выдан 21.10.2003, Отдел Зари", ("passport", "06 09", "398771", "21.10.2003", "Отдел Зари")),
        ("свидетельство о рожде-\nнии VIII-МС 458704 кем выдан: Отдел, дата выдачи 10.11.2029", ("birth_certificate", "VIII-МС", "458704", "10.11.2029", "Отдел")),
        ("паспорт 31 38 № 202076 выдан ОВД Зари 30.10.2027", ("passport", "31 38", "202076", "30.10.2027", "ОВД Зари")), ("справка номер 123456", ("reference", None, "123456", None, None)), ("", (None, None, None, None, None)), ("31.02.2030", (None, None, None, None, None)),
    ],
)
def test_documents(spark, raw, want):
    r = D.read_documents(spark.createDataFrame([(1, raw, "x")], "id long, raw string, series string"), "id", "raw").first()
    assert (r.document_type, r.series, r.number, r.issue_date, r.issued_by) == want


def test_null_cells_and_departures(spark):
    assert D.read_documents(spark.createDataFrame([(1, None)], "id long, raw string"), "id", "raw").count() == 0
    rows = [(1, "умер 25.11.2024 запись акта 97055176 13951348 02694 от 26.11.2024"), (2, "выбыл по отрывному талону формы 6 23.05.2029"), (3, "умер 01.01.2010 запись акта 12 от 02.01.2010"), (4, ""), (5, None), (6, "умер")]
    got = {r.id: r for r in D.read_departures(spark.createDataFrame(rows, "id long, raw string"), "id", "raw").collect()}
    assert (got[1].act_record_number, got[1].scheme, got[1].passed) == ("970551761395134802694", "egr_zags_2018", True)
    assert (got[2].reason, got[2].departure_date, got[2].scheme) == ("form_6_stub", "23.05.2029", "unknown") and got[3].scheme == "pre_egr_local_record" and got[4].reason == "other" and 5 not in got and got[6].death_date is None


def test_continuation_takes_the_fuller_reading(spark):
    df = spark.createDataFrame([(1, "паспорт 31 38 № 202076", "выдан Отдел 30.10.2027"), (2, None, None)], "id long, first_raw string, next_raw string")
    got = {r.id: r for r in D.merge_continuation(df, "id").collect()}
    assert got[1].n_fields == 5 and got[1].issued_by == "Отдел"


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", "done", "2030-01-01", "x"), ("b", "run", "2031-01-01", "x"), ("c", None, None, "x")], "job_id string, status string, created_at string, pages string").withColumn("created_at", F.to_timestamp("created_at"))
    files = spark.createDataFrame([("a", 0, "f", "completed", 2), ("a", 1, "f", "failed", None), ("b", 0, "g", "queued", None)], "job_id string, file_index int, filename string, status string, pages int")
    assert {(r.status, r.n) for r in J.status_counts(jobs).collect()} == {("done", 1), ("run", 1), (None, 1), ("total", 3)}
    c = J.file_counts(files)
    state = {r.job_id: r.s for r in c.select("job_id", J.final_status(F.col("total_files"), F.col("completed_files"), F.col("failed_files")).alias("s")).collect()}
    assert state == {"a": "completed_with_errors", "b": "running"}
    assert [(r.job_id, r.file_names) for r in J.newest(jobs, files, 2).orderBy(F.col("created_at").desc()).collect()] == [("b", "g"), ("a", "f|f")]
    assert {r.job_id for r in J.retained(jobs, files, F.lit("2031-06-01").cast("timestamp"), 300).collect()} == {"b"}
    came = spark.createDataFrame([("b", 0, "failed", 1), ("b", 0, "completed", 2)], "job_id string, file_index int, status string, at int")
    assert {(r.job_id, r.file_index, r.status) for r in J.merge_results(files, came, ["job_id", "file_index"]).collect()} == {("a", 0, "completed"), ("a", 1, "failed"), ("b", 0, "completed")}
    assert J.status_counts(jobs.limit(0)).first() is None or J.status_counts(jobs.limit(0)).first().n == 0


def test_latest_counts_a_key_once(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, None, None)], "id long, v string, at int")
    assert {tuple(r) for r in latest(df, ["id"], "at", ["id", "v"]).collect()} == {(1, "b"), (2, None)}


def test_matching(spark):
    texts = spark.createDataFrame([(1, "дом у Белого Яра, Белый Яр"), (2, None), (3, ""), (4, "белый ярус")], "id long, t string")
    entries = spark.createDataFrame([("Белый Яр",), ("Белый",), ("",)], "name string")
    assert {tuple(r) for r in M.longest_containment(texts, "id", "t", entries, "name").collect()} == {(1, "Белый Яр"), (4, "Белый")}
    ref = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "k string, p int, v int")
    rows = spark.createDataFrame([("a", 1), ("x", 3), ("x", 9)], "k string, p int")
    assert {(r.k, r.p, r.v) for r in M.exact_or_unique(rows, ref, ["k", "p"], "p", "v").collect()} == {("a", 1, 10), ("x", 3, 30), ("x", 9, None)}


def test_persons(spark):
    df = spark.createDataFrame([("Зорин Пётр Ильич",), ("Зорин Petr",), ("",), (None,), ("Документ",)], "n string")
    assert [tuple(r) for r in df.select(P.name_score(F.col("n")), P.suspicious(F.col("n"))).collect()] == [(12, False), (-6, True), (-20, True), (-20, True), (-14, True)]
    people = spark.createDataFrame([(1, "Зорин П"), (1, "Волков"), (2, "Зорин Пётр")], "d int, full_name string")
    cands = spark.createDataFrame([(1, "Зорин Пётр Ильич"), (1, "Волков Иван"), (1, "Лапин Олег Ильич"), (2, "Зорин Олег Ильич"), (2, "Зорин Иван Ильич")], "d int, candidate string")
    got = P.complete_names(people, cands, ["d"])
    assert {(r.full_name, r.matched) for r in got.collect()} == {("Зорин П", "Зорин Пётр Ильич"), ("Волков", "Волков Иван"), ("Зорин Пётр", None)}  # a lone surname takes the only candidate of it
    assert [r.candidate for r in P.unused(cands, got, ["d"]).orderBy("d", F.desc("candidate")).collect()] == ["Лапин Олег Ильич", "Зорин Олег Ильич", "Зорин Иван Ильич"]
    assert [r[0] for r in spark.createDataFrame([("без реги-\nстрации",), (None,)], "t string").select(P.registration_status(F.col("t"))).collect()] == ["without_registration", "registered"]


PAGE = "по состоянию на 05.03.2031 г.\nСеверный административный округ Район Яр\nпо адресу:\nул. Образцовая, дом № 12\nВид заселения: ЖСК\nФ. И. О. владельца\nЗорин Пётр Ильич\n50\nВолков Иван\n1/2\nОрганизация, управляющая:\nООО \"Дом\"\nна основании:\nДоговор № 1 от\n01.01.2001\nСвидетельство № 2"


def test_page1(spark):
    got = {r.id: r for r in read_page1(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id long, t string"), "id", "t").collect()}
    r = got[1]
    assert (r.document_date, r.settlement_type, r.owners, r.n_documents, r.first_document, r.company) == ("05.03.2031", "ЖСК", "Зорин Пётр Ильич=50|Волков Иван=1/2", 2, "Договор № 1 от 01.01.2001", 'ООО "Дом"')
    assert got[2].n_owners == got[3].n_owners == 0


def test_ports_and_sinks(spark, tmp_path):
    for n, t in ((10, "раз два"), (2, "три"), ("x", " ")):
        (tmp_path / f"{n}.pdf").write_text(t)
    docs = ports.documents(spark, str(tmp_path))
    assert [r.filename for r in docs.orderBy(*ports.numeric_first(F.col("filename"))).collect()] == ["2.pdf", "10.pdf", "x.pdf"]
    words = ports.recognize(ports.render(docs, "one_page"), "mock")
    assert sorted(r.text for r in words.collect()) == ["два", "раз", "три"]
    for bad in (lambda: ports.render(docs, "none"), lambda: ports.recognize(docs, "none")):
        with pytest.raises(ValueError):
            bad()
    out = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int"), out, sort_by=["k"])
    new = sinks.upsert(spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, at int"), out, ["k"], "at")
    assert {(r.k, r.v) for r in spark.read.parquet(new).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["a", "b"]


def test_stream_reaches_the_batch_result(spark, tmp_path):
    rows = [(i, f"2030-01-01 00:{i % 60:02d}:00", i % 5, "ab"[i % 2], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "events.parquet")
    df.repartition(4).write.parquet(path)
    got = {tuple(r) for r in S.replay_states(spark, path).collect()}
    assert got == {tuple(r) for r in J.latest_state(df, "user_id", "event_type", "ts", "event_id").collect()}
    seen: list = []
    S.run(S.windowed_counts(S.event_stream(spark, path, 10)), lambda b, n: seen.extend(b.collect()), "update")
    assert sum(r.n for r in seen) >= 100
    sent = str(tmp_path / "sent")
    os.makedirs(sent)
    S.callback_sink(lambda x: open(f"{sent}/{abs(hash(x))}", "w").write(x))(df.limit(3), 0)
    assert len(os.listdir(sent)) == 3
