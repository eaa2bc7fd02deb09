from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowmill.operators import layout as L
from rowmill.operators.lines import clean_lines, join_continuations, keep_first, records, slice_between

SCHEMA = "doc_id long, page_number int, ord int, text string, confidence double, left int, top int, width int, height int, anchor_id string"


def make(seed=3, n=120):
    r = random.Random(seed)
    return [(r.randrange(3), r.randrange(1, 3), i, r.choice(["слово", "01.02.2003", "№ 5", "x"]), 0.9, r.randrange(0, 2400), r.choice(range(0, 400, 7)), r.randrange(10, 90), 24, "clash") for i in range(n)]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(make(), SCHEMA)


def pages():
    out: dict = {}
    for w in make():
        out.setdefault(w[:2], []).append(w)
    return out


def test_greedy_lines_equal_a_loop(spark, words):
    want = {}
    for k, ws in pages().items():
        groups: list = []
        for w in sorted(ws, key=lambda w: (w[6], w[5], w[2])):
            if groups and w[6] - groups[-1][0][6] <= 18:
                groups[-1].append(w)
            else:
                groups.append([w])
        for g in groups:
            want[(*k, g[0][6])] = " ".join(x[3] for x in sorted(g, key=lambda w: (w[5], w[6], w[2])))
    assert {(r.doc_id, r.page_number, r.line_top): r.line_text for r in L.greedy_lines(words, 18).collect()} == want


def test_gap_clusters_equal_a_loop(words):
    want = {}
    for k, ws in pages().items():
        by: dict = {}
        for w in ws:
            by.setdefault(w[6], []).append(w)
        for t, row in by.items():
            right, n = None, 0
            for w in sorted(row, key=lambda w: (w[5], w[2])):
                n += right is not None and w[5] - right > 140
                right = max(right or 0, w[5] + w[7])
                want[w[2]] = n
    assert {r.ord: r.cluster for r in L.gap_clusters(words).collect()} == want


def test_row_bands_equal_a_nested_loop(words):
    marks = L.anchors(words, "^01")
    at: dict = {}
    for r in marks.collect():
        at.setdefault((r.doc_id, r.page_number), []).append(r.anchor_top)
    want = {w[2]: max((a for a in at.get(w[:2], []) if a - 18 <= w[6]), default=None) for w in make()}
    assert {r.ord: r.anchor_top for r in L.row_bands(words.drop("anchor_id"), marks).collect()} == {k: v for k, v in want.items() if v is not None}


def test_boxes_columns_and_bounds(spark, words):
    for r in L.bounding_boxes(words, "doc_id", "page_number").collect():
        ws = pages()[r.doc_id, r.page_number]
        assert (r.box_left, r.box_right, r.n_words) == (min(w[5] for w in ws), max(w[5] + w[7] for w in ws), len(ws))
    crops = L.crop_bounds(L.bounding_boxes(words, "doc_id", "page_number"), 5000, 40, 60, 2480, 3508)
    assert crops.filter("crop_left < 0 OR crop_right > 2480 OR crop_right <= crop_left OR crop_bottom <= crop_top").count() == 0
    assert {r.column_name for r in L.assign_columns(words, [("a", 0, 100)]).select("column_name").distinct().collect()} == {"a", None}


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (L.page_text(none), L.greedy_lines(none), L.gap_clusters(none), L.anchors(none, "x"), L.row_bands(none, L.anchors(none, "x")), L.adaptive_column(none, "x"), L.nearest_word(none, "x", 1)):
        assert df.count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb  c"), (4, "я" * 50000)], "doc_id long, text string")
    got = [(r.doc_id, r.text[:3], r.left, r.top) for r in L.words_of_texts(docs).orderBy("doc_id", "ord").collect()]
    assert got == [(3, "a", 0, 0), (3, "b", 0, 80), (3, "c", 36, 80), (4, "яяя", 0, 0)]


def test_lines(spark):
    df = spark.createDataFrame([("  a \n___\n\nb--c\n - ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(clean_lines("t")).collect()] == [["a", "b--c"], None, []]
    cut = lambda t: spark.createDataFrame([(t,)], "l array<string>").select(slice_between(F.col("l"), "^S", "^E")).first()[0]
    assert cut(["x", "S", "S2", "a", "b", "E", "c"]) == ["a", "b"] and cut(["a", "E"]) == ["a"] and cut(["a"]) == ["a"] and cut([]) == [] and cut(["S"]) == []
    rows = spark.createDataFrame([(1, 0, "z"), (1, 1, "N1"), (1, 2, "t"), (1, 3, "N2"), (2, 0, None)], "doc_id long, line_no int, line string")
    assert {(r.record_no, r.record_text) for r in records(rows, "^N").collect()} == {(1, "N1 t"), (2, "N2")}
    joined = join_continuations(rows.filter("doc_id = 1"), ["doc_id"], "line_no", "line", F.col("line").startswith("N"))
    assert {r.line for r in joined.collect()} == {"z", "N1 t", "N2"}
    same = spark.createDataFrame([(1, 0, "A"), (1, 1, "a"), (1, 2, "b")], "doc_id long, n int, s string")
    assert sorted(r.s for r in keep_first(same, ["doc_id"], F.lower("s"), "n").collect()) == ["A", "b"]
