from __future__ import annotations

import json

from pyspark.sql import functions as F

from rowmill.operators.nested import EXTRACTED, METADATA, label_nodes, link, node_table, walk

KEYS = ["job_id", "file_index"]
PERSON = {"full_name": "Тестов Тест", "passport": {"series": "00 01", "raw": None}, "departure": {"status": None, "validation": {"scheme": None}}}


def paths(value, spec=EXTRACTED):
    return [r[2] for r in walk(value if value is None or isinstance(value, str) else json.dumps(value), spec, "x") if r[1] not in ("page_1", "page_2")]


def test_places_wrappers_and_lone_values():
    doc = {"page_1": {"owners": {"full_name": "А"}, "ownership_documents": ["a", None, "b"], "passport": {"raw": None}},
           "page_2": {"registered_persons_constantly": [PERSON, None, PERSON], "registered_persons_temporary": {"persons": {"0": PERSON, "2": {}}}}}
    want = [
        "page_1.owners[0]", "page_1.ownership_documents[0]", "page_1.ownership_documents[2]",
        *[f"page_2.registered_persons_constantly.persons[{i}]{t}" for i in (0, 2) for t in (".passport", "")],
        "page_2.registered_persons_temporary.persons[0].passport", "page_2.registered_persons_temporary.persons[0]",
        "page_2.registered_persons_temporary.persons[2]",
    ]
    assert paths(doc) == want
    assert paths({"payload": doc}) == want
    assert paths(json.dumps(json.dumps(doc))) == want
    inner = dict(doc, page_2=json.dumps(doc["page_2"]))
    assert paths({"result": {"extracted_data": inner}}) == want


def test_departure_counts_by_any_deep_field():
    deep = {"page_2": {"registered_persons_constantly": {"persons": [{"departure": {"validation": {"passed": False}}}]}}}
    assert paths(deep) == ["page_2.registered_persons_constantly.persons[0].departure", "page_2.registered_persons_constantly.persons[0]"]


def test_previews_images_trace():
    meta = {"page_images": "a.png", "ocr_preview": [{"page": 2, "text": "x"}, {"page": 3, "text": None}],
            "extraction_trace": {"page_2": {"registered_persons_constantly": {"persons": [{}, {}]}}}}
    assert paths(meta, METADATA) == ["page_images[0]", "ocr_preview.page_2", *[f"extraction_trace.page_2.registered_persons_constantly.persons[{i}]" for i in (0, 1)]]
    assert paths({"ocr_preview": {"page_1": "", "page_2": None}}, METADATA) == ["ocr_preview.page_1"]


def test_unreadable_null_and_empty():
    assert paths(None) == [] and paths("") == [] and paths("null") == []
    for bad in ('{"page_1": ', "[1]", "12", "[" * 100000):
        assert [r[1] for r in walk(bad, EXTRACTED, "x")] == ["unreadable"]


def test_intervals_link_children_to_parents(spark):
    doc = json.dumps({"page_1": {"owners": ["А"] * 3}, "page_2": {"registered_persons_constantly": {"persons": [PERSON, {"full_name": None}, PERSON]}}}, ensure_ascii=False)
    rows = [("j", 0, doc, None, "x"), ("j", 1, "{", "{}", "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, file_index int, e string, m string, pre string")
    nodes = label_nodes(df, KEYS, {"e": EXTRACTED, "m": METADATA}).cache()
    got = nodes.collect()
    one = [r for r in got if r.file_index == 0]
    assert sorted(x for r in one for x in (r.pre, r.post)) == list(range(1, 2 * len(one) + 1))
    by_hand = {(c.pre, max((p.pre for p in one if p.node_type == "person" and p.pre < c.pre and c.post < p.post), default=None)) for c in one if c.node_type == "passport"}
    linked = link(nodes, KEYS, F.col("node_type") == "passport", F.col("node_type") == "person", ["pre"])
    assert {(r.pre, r.parent_pre) for r in linked.collect()} == by_hand and len(by_hand) == 2
    persons = node_table(nodes, KEYS, "person", {"full_name": "$.full_name"}, "page_2").orderBy("pre").collect()
    assert [r.full_name for r in persons] == ["Тестов Тест", None, "Тестов Тест"] and None not in [r.parent_pre for r in persons]
    inner = json.dumps({"page_1": {"passport": {"series": "1"}}, "page_2": {"registered_persons_constantly": [PERSON]}}, ensure_ascii=False)
    mixed = label_nodes(spark.createDataFrame([("k", 0, inner)], "job_id string, file_index int, e string"), KEYS, {"e": EXTRACTED})
    of = {r.pre: r.node_type for r in mixed.collect()}
    assert sorted(of[r.parent_pre] for r in node_table(mixed, KEYS, "passport", {}, "person", "page_1").collect()) == ["page_1", "person"]
    assert {r.problem for r in got if r.node_type == "unreadable"} == {"JSONDecodeError"}
    assert label_nodes(df.limit(0), KEYS, {"e": EXTRACTED}).count() == 0
