from __future__ import annotations

import random

import numpy as np

from rowmill.llm.leakage import FOUND, Hasher, align, leaks, winnow, words

VOCAB = [f"слово{i}" for i in range(900)]


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 4).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]) for _ in "ab")
        assert set(winnow(a)[1].tolist()) & set(winnow(b)[1].tolist())
    assert len(winnow(np.empty(0, np.uint64))[0]) == 0 and len(winnow(np.arange(3).astype(np.uint64))[0]) == 1


def test_words_undo_layout():
    assert words("Ёж, ёлка!\nпере-\nнос") == ["еж", "елка", "перенос"] and words(None) == words("  ") == []


def test_alignment_counts():
    m, e, p, q, end = align(list("abcdefgh"), list("xxabcdzfghyy"))
    assert (m, e, p, q, end) == (7, 1, 0, 2, 10)


def corpus():
    r = random.Random(7)
    items = [(i, " ".join(r.choices(VOCAB, k=30))) for i in range(12)]
    docs, truth = [], set()
    for d in range(120):
        w = r.choices(VOCAB, k=r.choice((0, 5, 60, 200)))
        i = r.randrange(12)
        if d % 3 == 0:
            s = r.randrange(0, 16)
            q = items[i][1].split()[s : s + 14]
            for k in r.sample(range(14), 2):
                q[k] = "чужое"
            w += [x.upper() + "," for x in q]
            truth.add((d, i))
        elif d % 3 == 1:
            s = r.randrange(0, 22)
            w += items[i][1].split()[s : s + 7]
        w += r.choices(VOCAB, k=30)
        docs.append((d, "\n".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, items[0][1], "x"), (902, items[0][1], "x")]
    truth.add((902, 0))
    items += [(50, None), (51, ""), (52, items[1][1])]
    truth |= {(d, 52) for d, i in truth if i == 1}
    return docs, items, truth


def test_both_ways_equal_brute_force(spark):
    docs, items, truth = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    near = leaks(d, i).collect()
    far = leaks(d, i, max_item_words=0).collect()
    assert {(r.doc_id, r.item_id) for r in near} == truth
    assert sorted(near) == sorted(far)
    brute = set()
    for n, t, _ in docs:
        for k, x in items:
            m, e, *_ = align(words(x), words(t))
            if m >= 10 and e <= 0.25 * m:
                brute.add((n, k))
    assert brute == truth


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, i).count() == 0 and leaks(d, i, max_item_words=-1).count() == 0
    assert [f.name for f in leaks(d, i).schema] == [c.split()[0] for c in FOUND.split(", ")]


def test_hasher_empties_its_cache():
    h = Hasher(2)
    a = h(["a", "b", "c"])
    assert (h(["a", "b", "c"]) == a).all() and len(h.cache) == 3
