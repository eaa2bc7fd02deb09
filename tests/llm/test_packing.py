from __future__ import annotations

import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from rowmill.llm.packing import best_fit, dearest, encoder, fill, fractional, pack, plan, slots, TOKENIZER


def test_dearest_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(rng.integers(2, 9, 4))
        prices = rng.random(len(sizes))
        best = max(float(np.dot(c, prices)) for c in itertools.product(range(11), repeat=len(sizes)) if np.dot(c, sizes) <= 20)
        got, price = dearest(sizes, prices, 20)
        assert abs(price - best) < 1e-9
        assert np.dot(got, sizes) <= 20 and abs(np.dot(got, prices) - best) < 1e-9


def test_plan_holds_every_item_and_stays_small():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000, 500000, 50_000_000):
        sizes, counts = np.unique(np.minimum(rng.exponential(60, min(n, 500000)).astype(int) + 1, 200), return_counts=True)
        counts = counts * max(1, n // 500000)
        got, bound = plan(sizes, counts, 200, work=2**14)
        assert (sum((c * m for c, m in got), np.zeros(len(sizes), int)) == counts).all()
        assert all(np.dot(c, sizes) <= 200 for c, _ in got)
        boxes = sum(m for _, m in got)
        assert bound <= boxes + 1e-6 and (not n or bound >= np.dot(sizes, counts) / 200 - 1e-6)
        assert boxes <= 1.005 * bound + 2
        assert len(got) <= 2500


def test_known_optimum():
    # Containers of 100 that 500 threesomes fill exactly: 500 is the optimum, and the bound proves it.
    rng = np.random.default_rng(3)
    a, b = rng.integers(30, 36, 500), rng.integers(30, 36, 500)
    sizes, counts = np.unique(np.concatenate([a, b, 100 - a - b]), return_counts=True)
    got, bound = plan(sizes, counts, 100)
    assert 499.99 <= bound <= 500.01 and sum(m for _, m in got) <= 505
    # Sizes just above a half: volume says 56, the program knows that no two share a container.
    got, bound = plan(np.array([55, 56]), np.array([60, 40]), 100)
    assert sum(m for _, m in got) == 100 and bound >= 99.99


def test_program_covers_every_size():
    rng = np.random.default_rng(5)
    sizes, counts = np.unique(rng.integers(1, 400, 3000), return_counts=True)
    for work in (1, 2**12):  # fewer positions than one round takes, and few rounds
        solution, bound = fractional(sizes, counts, 400, work)
        covered = sum(c * x for c, x in solution)
        assert (covered >= counts - 1e-6).all() and sum(x for _, x in solution) >= bound - 1e-6


def test_many_sizes_stay_exact():
    sizes = np.arange(1, 2001)
    got, bound = plan(sizes, np.full(2000, 3), 4000, work=2**16)
    assert (sum((c * m for c, m in got), np.zeros(2000, int)) == 3).all() and sum(m for _, m in got) <= 1.005 * bound + 1


def test_dearest_leaves_out_sizes_that_cannot_pay():
    # As dear as a program over every position and size, in a fraction of its time.
    rng = np.random.default_rng(7)
    sizes = np.unique(np.concatenate([rng.integers(1, 4098, 1800), [4096, 4098]]))
    plain, took = [], []
    for spread in (0.0, 1e-3, 0.3, 2.0):
        prices = sizes * np.exp(-spread * rng.random(len(sizes)))
        start = time.process_time()
        best = np.zeros(4099)
        for c in range(int(sizes[0]), 4099):
            k = np.searchsorted(sizes, c, side="right")
            best[c] = max(best[c - 1], (best[c - sizes[:k]] + prices[:k]).max())
        plain.append(time.process_time() - start)
        start = time.process_time()
        counts, price = dearest(sizes, prices, 4098)
        took.append(time.process_time() - start)
        assert abs(price - best[-1]) < 1e-6 and counts @ sizes <= 4098 and abs(counts @ prices - price) < 1e-6
    assert sum(took) < sum(plain) / 2, (took, plain)


def test_best_fit_is_by_runs():
    got = best_fit(np.array([3, 4]), np.array([10**12, 10**12]), 10)
    assert sum(c * n for c, n in got).tolist() == [10**12, 10**12] and all(np.dot(c, [3, 4]) <= 10 for c, _ in got) and len(got) < 8


def test_slots_cover_ranks():
    plans = [(np.array([2, 1]), 3), (np.array([0, 4]), 1)]
    (s0, k0, b0), (s1, k1, b1) = slots(plans, 2)
    assert (s0.tolist(), k0.tolist(), b0.tolist()) == ([0], [2], [0]) and (s1.tolist(), k1.tolist(), b1.tolist()) == ([0, 3], [1, 4], [0, 3])


def test_pack(spark):
    text = "Площадь помещения составляет 38 кв. м, из них жилая — 28. "
    docs = [(i, text * (i % 7 + 1), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "a", "x"), (903, text * 400, "x")]
    docs += [(1000 + i, "да", "x") for i in range(150)]  # one size holds a third of the rows
    df = spark.createDataFrame(docs, "doc_id long, text string, target_id string")
    targets = spark.createDataFrame([(1, 64, 0), (2, 300, 2), (3, 5000, None)], "target_id int, capacity_tokens int, separator_tokens int")
    got = pack(df, targets, work=2**12, salts=4).cache()
    code = encoder(TOKENIZER)
    want = {i: len(code.encode_ordinary(t)) for i, t, _ in docs if t is not None}
    for cap, sep, t in ((64, 0, 1), (300, 2, 2), (5000, 0, 3)):
        rows = got.filter(F.col("target_id") == t).collect()
        per: dict = {}
        for r in rows:
            per.setdefault(r.doc_id, []).append((r.from_token, r.n_tokens))
        assert per.keys() == want.keys()
        for d, parts in per.items():
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
            assert at == want[d] and (len(parts) == 1 or want[d] > cap)
            assert all(n == cap for _, n in sorted(parts)[:-1])
        load: dict = {}
        for r in rows:
            load.setdefault(r.container_id, []).append(r.n_tokens)
        assert all(sum(x) + sep * (len(x) - 1) <= cap for x in load.values())
    for r in fill(got, targets.fillna(0)).collect():
        assert r.n_containers <= 1.02 * r.least_by_program + 2 and r.least_by_program >= r.least_by_volume - 1 and r.fullest <= r.capacity_tokens


def test_empty(spark):
    targets = spark.createDataFrame([(1, 64, 0)], "target_id int, capacity_tokens int, separator_tokens int")
    assert pack(spark.createDataFrame([], "doc_id long, text string"), targets).count() == 0
