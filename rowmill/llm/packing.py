"""Texts packed into containers of fixed capacity: the configuration linear program.

A configuration says how many items of each size share a container. The linear program
(fewest containers that cover the histogram of sizes) has a variable for every
configuration; it is solved without listing them, by multiplicative weights: every size
has a weight that falls exponentially as it is covered, a knapsack dynamic program finds
the dearest configuration at these weights, and a small step of it is taken. The steps are
rounded down to whole containers; what this leaves is placed by best fit. Sizes are exact
throughout. The weights also bound the program from below (see :func:`fractional`).

Only the histogram reaches the solver, which runs in one task a target, and the plan that
leaves it names runs of equal containers, not containers: neither grows with the corpus.
Texts find their container by their rank within their size, which is counted within
salted buckets, so a size that a third of all texts share is spread over all tasks.
"""

from __future__ import annotations

import base64
import bisect
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every text; an empty text has 0, a null text is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for b in batches:
            n = [len(code.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int, part: int = 32) -> tuple[np.ndarray, float]:
    """(counts, price) of the dearest configuration of ascending ``sizes``: unbounded knapsack, exact dynamic program.

    Sizes enter the program by falling price a token, ``part`` at a time. One item of a size loses
    what the dearest token would have paid in its place; a size that alone loses more than the best
    configuration so far is in no dearer one and stays out.
    """
    rate = prices / sizes
    order = np.lexsort((sizes, -rate))
    most = rate[order[0]] * capacity
    loss = (rate[order[0]] - rate) * sizes
    best = np.zeros(capacity + 1)
    while len(order):
        for i in order[:part]:
            size, price = int(sizes[i]), prices[i]
            while size <= capacity:  # 1, 2, 4 ... items more: any number that fits
                np.maximum(best[size:], best[:-size] + price, out=best[size:])
                size, price = 2 * size, 2 * price
        order = order[part:]
        order = order[loss[order] < most - best[capacity]]
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c >= sizes[0]:
        value = best[c - sizes[: np.searchsorted(sizes, c, side="right")]]
        value += prices[: len(value)]
        i = value.argmax()
        if value[i] < best[c] * (1 - 1e-9) or value[i] <= 0:
            break
        counts[i] += 1
        c -= int(sizes[i])
    return counts, float(best[capacity])


#: Positions of the dynamic program a capacity takes in rounds of small steps; the rounds after them take whole steps.
WORK = 2**18
#: Tasks the targets are spread over.
SOLVERS = 64


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, work: int = WORK, eta: float = 2.0, step: float = 1 / 16, fine: list | None = None) -> tuple[list[tuple[np.ndarray, float]], float]:
    """([(configuration, containers)], lower bound) by multiplicative weights.

    A size starts at its volume as weight and its weight falls by exp(-eta * share covered).
    Each round takes the dearest configuration and as many copies as cover ``step`` of none of
    its sizes more than once. Any weights are a dual solution once they are divided by the
    price of their dearest configuration, so each round gives a lower bound of the program;
    the best one is returned. The rounds go on until every size is covered: ``work`` / ``capacity``
    of them take steps of ``step``, those after them whole steps, each of which covers a size. fine: gets what the small steps alone take.
    """
    covered = np.zeros(len(sizes))
    taken: dict[bytes, list] = {}
    bound = float(counts[2 * sizes > capacity].sum())  # items over a half: a dual solution too, and no two share a container
    for turn in itertools.count():
        open_ = np.flatnonzero(counts - covered > 1e-9)
        if fine is not None and turn == max(1, work // capacity) and len(open_):
            fine += [(c, x) for c, x in taken.values()]
        if not len(open_):
            break
        s, n, done = sizes[open_], counts[open_], covered[open_]
        share = done / n
        prices = s * np.exp(-eta * (share - share.min()))
        config, price = dearest(s, prices, capacity)
        bound = max(bound, float((prices * n).sum()) / price)
        used = config > 0
        copies = float((np.minimum(n - done, np.maximum((step if turn < work // capacity else 1) * n, 1e-3))[used] / config[used]).min())
        covered[open_] = np.minimum(done + copies * config, n)
        whole = np.zeros(len(sizes), np.int64)
        whole[open_] = config
        taken.setdefault(whole.tobytes(), [whole, 0.0])[1] += copies
    return [(c, x) for c, x in taken.values()], bound


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, copies) of best fit by falling sizes, with runs of equal containers
    treated at once: time and result grow with the number of sizes, not of items."""
    runs: list[tuple[int, int, int]] = []  # free, number, copies; ascending
    inside: list[dict[int, int]] = []

    def put(free: int, content: dict[int, int], copies: int) -> None:
        inside.append(content)
        bisect.insort(runs, (free, len(inside) - 1, copies))

    for i in range(len(sizes) - 1, -1, -1):
        size, left = int(sizes[i]), int(counts[i])
        while left:
            at = bisect.bisect_left(runs, (size, -1, -1))
            if at < len(runs):
                free, own, copies = runs.pop(at)
                content = inside[own]
            else:
                free, content, copies = capacity, {}, -(-left // (capacity // size))
            each = min(free // size, left)
            full = min(copies, left // each)
            put(free - each * size, content | {i: each}, full)
            left -= each * full
            if copies > full:
                put(free, content, copies - full)
    out: dict[bytes, list] = {}
    for _, own, copies in runs:
        config = np.zeros(len(sizes), np.int64)
        for i, n in inside[own].items():
            config[i] = n
        if config.any():
            out.setdefault(config.tobytes(), [config, 0])[1] += copies
    return [(c, n) for c, n in out.values()]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, work: int = WORK) -> tuple[list[tuple[np.ndarray, int]], float]:
    """([(configuration, copies)], lower bound): configurations that hold exactly ``counts``
    items of each of the ascending ``sizes``; no packing has fewer containers than the bound."""
    if not len(sizes):
        return [], 0.0
    # Whole steps leave fractions that rounding may lose, so the small steps alone are rounded too.
    fine: list[tuple[np.ndarray, float]] = []
    solution, bound = fractional(sizes, counts, capacity, work, fine=fine)
    return min((rounded(s, sizes, counts, capacity) for s in (solution, fine or solution)), key=lambda out: sum(n for _, n in out)), bound


def rounded(solution: list[tuple[np.ndarray, float]], sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """A fractional solution rounded down to whole containers; best fit places the rest."""
    left = counts.copy()
    out: list[tuple[np.ndarray, int]] = []
    for config, x in sorted(solution, key=lambda t: -t[1]):
        used = config > 0
        copies = int(min(np.floor(x + 1e-6), (left[used] // config[used]).min()))
        if copies > 0:
            out.append((config, copies))
            left -= config * copies
    return out + best_fit(sizes, left, capacity)


def slots(plans: list[tuple[np.ndarray, int]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first rank, items a container, first container, of each run of equal containers."""
    found: list[list[list[int]]] = [[[], [], []] for _ in range(n)]
    at, base = np.zeros(n, np.int64), 0
    for config, copies in plans:
        for i in np.flatnonzero(config):
            for column, v in zip(found[i], (int(at[i]), int(config[i]), base)):
                column.append(v)
            at[i] += int(config[i]) * copies
        base += copies
    return [tuple(np.array(x, np.int64) for x in f) for f in found]


MAX_TARGETS = 1000
_OUT = pa.schema([("target_id", pa.int32()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("from_token", pa.int64()), ("n_tokens", pa.int64())])


SOLVED = "target_id int, n_tokens long, first long, each long, box long, bound double"


def solve(histogram: DataFrame, goals: DataFrame, work: int = WORK) -> DataFrame:
    """SOLVED rows: for each size of a target the runs of containers its items go to (rank of
    the first item, items a container, first container), and the target's lower bound.

    histogram: target_id, n_tokens, n; goals: target_id, capacity, sep. One task a target,
    side by side; a target has at most as many sizes as its capacity, whatever the corpus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        sep, room = int(pdf["sep"].iloc[0]), int(pdf["capacity"].iloc[0])
        sizes, counts = pdf["n_tokens"].to_numpy(np.int64) + sep, pdf["n"].to_numpy(np.int64)
        free = sizes > 0  # items without size take no room: all go to the first container
        plans, bound = plan(sizes[free], counts[free], room + sep, work)
        target = int(pdf["target_id"].iloc[0])
        rows = [(target, 0, 0, 2**62, 0, bound)] if (~free).any() else []
        for size, (first, each, box) in zip(sizes[free], slots(plans, int(free.sum()))):
            rows += [(target, int(size) - sep, int(a), int(b), int(c), bound) for a, b, c in zip(first, each, box)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SOLVED.split(", ")])

    spread = histogram.join(F.broadcast(goals), "target_id").repartition(SOLVERS, "target_id")  # a stated number isn't coalesced, so targets don't wait for each other
    return spread.groupBy("target_id").applyInPandas(run, SOLVED)


def pack(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, work: int = WORK, salts: int | None = None) -> DataFrame:
    """target_id, container_id, doc_id, piece, from_token, n_tokens: every text in one container of
    each target, or, if it alone exceeds the capacity, in pieces of the capacity and a rest.

    docs: doc_id (unique), text; targets: target_id, capacity_tokens (positive),
    separator_tokens (null: 0), at most ``MAX_TARGETS`` of them. The tokens between two items of
    a container count. Null texts are left out, empty texts take no tokens but a place. path:
    vocabulary file.
    """
    spark = docs.sparkSession
    wanted = targets.select("target_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("sep")).distinct().limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} capacities")
    counted = written(token_counts(docs, path), "tokens")
    goals = F.broadcast(spark.createDataFrame([(r.target_id, r.capacity_tokens, r.sep) for r in wanted], "target_id int, capacity long, sep long"))
    n, cap = F.col("n_tokens"), F.col("capacity")
    pieces = F.greatest(F.lit(1), F.ceil(n / cap)).cast("int")
    items = counted.crossJoin(goals).select("target_id", "doc_id", "capacity", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.select("target_id", "doc_id", "piece", (F.col("piece") * cap).alias("from_token"), F.least(cap, n - F.col("piece") * cap).alias("n_tokens"))
    layout: dict[tuple[int, int], tuple] = {}
    solved = solve(items.groupBy("target_id", "n_tokens").agg(F.count("*").alias("n")), goals, work).toPandas()  # bounded by the capacities
    for key, own in solved.sort_values("first").groupby(["target_id", "n_tokens"]):
        layout[int(key[0]), int(key[1])] = tuple(own[c].to_numpy(np.int64) for c in ("first", "each", "box"))
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    kind = ["target_id", "n_tokens"]
    start = Window.partitionBy(*kind).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = items.groupBy(*kind, "salt").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(start), F.lit(0))).drop("n")
    within = Window.partitionBy(*kind, "salt").orderBy("doc_id", "piece")
    ranked = items.withColumn("r", F.row_number().over(within) - 1).join(first, [*kind, "salt"])
    ranked = ranked.select("target_id", (F.col("r") + F.col("first")).alias("rank"), "doc_id", "piece", "from_token", "n_tokens")
    sent = spark.sparkContext.broadcast(layout)  # one row for each size of each configuration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target, rank, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 5))
            box = np.zeros(len(rank), np.int64)
            order = np.lexsort((size, target))
            cuts = np.flatnonzero((np.diff(target[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for own in np.split(order, cuts) if len(order) else []:
                starts, each, base = sent.value[int(target[own[0]]), int(size[own[0]])]
                at = np.searchsorted(starts, rank[own], side="right") - 1
                box[own] = base[at] + (rank[own] - starts[at]) // each[at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(box), *[b.column(i) for i in range(2, 6)]], schema=_OUT)

    return ranked.mapInArrow(run, "target_id int, container_id long, doc_id long, piece int, from_token long, n_tokens long")


def fill(packed: DataFrame, targets: DataFrame, work: int = WORK) -> DataFrame:
    """For each target: items, containers, tokens, the fewest containers any packing may have
    by volume and by the linear program, and the share of the capacity that is used
    (separators count as used)."""
    goals = targets.select("target_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.coalesce("separator_tokens", F.lit(0)).cast("long").alias("sep"))
    bounds = solve(packed.groupBy("target_id", "n_tokens").agg(F.count("*").alias("n")), goals, work).groupBy("target_id").agg(F.ceil(F.max("bound") - 1e-6).alias("least_by_program"))
    boxes = packed.groupBy("target_id", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    joined = boxes.join(F.broadcast(goals), "target_id")
    used = F.col("tokens") + (F.col("items") - 1) * F.col("sep")
    out = joined.groupBy("target_id", F.col("capacity").alias("capacity_tokens")).agg(
        F.sum("items").alias("n_items"), F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max(used).cast("long").alias("fullest"),
        F.ceil(F.sum(F.col("tokens") + F.col("items") * F.col("sep")) / F.first(F.col("capacity") + F.col("sep"))).alias("least_by_volume"),
        F.round(F.sum(used) / (F.count("*") * F.first("capacity")), 5).alias("share_used"),
    )
    return out.join(F.broadcast(bounds), "target_id")
