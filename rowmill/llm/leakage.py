"""Evaluation passages inside training texts, by winnowing.

A text becomes words (lower case, ё as е, soft hyphens and line-break hyphens
removed), words become 64-bit hashes, and each run of ``k`` words a rolling hash.
Of every ``window`` neighbouring hashes the smallest is kept (the rightmost of equal
ones), so any intact shared run of ``k + window - 1`` words has a kept hash in both
texts. With k = 3 and window = 2 that is a run of 4: a passage of 14 words of which
two are changed leaves such a run wherever the changes stand.

Kept hashes of both sides are joined and every hit is extended to the best local
alignment of words around it. A pair is a leak if the alignment matches
``min_match`` words or more, with no more than ``max_edits`` edits per match: midway
between the longest harmless quote (7 words) and the shortest passage (14 words, two of
them changed).

Texts travel once. If the test side is within ``max_item_words`` (measured), its
fingerprints go to the workers and the join happens where the corpus is read: no
shuffle. Beyond it both sides' fingerprints meet in a shuffled join, and the texts of
the hit documents are fetched by key.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW = 3, 2
_WORD = re.compile(r"\w+")
_BROKEN = re.compile(r"(?<=\w)[-¬‐­] ?\n\s*(?=\w)")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[str]:
    """Comparable words of a text; none for null or blank text."""
    if not text:
        return []
    text = text.lower().replace("ё", "е")
    if "­" in text or "-\n" in text or "- \n" in text or "¬" in text:
        text = _BROKEN.sub("", text).replace("­", "")
    return _WORD.findall(text)


class Hasher:
    """Word to 64-bit hash, with a cache that is emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        self.cache: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self.cache) > self.limit:
            self.cache.clear()
        return np.fromiter(map(self.one, ws), np.uint64, len(ws))

    def one(self, w: str) -> int:
        h = self.cache.get(w)
        if h is None:
            from xxhash import xxh64_intdigest

            h = self.cache[w] = xxh64_intdigest(w)
        return h


def winnow(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept of the word hashes ``h``. Fewer than ``k`` words: none;
    fewer than a window: the smallest hash."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = (g ^ h[i : i + n]) * _M1
            g ^= g >> np.uint64(29)
        g *= _M2
    w = min(window, n)
    best = np.arange(n - w + 1) + w - 1
    for d in range(w - 2, -1, -1):  # the rightmost of equal ones stays
        other = np.arange(n - w + 1) + d
        best = np.where(g[other] < g[best], other, best)
    keep = np.unique(best)
    return keep, g[keep]


def align(a: list, b: list, edit: float = 1.25) -> tuple[int, int, int, int, int]:
    """Best local alignment of word lists: (matches, edits, start in a, start in b, end in b)."""
    rows = [(0.0, 0, 0, 0, j) for j in range(len(b) + 1)]
    top = (0.0, 0, 0, 0, 0, 0)
    for i, x in enumerate(a, 1):
        prev, rows = rows, [(0.0, 0, 0, i, 0)]
        left = rows[0]
        for j, y in enumerate(b, 1):
            s, m, e, p, q = prev[j - 1]
            if x == y:
                cell = (s + 1, m + 1, e, p, q)
                if cell[0] > top[0]:
                    top = (*cell, j)
            else:
                up = prev[j]
                s, m, e, p, q = max((prev[j - 1], up, left), key=lambda c: c[0])
                cell = (s - edit, m, e + 1, p, q) if s > edit else (0.0, 0, 0, i, j)
            rows.append(cell)
            left = cell
    return top[1], top[2], top[3], top[4], top[5]


def extend(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], slack: int = 10) -> tuple[int, int, int, int, int] | None:
    """The best alignment around the hits (document position, item position), with
    positions in the whole texts; none if fewer than two hits lie near one diagonal."""
    best = None
    hits = sorted(hits, key=lambda t: t[0] - t[1])
    groups: list[list[tuple[int, int]]] = []
    for h in hits:
        if groups and h[0] - h[1] - (groups[-1][-1][0] - groups[-1][-1][1]) <= 4:
            groups[-1].append(h)
        else:
            groups.append([h])
    for g in groups:
        if len(g) < 2:
            continue
        at = [d - i for d, i in g]
        lo, hi = max(0, min(at) - slack), min(len(doc), max(at) + len(item) + slack)
        m, e, p, q, end = align(item.tolist(), doc[lo:hi].tolist())
        if best is None or m - e > best[0] - best[1]:
            best = (m, e, p, lo + q, lo + end)
    return best


class Index:
    """Fingerprints of the test side, held by a worker."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hasher = Hasher()
        self.ids, self.items = ids, [hasher(words(t)) for t in texts]
        keys, rows = [], []
        for n, h in enumerate(self.items):
            for p, f in zip(*winnow(h)):
                keys.append(f)
                rows.append((n, int(p)))
        self.keys = np.array(sorted(set(keys)), np.uint64)
        self.at: dict[int, list[tuple[int, int]]] = {}
        for f, r in zip(keys, rows):
            self.at.setdefault(int(f), []).append(r)

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        pos, fp = winnow(h)
        if not len(self.keys) or not len(fp):
            return {}
        near = np.minimum(np.searchsorted(self.keys, fp), len(self.keys) - 1)
        found: dict[int, list[tuple[int, int]]] = {}
        for x in np.flatnonzero(self.keys[near] == fp):
            for n, p in self.at[int(fp[x])]:
                found.setdefault(n, []).append((int(pos[x]), p))
        return found


_INDEXES: dict[str, Index] = {}


def _index(key: str, rows: tuple) -> Index:
    """The index of one call, built once in a worker process; that of an earlier call is dropped."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*rows)
    return _INDEXES[key]


FOUND = "doc_id long, item_id long, n_words int, n_edits int, doc_from int, doc_to int, item_from int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("n_words", "n_edits", "doc_from", "doc_to", "item_from")]])


def _judge(doc_id, item_id, h, item, hits, min_match, max_edits, out) -> None:
    if len(hits) < 2:  # a passage of the least length leaves two hits at least
        return
    found = extend(h, item, hits)
    if found and found[0] >= min_match and found[1] <= max_edits * found[0]:
        m, e, p, q, end = found
        out.append((doc_id, item_id, m, e, q, end, p))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def leaks(docs: DataFrame, items: DataFrame, min_match: int = 10, max_edits: float = 0.25, max_item_words: int = 5_000_000) -> DataFrame:
    """Leaked pairs: FOUND columns, one row per (doc_id, item_id), the best passage.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null or short
    texts on either side match nothing; repeated rows give one pair; empty tables no rows.
    Word positions count normalised words.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] / 6
    found = _map_side(docs, items, min_match, max_edits) if size <= max_item_words else _shuffled(docs, items, min_match, max_edits)
    best = F.max_by(F.struct(*[c.split()[0] for c in FOUND.split(", ")[2:]]), F.struct("n_words", -F.col("n_edits"), -F.col("doc_from"), -F.col("item_from")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", "_b.*")


def _map_side(docs: DataFrame, items: DataFrame, min_match: int, max_edits: float) -> DataFrame:
    rows = items.collect()  # bounded: measured by the caller
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = _index(key, sent.value), Hasher()
        for b in batches:
            out: list[tuple] = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hasher(words(text))
                for n, hits in index.hits(h).items():
                    _judge(d, index.ids[n], h, index.items[n], hits, min_match, max_edits, out)
            yield _batch(out)

    return docs.mapInArrow(run, FOUND)


def _prints(df: DataFrame, key: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids, at, fps = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, f = winnow(hasher(words(text)))
                ids.append(np.full(len(p), -1 if d is None else d, np.int64))
                at.append(p)
                fps.append(f.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (ids, fps, at)], names=[key, "fp", name])

    return df.select(key, "text").mapInArrow(run, f"{key} long, fp long, {name} long")


def _shuffled(docs: DataFrame, items: DataFrame, min_match: int, max_edits: float) -> DataFrame:
    hits = (
        _prints(docs, "doc_id", "dp").join(_prints(items, "item_id", "ip"), "fp")
        .groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("dp", "ip")).alias("hits")).filter(F.size("hits") > 1)
    )
    pairs = hits.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "hits", "text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            out: list[tuple] = []
            for d, i, hs, text, item in zip(*(c.to_pylist() for c in b.columns)):
                _judge(d, i, hasher(words(text)), hasher(words(item)), [(h["dp"], h["ip"]) for h in hs], min_match, max_edits, out)
            yield _batch(out)

    return pairs.mapInArrow(run, FOUND)
