"""Variant spellings of people and of issuing bodies, attributed by a noisy channel.

Spellings, not rows, are compared: a spelling is a name read into its parts together
with what fixes the person beside it (the birthday), with the number of rows that have
it. Frequent and complete spellings are the candidate canonical forms. A variant meets
the candidates of its own birthday that share the surname less one letter, or first name
and patronymic; the posterior of a candidate is its frequency prior times the
likelihood that it was mistyped, shortened or left incomplete as the variant; the
variant is attached to the maximum. Attachments only point to higher-ranked spellings, so
they form trees, and pointer doubling finds the roots.

Nothing is compared within a whole birthday or surname, and equal spellings are one row
before any join, so neither a hot date nor a hot name makes a large group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.canonical import weighted
from rowmill.llm.chars import cyrillic, osa, plain
from rowmill.llm.names import _lexicon, frozen, learn, likelihood, read_names
from rowmill.session import spread, written

PARTS = ["surname", "first", "father"]


def one_less(column: str) -> Column:
    """``column`` and everything left of it after one deletion, as an array (for joins on near words)."""
    cut = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, F.length(column))))
    return F.array_distinct(F.concat(F.array(F.col(column)), F.when(F.length(column) > 3, cut).otherwise(F.array().cast("array<string>"))))


def two_less(column: str) -> Column:
    """``column`` and everything left of it after up to two deletions: two words within two edits share one of these."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    return F.array_distinct(F.concat(one_less(column), F.when(F.length(column) > 3, F.flatten(F.transform(one_less(column), cut))).otherwise(F.array().cast("array<string>"))))


def roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """node, root: where the parent pointers (node, parent; no cycles) of each node end.
    Each doubling follows paths twice as long, until none goes on."""
    at = nodes.select("node").join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
    at = written(at, "roots")
    while True:
        up = at.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("up"))
        at = at.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        at = written(at, "roots")
        if not at.filter("node <> root").select("root").distinct().join(at.filter("node <> root").select(F.col("node").alias("root")), "root", "left_semi").limit(1).count():
            break
    return at


def _score(learned, least: float):
    """Posterior of the pairs of (variant parts, candidate parts, count of the candidate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        lex = _lexicon(*learned)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keep, scores = [], []
            for i, (_, _, n, s1, f1, p1, s2, f2, p2) in enumerate(zip(*cols)):
                like = likelihood((s1, f1, p1), (s2, f2, p2), lex)
                if like is not None and like >= least:
                    keep.append(i)
                    scores.append(like + math.log(n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(scores, pa.float64())], names=["node", "parent", "score"])

    return run


def _fullness() -> Column:
    part = lambda c: F.when(F.col(c) == "", 0).when(F.col(c).endswith("."), 1).otherwise(3)
    return part("first") + part("father") + F.when(F.col("surname") == "", 0).otherwise(2)


def attribute(spellings: DataFrame, learned, least: float = -5.0) -> DataFrame:
    """node, root for spellings: node (id), anchor (what must agree), surname, first, father, n.

    least: the lowest log-likelihood of an attachment.
    """
    ranked = spellings.withColumn("rank", F.struct(_fullness().alias("full"), "n", F.col("node").alias("tie")))
    both = (~F.col("first").endswith(".")) & (~F.col("father").endswith(".")) & (F.col("first") != "") & (F.col("father") != "")
    words = F.when(F.col("surname").contains(" "), F.split("surname", " ")).otherwise(F.array().cast("array<string>"))
    keys = F.concat(one_less("surname"), words, F.when(both, F.array(F.concat_ws("/", "first", "father"))).otherwise(F.array().cast("array<string>")))
    keyed = ranked.withColumn("key", F.explode(keys)).select("node", "anchor", "key", "rank", "n", *PARTS)
    other = keyed.select("anchor", "key", *[F.col(c).alias(f"{c}2") for c in ("node", "rank", "n", *PARTS)])
    pairs = keyed.join(other, ["anchor", "key"]).filter("rank < rank2").select("node", "node2", "n2", *PARTS, *[f"{c}2" for c in PARTS]).dropDuplicates(["node", "node2"])
    scored = pairs.mapInArrow(_score(learned, least), "node long, parent long, score double")
    parents = scored.groupBy("node").agg(F.max_by("parent", F.struct("score", "parent")).alias("parent"))
    return roots(spellings, parents)


def digits(c: str) -> Column:
    """The digits of a document number (with look-alike letters read as digits), none if fewer than 4."""
    d = F.regexp_replace(F.translate(F.col(c), "ОоOoЗз", "000033"), r"\D", "")
    return F.when(F.length(d) >= 4, d)


def people(residents: DataFrame, documents: DataFrame) -> DataFrame:
    """resident_id, full_name, surname, first, father, birthday, number, person_id.

    residents: resident_id, full_name, birthday_date, document_id, one row per resident;
    documents: document_id, number. Rows without a name are left out. Rows with a birthday
    are attributed among the spellings of that birthday; rows without one go to the
    person whose document has their number and whose name fits, else to the only
    person of exactly their full name, else they are a person of their own spelling and
    number.
    """
    residents = residents.select("resident_id", "full_name", "birthday_date", "document_id")
    learned = frozen(learn(residents))
    rows = residents.filter("full_name IS NOT NULL").join(documents.select("document_id", digits("number").alias("number")), "document_id", "left")
    rows = rows.join(read_names(residents, learned), "full_name").select("resident_id", "full_name", F.col("birthday_date").alias("birthday"), "number", *PARTS)
    rows = written(rows, "people")
    dated = rows.filter("birthday IS NOT NULL")
    spellings = dated.groupBy("birthday", *PARTS).agg(F.count("*").alias("n")).withColumn("node", F.xxhash64("birthday", *PARTS)).withColumnRenamed("birthday", "anchor")
    spellings = written(spellings, "spellings")
    root = attribute(spellings, learned)
    named = dated.withColumn("node", F.xxhash64("birthday", *PARTS)).join(root, "node").select(*rows.columns, F.col("root").alias("person_id"))
    named = written(named, "named")

    open_rows = rows.filter("birthday IS NULL").withColumn("node", F.xxhash64(*PARTS, F.coalesce("number", F.lit("-")), F.lit("open")))
    loose = open_rows.groupBy("node", *PARTS, "number").agg(F.count("*").alias("n"))
    known = named.filter("number IS NOT NULL").groupBy("number", "person_id", *PARTS).agg(F.count("*").alias("n2"))
    known = known.select("number", F.col("person_id").alias("node2"), "n2", *[F.col(c).alias(f"{c}2") for c in PARTS])
    near = loose.join(known, "number").select("node", "node2", "n2", *PARTS, *[f"{c}2" for c in PARTS])
    by_number = near.mapInArrow(_score(learned, -5.0), "node long, parent long, score double").groupBy("node").agg(F.max_by("parent", F.struct("score", "parent")).alias("person"))
    whole = (~F.col("first").endswith(".")) & (~F.col("father").endswith(".")) & (F.col("first") != "") & (F.col("father") != "")
    only = named.filter(whole).groupBy(*PARTS).agg(F.min("person_id").alias("a"), F.max("person_id").alias("b")).filter("a = b").select(*PARTS, F.col("a").alias("only"))
    found = loose.join(by_number, "node", "left").join(only, PARTS, "left").select("node", F.coalesce("person", F.when(F.col("surname") != "", F.col("only")), "node").alias("person_id"))
    return named.unionByName(open_rows.join(found, "node").select(*rows.columns, "person_id"))


def variant_pairs(members: DataFrame, cluster: str, key: str, spelling: str) -> DataFrame:
    """id_a < id_b of one cluster whose spellings differ in any byte (the stated result)."""
    a = members.select(cluster, F.col(key).alias("id_a"), F.col(spelling).alias("s_a"))
    b = members.select(cluster, F.col(key).alias("id_b"), F.col(spelling).alias("s_b"))
    return a.join(b, cluster).filter("id_a < id_b AND s_a <> s_b").select("id_a", "id_b")


# Issuing bodies -------------------------------------------------------------------------

_NUMBER = re.compile(r"(?:№|номер|\bn)\s*(\d+)|(\d+)")
_PLACE = re.compile(r"\(\s*([а-я]{4,}(?:-[а-я]+)*)\s*\)|(?<![а-я])(?:поселок|пос|п)(?:\.\s*|\s+)([а-я]{4,}(?:-[а-я]+)*)")
_BODY_TOKEN = re.compile(r"[а-я]+(?:-[а-я]+)*")
# Words that say what the next word is, and words without weight.
_MARKS = ("и", "по", "п", "пос", "поселок", "номер", "n")


class BodyWords:
    """The words of the names of bodies (learned, see :func:`learn_body_words`), with a memory of what was compared."""

    def __init__(self, words: tuple[str, ...]):
        self.words, self.known = sorted({*words, "поселок", "номер"}), {}

    def far(self, word: str) -> float:
        """How far a word is from the words of bodies, as a share of its length (0: it is one, or short for one)."""
        best = self.known.get(word)
        if best is None:
            if len(self.known) > 200_000:
                self.known.clear()
            bare = word.rstrip(".")
            best = 1.0
            for w in self.words:
                for full in {w, w[: len(bare)]} if len(bare) >= 3 else {w}:
                    best = min(best, weighted(bare, full, 3.0) / max(len(bare), 1))
            self.known[word] = best
        return best


@lru_cache(maxsize=4)
def _body_words(words: tuple[str, ...]) -> BodyWords:
    return BodyWords(words)


def _tidy(text: str) -> tuple[str, str]:
    """(number without leading zeros, the text without it)."""
    s = cyrillic(plain(text)).lower().replace("ё", "е")
    s = re.sub(r"п/\s?(?=п)", "паспортный ", s)
    if m := _NUMBER.search(s):
        return (m[1] or m[2]).lstrip("0") or "0", s[: m.start()] + " , " + s[m.end() :]
    return "", s


def read_body(text: str | None, words: BodyWords) -> tuple[str, str, str]:
    """(number, signature, place): the number without leading zeros, the first letters of
    the words of the body, the name of the settlement; "" for what isn't written."""
    if not text:
        return "", "", ""
    number, s = _tidy(text)
    place = ""
    for m in _PLACE.finditer(s):
        w = m[1] or m[2]
        if words.far(w) > 0.25:
            place, s = w, s[: m.start()] + " , " + s[m.end() :]
            break
    found = _BODY_TOKEN.findall(s)
    if not place:
        far = max(((words.far(w), len(w), w) for w in found if len(w) >= 5), default=(0.0, 0, ""))
        if far[0] > 0.25:
            place = far[2]
            found.remove(place)
    found = [w for w in found if w not in _MARKS]
    if len(found) == 1 and len(found[0]) <= 6:
        return number, found[0], place
    return number, "".join(w[0] for w in found), place


def learn_body_words(cards: DataFrame, share: float = 0.01, numbers: float = 0.05, least: int = 10) -> tuple[str, ...]:
    """Words that stand in ``share`` of the spellings (and ``least`` of them) or more and beside
    ``numbers`` of all numbers or more: words of bodies. Names of settlements are in few spellings and stand by
    the few numbers of their own bodies. At most 1 / share words for each word of a spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                number, s = _tidy(text)
                out += [(w, number) for w in {w for w in _BODY_TOKEN.findall(s) if len(w) >= 3 and w not in _MARKS}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[], []])], names=["word", "number"])

    spellings = spread(cards.select("issued_by").filter("issued_by IS NOT NULL").distinct(), "issued_by")
    words = spellings.mapInArrow(run, "word string, number string").groupBy("word", "number").agg(F.count("*").alias("n"))
    total = spellings.agg(F.count("*").alias("all"))  # one row
    kinds = words.agg(F.countDistinct("number").alias("kinds"))  # one row
    per = words.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("beside")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(kinds))
    return tuple(sorted(r.word for r in per.filter((F.col("n") >= F.greatest(F.lit(least), share * F.col("all"))) & (F.col("beside") >= numbers * F.col("kinds"))).select("word").collect()))


_BODY = pa.schema([("issued_by", pa.string()), ("number", pa.string()), ("signature", pa.string()), ("place", pa.string())])


def read_bodies(cards: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """issued_by, number, signature, place of every distinct non-null ``issued_by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _body_words(words)
        for b in batches:
            texts = b.column(0).to_pylist()
            parts = [read_body(t, known) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (texts, *(zip(*parts) if parts else [[]] * 3))], schema=_BODY)

    return spread(cards.select("issued_by").filter("issued_by IS NOT NULL").distinct(), "issued_by").mapInArrow(run, "issued_by string, number string, signature string, place string")


#: Classes of what two spellings of a body differ by: typing cost of the places in steps of a half, signatures by their distance.
COSTS, SIGNS = 9, 4
BELIEF = 20
_DIFFERENCE = "node long, parent long, n long, cost int, off int"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        costs = [min(COSTS - 1, math.ceil(2 * weighted(x, y, COSTS / 2)) if abs(len(x) - len(y)) < COSTS else COSTS - 1) if (x != y) else 0 for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        signs = [min(SIGNS - 1, osa(x, y, SIGNS)) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist())]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(costs, pa.int32()), pa.array(signs, pa.int32())], names=["node", "parent", "n", "cost", "off"])


def body_channel(seen: np.ndarray, chance: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of a difference under one body, posterior of one body) for every class
    of differences, from the counts ``seen`` (COSTS x SIGNS) of candidate pairs. chance: how
    often two spellings at random have one signature, hence two bodies.

    No pair is labelled: expectation maximisation splits the counts into pairs of one body and
    pairs of two; costs and signatures are independent within each. Start: the smaller both
    differences, the likelier one body.
    """
    cost, off = np.arange(COSTS)[:, None], np.arange(SIGNS)[None, :]
    post = 1 / (1 + np.exp(1.0 * (cost - 5) + 6.0 * (off - 0.5)))
    for _ in range(rounds):
        logs = []
        for w, steep in ((seen * post, 1.0), (seen * (1 - post), 0.0)):
            # ``BELIEF`` pairs' worth of the start, so that a handful of pairs doesn't turn the classes over.
            p, q = np.exp(-steep * cost[:, 0]), np.exp(-3 * steep * off[0])
            p, q = w.sum(1) + BELIEF * p / p.sum(), w.sum(0) + BELIEF * q / q.sum()
            if logs:  # two bodies
                q[0] = q[1:].sum() * chance / (1 - chance)
            logs.append(np.log(p / p.sum())[:, None] + np.log(q / q.sum())[None, :] + np.log((w.sum() + 1) / (seen.sum() + 2)))
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return logs[0], post


def bodies(cards: DataFrame) -> DataFrame:
    """card_id, issued_by, body_id. cards: card_id, issued_by, n_docs.

    The number must agree (it is part of the body); places within two edits of each other
    meet (symmetric deletes); the channel, learned from all pairs that meet, says which differences one body
    has, and each spelling points to the likeliest of the more frequent ones: prior (its
    documents) times likelihood. Cards without a number or place are bodies of their own
    spelling.
    """
    given = cards.filter("issued_by IS NOT NULL").select("card_id", "issued_by", F.coalesce("n_docs", F.lit(1)).alias("n_docs"))
    rows = given.join(read_bodies(given, learn_body_words(given)), "issued_by")
    rows = rows.withColumn("node", F.xxhash64("number", "signature", "place", F.when((F.col("number") == "") | (F.col("place") == ""), F.col("issued_by")).otherwise("")))
    rows = written(rows, "cards")
    seen = rows.filter("number <> '' AND place <> ''").groupBy("node", "number", "signature", "place").agg(F.sum("n_docs").cast("long").alias("n"))
    keyed = seen.withColumn("key", F.explode(two_less("place"))).withColumn("rank", F.struct("n", "node"))
    other = keyed.select("number", "key", *[F.col(c).alias(f"{c}2") for c in ("node", "signature", "place", "n", "rank")])
    pairs = keyed.join(other, ["number", "key"]).filter("rank < rank2").select("node", "node2", "n2", "place", "place2", "signature", "signature2").dropDuplicates(["node", "node2"])
    apart = written(pairs.mapInArrow(_differences, _DIFFERENCE), "differences")
    counts = np.zeros((COSTS, SIGNS))
    for r in apart.groupBy("cost", "off").agg(F.count("*").alias("k")).collect():  # COSTS x SIGNS rows
        counts[r.cost, r.off] = r.k
    kinds = seen.groupBy("signature").agg(F.count("*").alias("k"))
    chance = kinds.agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), F.lit(2.0))).alias("c")).first()["c"]
    like, post = body_channel(counts, min(0.25, max(0.01, chance or 0.0)))
    table = [(c, o, float(like[c, o])) for c in range(COSTS) for o in range(SIGNS) if post[c, o] >= 0.5]
    channel = cards.sparkSession.createDataFrame(table, "cost int, off int, like double")
    likely = apart.join(F.broadcast(channel), ["cost", "off"]).withColumn("score", F.log("n") + F.col("like"))
    parents = likely.groupBy("node").agg(F.max_by("parent", F.struct("score", "parent")).alias("parent"))
    root = roots(rows.select("node").distinct(), parents)
    return rows.join(root, "node").select("card_id", "issued_by", F.col("root").alias("body_id"))
