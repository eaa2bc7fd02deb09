"""Records of two sources that describe the same people, by a label model.

Candidates come from several narrow keys. On each candidate pair a set of matching
functions votes with a level (same, near, compatible, silent, in conflict). No pair is
labelled: a generative model explains the vote patterns by a hidden variable (same person
or not). It learns how often each function gives each level on matches and on others,
and how functions depend on each other: the strongest dependences that remain inside the
classes (conditional mutual information above ``tie``) become the edges of a forest, and
an edge's two functions are modelled jointly. A silent function says nothing about
either class. Pairs that became candidates by their whole name alone are a stratum of
their own: their name functions are silent, as the name made them candidates, and they
have their own share of matches. The model is fitted by expectation
maximisation to the counts of the vote patterns, a table whose size is the product of the
numbers of levels and doesn't grow with the data. The posterior is the confidence.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.canonical import weighted
from rowmill.llm.names import _lexicon, _part, frozen, learn, read_names
from rowmill.llm.people import PARTS, digits, one_less
from rowmill.session import written

#: Matching functions: number of levels, and the level that says nothing.
VOTERS = {"v_surname": (4, 3), "v_first": (4, 1), "v_father": (4, 1), "v_birth": (5, 1), "v_number": (5, 1)}


def birth_parts(c: str) -> Column:
    """struct(yy, md, full): two-digit year, month-day, and whether the century is known,
    of a date written in any of the usual orders; nulls for what isn't there."""
    v = F.trim(F.col(c))
    g = lambda p, i: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    iso, dots, slashes, year = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", r"^(\d{4})$"
    full_year = F.coalesce(g(iso, 1), g(dots, 3), F.when(F.length(g(slashes, 3)) == 4, g(slashes, 3)), g(year, 1))
    yy = F.coalesce(F.substring(full_year, 3, 2), g(slashes, 3))
    month = F.coalesce(g(iso, 2), g(dots, 2), g(slashes, 2))
    day = F.coalesce(g(iso, 3), g(dots, 1), g(slashes, 1))
    return F.struct(yy.alias("yy"), F.concat_ws("-", F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).alias("md"), full_year.alias("year"))


def _levels(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(*learned)

        def part(a: str, b: str, known) -> int:
            like = _part(a, b, known)
            return 0 if like is None else 1 if not a or not b else 3 if like == 0 else 2

        for b in batches:
            out = []
            for s1, f1, p1, y1, m1, c1, n1, masked, s2, f2, p2, y2, m2, c2, numbers, lone in zip(*(b.column(i).to_pylist() for i in range(2, b.num_columns))):
                surname = 2 if s1 == s2 else 1 if weighted(s1, s2, 2.1) <= 2.1 else 0
                if not y1 or not y2:
                    birth = 1
                elif y1 != y2 or c1 and c2 and c1 != c2:
                    birth = 3 if m1 and m1 == m2 and sum(x != y for x, y in zip(y1, y2)) == 1 else 0
                elif not m1 or not m2:
                    birth = 2
                else:
                    birth = 4 if m1 == m2 else 3 if sorted(m1.split("-")) == sorted(m2.split("-")) or sum(x != y for x, y in zip(m1, m2)) == 1 else 0
                number = 1
                if n1 and numbers:
                    number = 0
                    for n in numbers:
                        if n1 == n:
                            number = max(number, 4)
                        elif masked and n.endswith(n1) or not masked and len(n1) > 6 and n1.endswith(n):
                            number = max(number, 3)
                        elif len(n) == len(n1) and sum(x != y for x, y in zip(n, n1)) == 1 or sorted(n) == sorted(n1):
                            number = max(number, 2)
                names = (3, 1, 1) if lone else (surname, part(f1, f2, lex.first), part(p1, p2, lex.patronymic))
                out.append((*names, birth, number, int(lone)))
            votes = list(zip(*out)) if out else [[]] * (len(VOTERS) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, pa.int32()) for v in votes]], names=["registry_id", "person_id", *VOTERS, "lone"])

    return run


class LabelModel:
    """The generative model over vote patterns (see the module)."""

    def __init__(self, levels: list[tuple[int, int]], tie: float = 0.05, rounds: int = 200, smooth: float = 0.5):
        self.levels, self.silent = [n for n, _ in levels], np.array([s for _, s in levels])
        self.tie, self.rounds, self.smooth = tie, rounds, smooth
        self.edges: list[tuple[int, int]] = []
        self.order = list(range(len(levels)))
        self.parent = dict.fromkeys(self.order, -1)

    def _tables(self, votes: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        tables = []
        for v in self.order:
            p = self.parent[v]
            shape = (self.levels[p] if p >= 0 else 1, self.levels[v])
            t = np.full(shape, self.smooth)
            said = votes[:, v] != self.silent[v]
            np.add.at(t, (votes[said, p] if p >= 0 else np.zeros(said.sum(), int), votes[said, v]), weight[said])
            if p >= 0 and self.silent[p] >= 0:  # beside a silent function the other one speaks for itself
                t[self.silent[p]] = t.sum(0)
            tables.append(t / t.sum(1, keepdims=True))
        return tables

    def _log(self, votes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(votes))
        for v, t in zip(self.order, tables):
            p = self.parent[v]
            total += np.where(votes[:, v] == self.silent[v], 0.0, np.log(t[votes[:, p] if p >= 0 else np.zeros(len(votes), int), votes[:, v]]))
        return total

    def _em(self, votes: np.ndarray, counts: np.ndarray, stratum: np.ndarray, post: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            prior = np.zeros(len(votes))
            for s in np.unique(stratum):
                own = stratum == s
                prior[own] = np.clip((counts * post)[own].sum() / counts[own].sum(), 1e-6, 1 - 1e-6)
            one, zero = self._tables(votes, counts * post), self._tables(votes, counts * (1 - post))
            a, b = np.log(prior) + self._log(votes, one), np.log(1 - prior) + self._log(votes, zero)
            new = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        return post

    def _dependences(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> list[tuple[float, int, int]]:
        found = []
        total = counts.sum()
        for i, j in itertools.combinations(range(len(self.levels)), 2):
            info = 0.0
            for w in (counts * post, counts * (1 - post)):
                t = np.full((self.levels[i], self.levels[j]), 1e-9)
                said = (votes[:, i] != self.silent[i]) & (votes[:, j] != self.silent[j])
                np.add.at(t, (votes[said, i], votes[said, j]), w[said])
                q = t / t.sum()
                info += t.sum() / total * float((q * np.log(q / (q.sum(1, keepdims=True) * q.sum(0, keepdims=True)))).sum())
            found.append((info, i, j))
        return sorted(found, reverse=True)

    def fit(self, votes: np.ndarray, counts: np.ndarray, stratum: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each pattern. Start: the agreement that the votes that say something show."""
        if not len(votes):
            return np.zeros(0)
        stratum = np.zeros(len(votes), int) if stratum is None else stratum
        said = votes != self.silent
        top = np.array([max(v for v in range(n) if v != s) for n, s in zip(self.levels, self.silent)])
        agree = np.where(said.any(1), (votes / top * said).sum(1) / np.maximum(said.sum(1), 1), 0.72)
        conflict = ((votes == 0) & said).sum(1)
        post = 1 / (1 + np.exp(-12 * (agree - 0.72) + 3 * conflict))
        # Dependences are looked for before fitting: a fit without them may make its hidden
        # variable of two functions that only copy each other.
        group = list(range(len(self.levels)))
        for info, i, j in self._dependences(votes, counts, post):
            if info >= self.tie and group[i] != group[j]:
                self.edges.append((i, j))
                group = [group[i] if g == group[j] else g for g in group]
        seen: list[int] = []
        for start in range(len(self.levels)):
            todo = [(start, -1)]
            while todo:
                v, p = todo.pop()
                if v in seen:
                    continue
                seen.append(v)
                self.parent[v] = p
                todo += [(b if a == v else a, v) for a, b in self.edges if v in (a, b)]
        self.order = seen
        return self._em(votes, counts, stratum, post)


def persons_of(members: DataFrame) -> DataFrame:
    """person_id, parts, birth, numbers: one row per person of :func:`rowmill.llm.people.people`."""
    part = lambda c: F.when(F.col(c) == "", 0).when(F.col(c).endswith("."), 1).otherwise(3)
    rank = F.struct((part("first") + part("father")).alias("full"), "n", *PARTS)
    spelled = members.groupBy("person_id", *PARTS).agg(F.count("*").alias("n"), F.max("birthday").alias("birthday"), F.collect_set("number").alias("numbers"))
    return spelled.groupBy("person_id").agg(
        F.max_by(F.struct(*PARTS), rank).alias("p"), F.max("birthday").alias("birthday"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"), F.sum("n").alias("n_rows")
    ).select("person_id", "p.*", "birthday", "numbers", "n_rows")


def candidates(registry: DataFrame, persons: DataFrame) -> DataFrame:
    """Candidate pairs with what the matching functions look at. Keys: year and surname
    less one letter; whole date, first name and patronymic; last digits of a number and
    initial; and, where a side has no date, the whole name if its bearers have one birthday
    at most (two known namesakes: the name alone says nothing about which one it is)."""
    r = registry.withColumn("b", birth_parts("birth_date")).withColumn("d", digits("document_number"))
    masked = F.coalesce(F.col("document_number").contains("*"), F.lit(False))
    r = r.withColumn("number", F.when(~masked & (F.length("d") == 10), F.expr("right(d, 6)")).otherwise(F.col("d"))).select(
        "registry_id", *PARTS, F.col("b.yy").alias("yy"), F.nullif("b.md", F.lit("")).alias("md"), F.col("b.year").alias("year"), "number", masked.alias("masked"))
    p = persons.withColumn("b", birth_parts("birthday")).select("person_id", *[F.col(c).alias(f"{c}2") for c in PARTS], F.col("b.yy").alias("yy2"), F.nullif("b.md", F.lit("")).alias("md2"), F.col("b.year").alias("year2"), "numbers")
    none = F.array().cast("array<string>")
    named = (F.col("first") != "") & (F.col("father") != "")
    keys_r = F.concat(
        F.when(F.col("yy").isNotNull(), F.transform(one_less("surname"), lambda x: F.concat(F.lit("y"), F.col("yy"), x))).otherwise(none),
        F.when(F.col("md").isNotNull() & named, F.array(F.concat_ws("/", F.lit("d"), "yy", "md", "first", "father"))).otherwise(none),
        F.when(F.col("number").isNotNull(), F.array(F.concat(F.lit("n"), F.expr("right(number, 4)"), F.substring("surname", 1, 1)))).otherwise(none),
    )
    named2 = (F.col("first2") != "") & (F.col("father2") != "")
    keys_p = F.concat(
        F.when(F.col("yy2").isNotNull(), F.transform(one_less("surname2"), lambda x: F.concat(F.lit("y"), F.col("yy2"), x))).otherwise(none),
        F.when(F.col("md2").isNotNull() & named2, F.array(F.concat_ws("/", F.lit("d"), "yy2", "md2", "first2", "father2"))).otherwise(none),
        F.array_distinct(F.transform(F.coalesce("numbers", none), lambda x: F.concat(F.lit("n"), F.right(x, F.lit(4)), F.substring("surname2", 1, 1)))),
    )
    met = r.withColumn("key", F.explode(keys_r)).join(p.withColumn("key", F.explode(keys_p)), "key").drop("key")
    whole = lambda s: [f"{c}{s}" for c in PARTS]
    born = persons.select("person_id", "birthday")
    same = p.filter("first2 <> '' AND father2 <> ''").join(born, "person_id").groupBy(*whole("2")).agg(F.collect_list("person_id").alias("ids"), F.countDistinct("birthday").alias("births"))
    only = same.filter("births <= 1").select(*whole("2"), F.explode("ids").alias("person_id"))  # the ids of one name and birthday
    lone = r.filter("first <> '' AND father <> '' AND surname <> ''").join(only, [F.col(a) == F.col(b) for a, b in zip(whole(""), whole("2"))])
    lone = lone.select(*r.columns, "person_id").join(p, "person_id").filter("yy IS NULL OR yy2 IS NULL")
    columns = ["registry_id", "person_id", *PARTS, "yy", "md", "year", "number", "masked", *whole("2"), "yy2", "md2", "year2", "numbers"]
    both = met.select(*columns, F.lit(0).alias("lone")).unionByName(lone.select(*columns, F.lit(1).alias("lone")))
    rest = [c for c in [*columns, "lone"] if c not in ("registry_id", "person_id")]
    return both.groupBy("registry_id", "person_id").agg(F.min_by(F.struct(*rest), "lone").alias("x")).select("registry_id", "person_id", "x.*")


def link(registry: DataFrame, members: DataFrame, residents: DataFrame, least: float = 0.5) -> DataFrame:
    """registry_id, person_id, confidence: each registry row with the person it describes,
    and with further ids of that person: those that reach ``least`` too and whose name and
    birth nowhere contradict the row (brothers and sisters reach it, but their first names do).

    registry: registry_id, full_name, birth_date, document_number; members: rows of
    :func:`rowmill.llm.people.people`; residents: the names the lexicon is learned from.
    Registry rows without a name, or whose best confidence is below ``least``, have no
    match; equal confidences go to the smaller person_id.
    """
    learned = frozen(learn(residents))
    registry = registry.select("registry_id", "full_name", "birth_date", "document_number").dropDuplicates(["registry_id"])
    parts = registry.join(read_names(registry, learned), "full_name")
    voted = candidates(parts, persons_of(members)).mapInArrow(_levels(learned), "registry_id long, person_id long, " + ", ".join(f"{v} int" for v in [*VOTERS, "lone"]))
    voted = written(voted, "votes")
    kinds = [*VOTERS, "lone"]
    patterns = voted.groupBy(*kinds).agg(F.count("*").alias("n")).toPandas()  # at most the product of the levels
    votes = patterns[list(VOTERS)].to_numpy(int)
    patterns["confidence"] = LabelModel(list(VOTERS.values())).fit(votes, patterns["n"].to_numpy(float), patterns["lone"].to_numpy(int))
    spark = registry.sparkSession
    scores = spark.createDataFrame(patterns.drop(columns="n"), ", ".join(f"{v} int" for v in kinds) + ", confidence double")
    scored = voted.join(F.broadcast(scores), kinds).filter(F.col("confidence") >= least)
    best = F.max_by(F.struct("person_id", "confidence"), F.struct("confidence", -F.col("person_id")))
    agrees = F.least("v_surname", "v_first", "v_father", "v_birth") > 0
    each = scored.groupBy("registry_id").agg(best.alias("b"), F.collect_list(F.when(agrees, F.struct("person_id", "confidence"))).alias("rest"))  # the persons one row may be
    each = each.select("registry_id", F.explode(F.array_distinct(F.concat(F.array("b"), "rest"))).alias("x"))
    return each.select("registry_id", "x.person_id", F.round("x.confidence", 6).alias("confidence"))
