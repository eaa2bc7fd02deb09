"""Postal addresses: reading them into levels, and linking them top-down.

The levels are town, street (with its type), house, building, structure, flat. A text is
read level by level; what is not written stays empty and later inherits candidates from
the level above. Linking goes the same way down: towns against the known towns, streets
against the streets of their town (frequent spellings are the candidates of rare ones
within one deletion), and at the bottom, inside one town, house, building, structure
and flat, the remaining spellings of the street within two edits are compared. A street
type that is missing or stands for two types stays a set of types until then: the types its
street has in the town, else those its ending agrees with. There it is what the one place
of the flat that fits says; where several fit, the record stays ambiguous. Records that
end above the flat inherit the places below their last level as candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.chars import cyrillic, deletes, osa, plain
from rowmill.llm.people import roots, two_less
from rowmill.session import written

# Spellings of the street types, and of the words before a person's name in a street.
STREET_TYPES = {
    "улица": "ул", "ул": "ул", "у": "ул",
    "переулок": "пер", "переул": "пер", "пер": "пер",
    "проезд": "пр-д", "прзд": "пр-д", "пр-д": "пр-д",
    "проспект": "пр-т", "просп": "пр-т", "пр-т": "пр-т", "пр-кт": "пр-т",
    "пр": "пр",
    "шоссе": "ш", "ш": "ш",
    "бульвар": "б-р", "бульв": "б-р", "бул": "б-р", "б-р": "б-р",
    "набережная": "наб", "наб": "наб", "площадь": "пл", "пл": "пл", "аллея": "ал", "тупик": "туп",
}
TITLES = ["агронома", "архитектора", "геолога", "доктора", "инженера", "летчика", "мастера", "машиниста", "строителя", "художника"]
HOME = "вербоград"
# Types by the ending of a name that agrees with them; a name without such an ending may have any type.
AGREE = {"(ая|яя)$": ["ал", "наб", "пл", "ул"], "(ое|ее)$": ["ш"], "(ый|ий|ой)$": ["б-р", "пер", "пр-д", "пр-т", "туп"]}

_BLANK = r"(?:_+|-|—)"
_POST = re.compile(r"(?<!\d)\d{6}(?!\d)")
_LAND = re.compile(r"(?:страна\s+)?\bроссия\b,?")
_FLAT = re.compile(r"(?<![а-я])(?:квартира|кварт|кв)\b\.?\s*(?:№|n)?\s*(\d+|_+|-(?!\d))")
_STRUCT = re.compile(rf"(?<![а-я\d])(?:строение|строен|стр|с)\.?\s*(?:№\s*)?(\d+|{_BLANK})(?![\w])")
_BUILD = re.compile(rf"(?<![а-я\d])(?:корпус|корп|кор|к)\.?\s*(?:№\s*)?(\d+|{_BLANK})(?![а-я])")
_HOUSE = re.compile(r"(?<![а-я-])(?:дом|д)\.?\s*(?:№|n)?\s*(\d+(?:\s?[абвгдежзи](?![а-я.]))?(?:/\d+[а-я]?)?)")
_TERSE = re.compile(r"(?<![\w/-])(\d+[абвгдежз]?(?:/\d+)?)(?:к(\d+))?(?:с(\d+))?(?:\s*[-,–]\s*(\d+))?(?![\w-])")
_TOWN = re.compile(r"(?<![а-я-])(?:город\s+|гор\.\s*|гор\s+|г\.\s*|г\s+)([а-я]{3,}(?:-[а-я]+)*)")
_ORD = re.compile(r"(\d+)\s*-?\s*(?:й|я|е|ая|ый|ое)(?![а-я])")
_DIGITISH = re.compile(r"(?<=\d)[зо](?=[\d/]|$|[^\w])|(?<![\w])[зо](?=\d)|(?<=[\d/])[зо](?=\d)")
_WORDS = re.compile(r"\d+-[а-я]|[а-я]+(?:-[а-я]+)*\.?")


def _digits(text: str) -> str:
    return _DIGITISH.sub(lambda m: "3" if m.group() == "з" else "0", text)


def house_number(text: str | None) -> str | None:
    """Comparable house number: digits, an optional letter, an optional fraction."""
    if text is None:
        return None
    text = cyrillic(plain(text).replace("⁄", "/")).lower().replace("ё", "е").replace(" ", "")
    text = "3" if text == "з" else _digits(text)
    return text.strip("№.") or None if not re.fullmatch(rf"{_BLANK}?", text) else None


def _number(text: object) -> str | None:
    if text is None or text != text:
        return None
    text = plain(str(text)).strip()
    return None if re.fullmatch(rf"{_BLANK}?", text) else (text.lstrip("0") or "0" if text.isdecimal() else text.lower())


def street_name(words: list[str]) -> tuple[str | None, str]:
    """(type or none, comparable name) of the words of a street."""
    kind, rest = None, []
    for w in words:
        bare = w.rstrip(".")
        if bare in STREET_TYPES and kind is None:
            kind = STREET_TYPES[bare]
        else:
            rest.append(w)
    name: list[str] = []
    for i, w in enumerate(rest):
        bare = w.rstrip(".")
        last = i == len(rest) - 1
        if not last and (w.endswith(".") or len(bare) <= 4) and not bare[:1].isdigit():
            fit = [t for t in TITLES if t.startswith(bare)]
            bare = fit[0] if fit and len(bare) >= 2 else bare
        elif not last and bare not in TITLES and len(bare) >= 5:
            fit = [t for t in TITLES if osa(t, bare, 2) <= 2]
            bare = fit[0] if len(fit) == 1 else bare
        name.append(bare)
    return kind, " ".join(name)


def parse(text: str | None, towns: dict[str, set[str]]) -> dict[str, str | None]:
    """Levels of one address text; every level not written is None.

    towns: known town by each of its spellings within one deletion (see :func:`town_index`).
    """
    out: dict[str, str | None] = dict.fromkeys(("town", "kind", "street", "house", "building", "structure", "flat"))
    if not text or not text.strip():
        return out
    s = cyrillic(plain(text)).lower().replace("ё", "е")
    s = _LAND.sub(" ", _POST.sub(" ", s))
    s = _ORD.sub(r"\1-я", s)
    s = _digits(s)
    for level, pattern in (("flat", _FLAT), ("house", _HOUSE), ("building", _BUILD), ("structure", _STRUCT)):
        if m := pattern.search(s):
            out[level] = _number(m[1].replace(" ", ""))
            s = s[: m.start()] + " , " + s[m.end() :]
    if out["house"] is None and (m := _TERSE.search(s)):
        out["house"] = _number(m[1])
        for level, n in (("building", 2), ("structure", 3), ("flat", 4)):
            out[level] = out[level] or _number(m[n])
        s = s[: m.start()] + " , " + s[m.end() :]
    if m := _TOWN.search(s):
        out["town"] = known_town(m[1], towns) or m[1]
        s = s[: m.start()] + " , " + s[m.end() :]
    parts = [w for p in s.split(",") if (w := _WORDS.findall(p))]
    if out["town"] is None:
        for p in parts:
            lone = [w for w in p if w.rstrip(".") not in STREET_TYPES]
            at = p[0].rstrip(".") if p else ""
            if (len(p) == 1 and len(parts) > 1 or len(lone) > 1 and p[0] == lone[0]) and (t := known_town(at, towns)):
                out["town"] = t
                p.pop(0)
                break
    words = [w for p in parts for w in p]
    if words:
        out["kind"], name = street_name(words)
        out["street"] = name or None
    return out


def town_index(names: list[str]) -> dict[str, set[str]]:
    """Deletion index of the known towns (the fixed reference list, so its size is bounded)."""
    index: dict[str, set[str]] = {}
    for n in names:
        n = n.lower().replace("ё", "е")
        for d in deletes(n, 2):
            index.setdefault(d, set()).add(n)
    return index


def known_town(word: str, index: dict[str, set[str]]) -> str | None:
    """The known town that ``word`` means, within two typing errors (one if short)."""
    if word in index.get(word, ()):
        return word
    if len(word) > 2 + max(map(len, index), default=0):
        return None
    near = {t for d in deletes(word, 2) for t in index.get(d, ())}
    best = min(((osa(word, t, 2), t) for t in near), default=(9, ""))
    return best[1] if best[0] <= (2 if len(word) >= 7 else 1) else None


LEVELS = "town string, kind string, street string, house string, building string, structure string, flat string"


def read_addresses(df: DataFrame, key: str, full: str, columns: dict[str, str], towns: list[str]) -> DataFrame:
    """``key`` and LEVELS of each row. full: column with the whole address; columns:
    level to column of addresses kept in parts. The whole address is read first, what it
    lacks comes from the parts; all null: all levels null."""
    index = town_index(towns)
    names = [c.split()[0] for c in LEVELS.split(", ")]
    used = [c for c in ("street", "house", "building", "structure", "flat") if c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for values in zip(pdf["_full"], *(pdf[f"_{c}"] for c in used)):
                got = parse(values[0], index)
                parts = dict(zip(used, values[1:]))
                if parts:
                    kind, name = (None, None)
                    if parts.get("street"):
                        p = parse(f"{parts['street']}", index)
                        kind, name = p["kind"], p["street"]
                    if got["street"] is None:
                        got["kind"], got["street"] = kind, name
                    elif got["kind"] in (None, "пр") and kind not in (None, "пр") and name and osa(name, got["street"], 3) <= 3:
                        got["kind"] = kind
                    if got["house"] is None:
                        got["house"] = house_number(parts.get("house"))
                    for c in ("building", "structure", "flat"):
                        if got[c] is None:
                            got[c] = _number(parts.get(c))
                rows.append([got[n] for n in names])
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    picked = df.select(key, F.col(full).alias("_full"), *[F.col(columns[c]).alias(f"_{c}") for c in used])
    return picked.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {LEVELS}")


COMPLETE = "street IS NOT NULL AND house IS NOT NULL AND flat IS NOT NULL"


def _variants(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` once per spelling of ``column`` with at most one letter left out (built-in functions only)."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(column)),
        lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, F.length(column))),
    )
    return df.withColumn("_d", F.explode(F.array_distinct(F.concat(F.array(F.col(column)), F.when(F.length(column) > 3, cut).otherwise(F.array().cast("array<string>"))))))


def streets(levels: DataFrame, ratio: int = 4) -> DataFrame:
    """Every spelling of a street within its town and the spelling it is taken for.

    town, street, n (records), canon (street), n_canon. A spelling is taken for the most
    frequent one within one deletion of it that is at least ``ratio`` times as frequent;
    numbers in the name must agree; ties go to the first in order. Otherwise it stands
    for itself.
    """
    names = levels.filter(F.col("street").isNotNull()).groupBy("town", "street").agg(F.count("*").alias("n"))
    common = names.filter(F.col("n") >= ratio).select("town", F.col("street").alias("canon"), F.col("n").alias("n_canon"))
    number = lambda c: F.regexp_extract(c, r"^\d+", 0)
    pairs = (
        _variants(names, "street").join(_variants(common, "canon"), ["town", "_d"])
        .filter((F.col("n_canon") >= ratio * F.col("n")) & (number("street") == number("canon")))
        .groupBy("town", "street")
        .agg(F.max_by("canon", F.struct(-F.levenshtein("street", "canon"), "n_canon", "canon")).alias("canon"), F.max_by("n_canon", F.struct(-F.levenshtein("street", "canon"), "n_canon", "canon")).alias("n_canon"))
    )
    known = names.join(pairs, ["town", "street"], "left")
    return known.select("town", "street", "n", F.coalesce("canon", "street").alias("canon"), F.coalesce("n_canon", "n").alias("n_canon"))


def _typed(levels: DataFrame, home: str) -> DataFrame:
    """``levels`` with the town filled, the spelling its street is taken for (canon, n_canon) and
    the types the street may have, in order and joined by commas: the one written, else those the
    street has in its town, else those its ending agrees with."""
    at = levels.withColumn("town", F.coalesce("town", F.lit(home)))
    at = at.join(streets(at).select("town", "street", "canon", "n_canon"), ["town", "street"], "left")
    per = at.filter(F.col("kind") != "пр").groupBy("town", "canon").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per street type
    last, many = F.element_at(F.split("canon", " "), -1), lambda kinds: F.array(*map(F.lit, kinds))
    agree = F.coalesce(*[F.when(last.rlike(end), many(kinds)) for end, kinds in AGREE.items()], many(sorted(set(STREET_TYPES.values()) - {"пр"})))
    both = many(["пр-д", "пр-т"])
    fit = F.when(F.col("kind") == "пр", F.array_intersect("kinds", both)).otherwise(F.col("kinds"))
    open_ = F.when(F.size(fit) > 0, fit).when(F.col("kind") == "пр", both).otherwise(agree)
    types = F.when(F.col("kind") != "пр", F.array("kind")).otherwise(F.array_sort(open_))
    return at.join(per, ["town", "canon"], "left").withColumn("types", F.concat_ws(",", types)).drop("kinds")


def _fit(one: str, two: str) -> "F.Column":
    """Two sets of types have one in common."""
    return F.arrays_overlap(F.split(one, ","), F.split(two, ","))


def _near(c1: str, n1: str, c2: str, n2: str) -> "F.Column":
    """Two spellings of a street may mean one: equal, or within two edits with equal numbers and not both established."""
    number = lambda c: F.regexp_extract(c, r"^\d+", 0)
    apart = (F.least(n1, n2) >= 4) & (F.least(n1, n2) * 4 > F.greatest(n1, n2))
    return F.when(F.col(c1) == F.col(c2), F.lit(True)).otherwise((F.levenshtein(c1, c2, 2) >= 0) & (number(c1) == number(c2)) & ~apart)


BLOCK = ["town", "house", "building", "structure", "flat"]


def link_addresses(levels: DataFrame, key: str, home: str = HOME) -> DataFrame:
    """``key`` and ``place_id`` of every record that reaches down to one flat: records of
    one place have the same place_id. Records that lack street, house or flat, and those whose
    street type is open and fits several places of the flat, have no place (they stay
    ambiguous) and are left out.

    levels: ``key`` and LEVELS, one row per record. Ties go to the more frequent, then the
    first spelling in order.
    """
    at = written(levels.filter(COMPLETE), "levels")  # read once, used by each level
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    at = written(_typed(at, home).select(key, "canon", "types", "n_canon", "town", "house", none("building"), none("structure"), "flat"), "streets")
    node = lambda types, street: F.concat_ws("|", "town", types, street, "house", "building", "structure", "flat")
    seen = at.groupBy(*BLOCK, "canon", "types").agg(F.max("n_canon").alias("n_canon"))
    several = seen.groupBy(*BLOCK).agg(F.count("*").alias("_k")).filter("_k > 1").drop("_k")  # a flat with one spelling has nothing to compare
    seen = seen.join(several, BLOCK, "left_semi").withColumn("key", F.explode(two_less("canon")))  # spellings of one flat meet within two edits, not all with all
    other = seen.select(*BLOCK, "key", F.col("canon").alias("c2"), F.col("types").alias("t2"), F.col("n_canon").alias("n2"))
    met = seen.join(other, [*BLOCK, "key"]).filter(_fit("types", "t2") & _near("canon", "n_canon", "c2", "n2"))
    met = met.select(node("types", "canon").alias("node"), node("t2", "c2").alias("node2"), "canon", "types", "n_canon", "c2", "t2", "n2").distinct()
    met = written(met.filter("node <> node2"), "met")
    rep = met.filter((F.col("types") == F.col("t2")) & (F.struct("n2", "c2") > F.struct("n_canon", "canon")))
    parents = written(rep.groupBy("node").agg(F.max_by("node2", F.struct("n2", "c2")).alias("parent")), "parents")
    nodes = parents.select("node").union(parents.select("parent")).distinct()
    same = roots(nodes, parents)  # chains of spellings end in one place
    # An open type is that of the nearest place with fewer types that fits, if this is one place.
    size = lambda types: F.size(F.split(types, ","))
    fewer = met.filter(size("t2") < size("types")).select("node", "node2", F.struct(F.levenshtein("canon", "c2").alias("far"), (size("t2") > 1).alias("open")).alias("rank"))
    fewer = fewer.join(same, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    fewer = fewer.join(same.select(F.col("node").alias("node2"), "root"), "node2", "left").select("node", "rank", F.coalesce("root", "node2").alias("place"))
    fitting = fewer.groupBy("node").agg(F.collect_set(F.struct("rank", "place")).alias("all"), F.min("rank").alias("rank"))  # as many as one flat has spellings near
    best = F.array_distinct(F.transform(F.filter("all", lambda x: x["rank"] == F.col("rank")), lambda x: x["place"]))
    parents = written(fitting.select("node", F.when(F.size(best) == 1, best[0]).otherwise(_NOWHERE).alias("parent")), "types")
    nodes = parents.select("node").union(parents.select("parent")).distinct()
    typed = roots(nodes, parents).select(F.col("node").alias("root"), F.col("root").alias("place"))
    at = at.select(key, node("types", "canon").alias("node")).join(same, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return at.join(typed, "root", "left").select(key, F.coalesce("place", "root").alias("place_id")).filter(F.col("place_id") != _NOWHERE)


#: Where the pointers of ambiguous records end.
_NOWHERE = ""


def inherit(levels: DataFrame, places: DataFrame, key: str, home: str = HOME) -> DataFrame:
    """``key``, place_id, n_candidates of every record with any level.

    places: ``key``, place_id of the records that reach down to one flat. Records that lack
    street, house or flat inherit all places that agree on the levels they have (streets as
    the more frequent spellings they are taken for, types as the sets they stand for); one candidate is their place, several stay
    ambiguous (place_id null). So do records that have all three and fit several places of their flat.
    """
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    all_ = _typed(levels, home).select(key, "town", F.col("canon").alias("street"), "n_canon", "types", "house", none("building"), none("structure"), "flat")
    full = F.col("street").isNotNull() & F.col("house").isNotNull() & F.col("flat").isNotNull()
    at = written(all_, "inherit")
    whole = at.filter(full).join(places, key).groupBy(*BLOCK, "street", "place_id").agg(F.max("n_canon").alias("n2"))
    whole = written(whole.withColumn("t2", F.element_at(F.split("place_id", r"\|"), 2)), "whole")
    out = places.select(key, "place_id", F.lit(1).cast("long").alias("n_candidates"))
    torn = at.filter(full).join(places, key, "left_anti").join(whole.withColumnRenamed("street", "c2"), BLOCK)
    torn = torn.filter(_fit("types", "t2") & _near("street", "n_canon", "c2", "n2")).groupBy(key, F.levenshtein("street", "c2").alias("far")).agg(F.countDistinct("place_id").alias("n"))
    out = out.unionByName(torn.groupBy(key).agg(F.min_by("n", "far").alias("n_candidates")).withColumn("place_id", F.lit(None).cast("string")))
    for have in (("street", "house"), ("street", "flat"), ("house", "flat"), ("street",), ("house",), ("flat",)):
        lacking = [c for c in ("street", "house", "flat") if c not in have]
        some = at
        for c in have:
            some = some.filter(F.col(c).isNotNull())
        for c in lacking:
            some = some.filter(F.col(c).isNull())
        on = ["town", *have, *(("building", "structure") if "house" in have else ())]
        per = some.select(*on, "types").distinct().join(whole.select(*on, "t2", "place_id").distinct(), on).filter(_fit("types", "t2"))
        per = per.groupBy(*on, "types").agg(F.countDistinct("place_id").alias("n_candidates"), F.min("place_id").alias("place_id"))
        met = some.join(per, [*on, "types"], "left").select(key, F.when(F.col("n_candidates") == 1, F.col("place_id")).alias("place_id"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
        out = out.unionByName(met)
    return out


def same_place_pairs(places: DataFrame, key: str) -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of the records of one place: the stated result of the
    problem, so it grows with the square of the records of one flat and of nothing else."""
    a = places.select(F.col(key).alias(f"{key}_a"), "place_id")
    b = places.select(F.col(key).alias(f"{key}_b"), "place_id")
    return a.join(b, "place_id").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
