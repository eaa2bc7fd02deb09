"""Personal information in free text, found by how strongly terms disclose it.

One scan of the corpus nominates terms and counts them. Patterns only nominate: values
in the form of a mail address, a phone, a street address or a number, and runs of
capitalised words that may hold a name. What is taken out is decided by how many bits a
term discloses, against one threshold for all types (``LEAST_BITS``):

* a value points at the texts that hold it: bits(value) = log2( texts / texts with it ). What
  stands in a large part of all texts (a service line under every letter) discloses nobody;
* a word of a name points at a protected entity: bits(term) = log2( P(protected | term) /
  P(protected) ), counted from the frames only a protected entity fills (beside initials or a
  patronymic), with P(protected | term) smoothed by the terms of the same ending, so that a
  name seen once is judged by its like. A second round lets disclosed terms vouch for their
  neighbours (short forms of first names beside surnames), and for the word that stands
  before a mention;
* a number in a form that other things have too is judged by the word before it: by how often
  numbers in an unmistakable form follow that word.

Terms beyond the threshold are generalised to their type; words that only stand near
mentions (``sent by``) fill no frame and stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.addresses import STREET_TYPES, known_town, town_index
from rowmill.session import written

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s{0,2}(?:@|\((?:собака|at|эт)\)|\[(?:собака|at|эт)\])\s{0,2}[A-Za-z0-9-]+(?:(?:\.|\s?[\[(](?:dot|точка)[\])]\s?)[A-Za-z0-9-]+)+", re.I)
_EMAIL_SIGN = ("@", "(соб", "[соб", "(СОБ", "(at", "[at", "[AT", "(AT", "(эт", "[эт")
_NUMBER = re.compile(
    r"""[+(\dIVXLC](?:
      (?P<phone>(?<=\+)7\s?\(\d{3}\)\s?\d{3}[\s-]?\d{2}[\s-]?\d{2} | (?<=\+)7[\s-]?\d{3}[\s-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}
        | (?<=8)\s?\(\d{3}\)\s?\d{3}[\s-]?\d{2}[\s-]?\d{2} | (?<=8)-\d{3}-\d{3}-\d{2}-\d{2} | (?<=8)\s\d{3}\s\d{3}[\s.-]\d{2}[\s.-]\d{2}
        | (?<=\()\d{3}\)\s?\d{3}[\s-]?\d{2}[\s-]?\d{2} | (?<=\d)\d{2}-\d{2}-\d{2})(?![\d-])(?:,?\s{1,2}(?:доб|ext|вн)\.?\s?\d{1,6})?
      | (?P<birth>[IVXLC]{0,5}\s?-\s?[А-ЯЁ]{2}\s?(?:(?:№|N)\s?)?\d{6})(?!\d)
      | (?P<strong>(?<=\d)\d[\s-]\d{2}\s?(?:№\s?)?\d{6} | (?<=\d)\d{3}\s?№\s?\d{6})(?!\d)
      | (?P<weak>(?<=\d)\d{3}\s?\d{6})(?![\d-])
      | (?P<long>(?<=\d)(?:\d{11}|\d{10}|\d{2}[\s-]\d{3}[\s-]\d{3}[\s-]\d{2}))(?![\d-])
    )""",
    re.X,
)
_PERSONAL_CUES = {"снилс", "инн"}
_RUN = re.compile(r"[А-ЯЁA-Z](?:\.|[\w-]+)(?:\s{0,2}[А-ЯЁA-Z](?:\.|[\w-]+))*")
_TOKEN = re.compile(r"[А-ЯЁA-Z](?:\.|[\w-]+)")
_PATRONYMIC = re.compile(r".{2,}(?:ович|евич|ьич|[^аеиоу]ич|овна|евна|инична|ична|ovich|evich|[^aeiou]ich|ovna|evna|ichna)$", re.I)
_DIGIT_NEAR = re.compile(r"\d")
_WORDS = sorted(STREET_TYPES, key=len, reverse=True)
_TYPE = "(?:" + "|".join(map(re.escape, _WORDS)) + ")"
# Short forms of the words before a person's name in a street.
_TITLE = "(?:арх|маш|мас|маст|худ|лёт|лет|инж|док|агр|гео|геол|стр)"
_TITLE_BEFORE = re.compile(rf"(?<![\w-]){_TITLE}\.\s{{0,2}}$", re.I)
_PART = {"дом", "д", "кв", "квартира", "корп", "корпус", "к", "стр", "строение"}
_SERIES = re.compile(r"[IVXLC]+-[А-ЯЁ]{2}$")
_TYPE_BEFORE = re.compile(rf"(?:^|[\s,(«;:.])({_TYPE})\.?\s{{0,2}}(?:\d-[а-яё]\s{{1,2}})?$", re.I)
_TYPE_AFTER = re.compile(rf"\s{{1,2}}{_TYPE}(?![\w-])\.?", re.I)
_ORDINAL = re.compile(r"\d-[а-яё]\s{1,2}$", re.I)
_HOUSE = re.compile(r"\.?[,\s]\s{0,2}(?:дом|д)\.?\s{0,2}(?:№\s?)?\d+(?:[а-и](?!\w))?(?:/\d+)?", re.I)
_TERSE = re.compile(r",?\s{1,2}\d{1,4}(?!\d)[А-И]?(?:/\d+)?(?:к\d+)?(?:с\d+)?(?:\s{0,2}[-,]\s{0,2}\d+)?(?![\w/])(?![.:]\d)(?!-[а-яё])", re.I)
_REST = re.compile(r"(?:[,\s]\s{0,2}(?:корпус|корп|кор|к|строение|стр|с|квартира|кв)\.?\s{0,2}(?:№\s?)?(?:\d+(?!\w)|_+|-(?=[\s,.]|$)))+", re.I)
_NAME = r"[А-ЯЁ][А-ЯЁа-яё]+(?:-[А-ЯЁа-яё]+)*"
_TOWN_AFTER = re.compile(rf",\s{{1,2}}(?:г\.\s?|гор\.\s?|город\s|г\s|гор\s)\s?{_NAME}", re.I)
_HEAD = re.compile(rf"(?:(?:страна\s{{1,2}})?Россия,\s{{1,2}}|(?<!\d)\d{{6}},\s{{1,2}}|(?<![\w-])(?:город\s|гор\.|гор\s|г\.|г\s)\s{{0,2}}{_NAME}[,\s]\s{{0,2}}|(?<![\w-])(?:квартира|кв)\.?\s{{0,2}}(?:№\s?)?\d+,\s{{0,2}}|(?<![\w-]){_TYPE}\.?\s{{0,2}}|(?<![\w-]){_TITLE}\.\s{{0,2}}|(?<!\d)\d-[а-яё]\s{{1,2}})$", re.I)
_TOWN_WORD = re.compile(r"(?<![\w-])(?:город\s|гор\.|гор\s|г\.|г\s)\s{0,2}$", re.I)
_TOWN_LEFT = re.compile(rf"(?<![\w-])({_NAME})(?:,\s{{0,2}}|\s{{1,2}})$")

#: Bits from which a term is taken out: it narrows the texts, or the words, it may belong to, to less than 2 ** -LEAST_BITS of all.
LEAST_BITS = 1.5
#: Texts the count of texts is raised by, so that in a handful of texts a value isn't public for standing in one of them.
UNSEEN = 1000
#: P(protected) counts as at most this, so that in a corpus of little but names a term that is mostly protected still discloses.
BASE_AT_MOST = 1 / 6
SCAN = "kind string, doc_id long, s int, e int, text string, cue string, n long"
_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("text", pa.string()), ("cue", pa.string()), ("n", pa.int64())])


def _cue(text: str, s: int) -> str:
    left = text[max(0, s - 24) : s].split()
    return left[-1].strip("().,;:«»\"").lower() or left[-1] if left else ""


def address_at(text: str, s: int, e: int, towns: dict[str, set[str]]) -> tuple[int, int] | None:
    """The street address whose street name is the run ``text[s:e]``, or none."""
    if m := _TITLE_BEFORE.search(text[max(0, s - 8) : s]):
        s -= len(m[0])
    before = _TYPE_BEFORE.search(text[max(0, s - 14) : s])
    after = _TYPE_AFTER.match(text, e)
    end = after.end() if after else e
    tokens = _TOKEN.findall(text, s, e)
    typed = bool(before or after or len(tokens) > 1 and any(t.lower() in STREET_TYPES for t in tokens))
    headed = _TOWN_WORD.search(text[max(0, s - 9) : s]) if len(tokens) > 1 else None
    s -= len(headed[0]) if headed else 0
    if m := _HOUSE.match(text, end):
        end = m.end()
    elif typed and (m := _TERSE.match(text, end)):
        end = m.end()
    elif not typed and (m := _TERSE.match(text, end)) and (headed or _HEAD.search(text[max(0, s - 40) : s]) or _TOWN_AFTER.match(text, m.end())):
        end = m.end()
    else:
        return None
    if m := _REST.match(text, end):
        end = m.end()
    if m := _TOWN_AFTER.match(text, end):
        end = m.end()
    while True:  # leftwards, part by part
        left = text[max(0, s - 60) : s]
        if m := _HEAD.search(left):
            s -= len(left) - m.start()
        elif (m := _TOWN_LEFT.search(left)) and known_town(m[1].lower().replace("ё", "е"), towns):
            s -= len(left) - m.start()
        else:
            return s, end


def scan(text: str, towns: dict[str, set[str]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(settled mentions (type, s, e), ambiguous numbers (kind, s, e, cue), runs (s, e, cue, street))."""
    found: list[tuple] = []
    numbers: list[tuple] = []
    taken: list[tuple[int, int]] = []
    if any(x in text for x in _EMAIL_SIGN):
        for m in _EMAIL.finditer(text):
            found.append(("EMAIL", m.start(), m.end()))
            taken.append(m.span())
    runs: list[tuple] = []
    stop = -1
    for m in _RUN.finditer(text):
        s, e = m.span()
        if s < stop:
            continue
        if s and text[s - 1].isalnum():
            cut = _TOKEN.match(text, s).end()
            s = cut + len(text[cut:e]) - len(text[cut:e].lstrip())
            if s >= e:
                continue
        if taken:
            e = min((a for a, b in taken if s < a < e), default=e)
            e = s + len(text[s:e].rstrip())
            if any(a < e and s < b for a, b in taken):
                continue
        near = _DIGIT_NEAR.search(text, e, e + 32)
        if not near and _TOKEN.match(text, s).end() == e:  # a lone word, and no house behind it: it only counts
            runs.append((s, e, None, False))
            continue
        tokens = list(_TOKEN.finditer(text, s, e))
        cut = next((t.start() for n, t in enumerate(tokens) if n and (t[0].rstrip(".").lower() in _PART and text[s:e].isupper() or _SERIES.match(t[0]))), e)
        e = s + len(text[s:cut].rstrip())
        title = _TITLE_BEFORE.search(text[max(0, s - 8) : s])
        if len(tokens) > 1 and _TYPE_AFTER.match(text, e) and (tokens[-1][0][-1] != "." and any(t[0].endswith(".") for t in tokens) or len(tokens[-1][0]) < 3):
            runs.append((s, tokens[-2].end(), _cue(text, s), False))  # a name right before a street
            s = tokens[-1].start()
        street = bool(title) or bool(s and text[s - 1] in "«\"“„") or bool(_TYPE_BEFORE.search(text[max(0, s - 14) : s]))
        street = street or _TOKEN.match(text, s)[0].lower() in STREET_TYPES or bool(_TYPE_AFTER.match(text, e))
        # Type, house word and sign take less than 32 signs: without a digit that near there is no house.
        if _DIGIT_NEAR.search(text, e, e + 32) and (at := address_at(text, s, e, towns)):
            while runs and runs[-1][1] > at[0]:
                runs.pop()
            found.append(("ADDRESS", *at))
            taken.append(at)
            stop = at[1]
            continue
        runs.append((s, e, _cue(text, s), street))
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        if s and (text[s - 1].isalnum() or text[s - 1] in "+-/:№" and m.lastgroup in ("phone", "weak", "long")) or any(a < e and s < b for a, b in taken):
            continue
        if s > 1 and text[s - 1] == "." and text[s - 2].isdigit():
            continue
        kind = m.lastgroup
        if kind == "phone":
            found.append(("PHONE", s, e))
        elif kind == "birth":
            found.append(("ID_NUMBER", s, e))
        else:
            cue = _cue(text, s)
            if cue in _PERSONAL_CUES or kind == "strong":
                found.append(("ID_NUMBER", s, e))
            if cue not in _PERSONAL_CUES and kind != "long":
                numbers.append((kind, s, e, cue))
    return found, numbers, runs


def evidence(tokens: list[str]) -> list[tuple[str, str]]:
    """(term, role) for the words of one run: ``F`` or ``S`` where the frame leaves no
    doubt that the word is a first name or a surname, ``?`` where a name may stand, which
    says nothing, ``-`` elsewhere."""
    if len(tokens) == 1:
        return [(tokens[0].lower(), "-")]
    kinds = ["I" if t.endswith(".") else "P" if _PATRONYMIC.match(t) else "W" for t in tokens]
    words = [i for i, k in enumerate(kinds) if k == "W"]
    role = {i: "?" if len(tokens) <= 5 else "-" for i in words}
    if "P" in kinds:
        p = kinds.index("P")
        if p - 1 in role:
            role[p - 1] = "F"
            rest = [i for i in words if i != p - 1]
            if len(rest) == 1 and "I" not in kinds and rest[0] in (p - 2, p + 1):
                role[rest[0]] = "S"
    elif "I" in kinds and len(words) == 1:
        role[words[0]] = "S"
    return [(tokens[i].lower(), r) for i, r in role.items()]


def comparable(kind: str, value: str) -> str:
    """A nominated value without what differs from writing to writing."""
    low = value.lower().replace("ё", "е")
    if kind in ("PHONE", "ID_NUMBER"):
        digits = re.sub(r"[^0-9a-zа-я]", "", low)
        return digits[1:] if kind == "PHONE" and len(digits) == 11 and digits[0] in "78" else digits
    return re.sub(r"\W", "", low) if kind == "EMAIL" else " ".join(re.findall(r"\w+", low))


def scan_corpus(docs: DataFrame, towns: list[str]) -> DataFrame:
    """One pass over the texts: SCAN rows. Counts are summed within a batch before they leave the worker."""
    index = town_index(towns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            counts: Counter = Counter()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                found, numbers, runs = scan(text, index)
                counts["TEXTS", None, None] += 1
                held: set = set()
                for k, s, e in found:
                    value = comparable(k, text[s:e])
                    out.append((k, doc, s, e, value, None, int((k, value) not in held)))  # n: 1 where a text has the value first
                    held.add((k, value))
                for kind, s, e, cue in numbers:
                    if kind == "weak":
                        out.append(("NUMBER", doc, s, e, kind, cue, None))
                    counts["CUE", cue, kind] += 1
                for s, e, cue, street in runs:
                    raw = text[s:e]
                    tokens = _TOKEN.findall(raw)
                    if street:
                        for t in tokens:
                            counts["TERM", t.lower(), "-"] += 1
                        continue
                    for term, role in evidence(tokens):
                        counts["TERM", term, role] += 1
                    if len(tokens) > 1:
                        out.append(("RUN", doc, s, e, raw, cue, None))
                        if len(tokens) == 2 and not any(t.endswith(".") or _PATRONYMIC.match(t) for t in tokens):
                            counts["PAIR", tokens[0].lower(), tokens[1].lower()] += 1
            out += [(k, None, None, None, a, c, n) for (k, a, c), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, _ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN)


def disclosure(scanned: DataFrame, prior_weight: float = 2.0) -> DataFrame:
    """term, total, p (P(protected | term)), first (share of first-name frames), bits."""
    role = lambda r: F.sum(F.when(F.col("cue") == r, F.col("n")).otherwise(0))
    terms = scanned.filter("kind = 'TERM'").groupBy(F.col("text").alias("term")).agg((F.sum("n") - role("?")).alias("total"), role("F").alias("f"), role("S").alias("s"))
    terms = terms.withColumn("e3", F.expr("right(term, 3)")).withColumn("e4", F.expr("right(term, 4)"))
    end3 = terms.groupBy("e3").agg((F.sum("s") / (F.sum("total") + 8.0)).alias("p3"))
    end4 = terms.groupBy("e4").agg(F.sum("s").alias("s4"), F.sum("total").alias("t4"))
    terms = terms.join(end3, "e3").join(end4, "e4").withColumn("p_ending", (F.col("s4") + 4 * F.col("p3")) / (F.col("t4") + 4))
    one = terms.select(
        "term", "total", "f", "s", "p_ending",
        (F.col("f") / (F.col("total") + 1.0)).alias("p_f"),
        ((F.col("s") + prior_weight * F.col("p_ending")) / (F.col("total") + prior_weight)).alias("p_s"),
    )
    pairs = scanned.filter("kind = 'PAIR'").groupBy(F.col("text").alias("a"), F.col("cue").alias("b")).agg(F.sum("n").alias("n"))
    side = lambda x: one.select(F.col("term").alias(x), F.col("p_f").alias(f"{x}_f"), F.col("p_s").alias(f"{x}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    vouched = both.select(F.explode(F.array(
        F.struct(F.col("a").alias("term"), F.when(F.col("b_s") >= 0.3, F.col("n")).otherwise(0).alias("f2"), F.when(F.col("b_f") >= 0.3, F.col("n")).otherwise(0).alias("s2")),
        F.struct(F.col("b").alias("term"), F.when(F.col("a_s") >= 0.3, F.col("n")).otherwise(0).alias("f2"), F.when(F.col("a_f") >= 0.3, F.col("n")).otherwise(0).alias("s2")),
    )).alias("v")).select("v.*").groupBy("term").agg(F.sum("f2").alias("f2"), F.sum("s2").alias("s2"))
    two = one.join(vouched, "term", "left").fillna(0, ["f2", "s2"])
    two = two.withColumn("total", F.col("total") + F.greatest("f2", "s2")).withColumn("hit", F.col("f") + F.col("s") + F.greatest("f2", "s2"))
    two = two.withColumn("p", (F.col("hit") + prior_weight * F.col("p_ending")) / (F.col("total") + prior_weight))
    base = two.agg(F.least(F.lit(BASE_AT_MOST), F.sum("hit") / F.sum("total")).alias("base"))  # one row
    return two.crossJoin(F.broadcast(base)).select("term", "total", "p", F.greatest("p_f", (F.col("f") + F.col("f2")) / (F.col("total") + 1.0)).alias("first"), F.log2(F.col("p") / F.col("base")).alias("bits"))


MENTIONS = "doc_id long, pii_type string, start_pos int, end_pos int"
_OUT = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("cue", pa.string()), ("sure", pa.int32()), ("head", pa.string())])


def _beside_initials(tokens: list[str], p: dict[str, float], limit: float) -> dict[str, float]:
    """Initials never stand alone: if no word beside them is disclosed, the likelier of the
    neighbours is the name (the left one of equal ones, as lists put the surname first)."""
    j = 0
    while (i := next((n for n in range(j, len(tokens)) if tokens[n].endswith(".")), None)) is not None:
        j = i
        while j < len(tokens) and tokens[j].endswith("."):
            j += 1
        beside = [tokens[n].lower() for n in (i - 1, j) if 0 <= n < len(tokens)]
        if not beside or any(p.get(w, 0) >= limit for w in beside):
            continue
        best = max(beside, key=lambda w: p.get(w, 0))
        if len(beside) == 1 or p.get(best, 0) > 0:
            p = p | {best: 1.0}
    return p


def split_names(kinds: str) -> list[int]:
    """Where the further names of a chain begin (kinds: I initial, P patronymic, W word): after
    a surname with its initials where a word with initials or initials with a word follow,
    and after a name with its patronymic where another patronymic or initials follow."""
    out, at = [], 0
    while m := re.match(r"(?:I+W|WI{1,2}+)(?=WI|I+W)|WWP(?=W*[PI])|WPW(?=WP|WWP|WI|I)|WP(?=WI|I)", kinds[at:]):
        at += m.end()
        out.append(at)
    return out


#: How far a word beside a sure name may fall short of the threshold (as a share of its disclosure) and still be a part of it.
_FAINT = 1 / 12


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the names out of a run, given what its words disclose, as a multiple of the
    threshold: every chain of adjoining name parts with two parts or more, cut where a second
    full name begins. sure: 1 if its terms disclose it, 0 if it only has the shape."""
    for b in batches:
        out = []
        for doc, s, raw, cue, known in zip(*(b.column(i).to_pylist() for i in range(5))):
            p = {k["term"]: k["p"] for k in known or []}
            first = {k["term"]: k["first"] for k in known or []}
            spans = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(raw)]
            p = _beside_initials([t for t, _, _ in spans], p, 1.0)
            chain: list[tuple] = []
            chains = []
            for t, a, z in [*spans, ("", 0, 0)]:
                part = "I" if t.endswith(".") else "P" if t and _PATRONYMIC.match(t) else "W" if t and p.get(t.lower(), 0) >= 1.0 else ""
                if part:
                    chain.append((part, a, z))
                    continue
                if chain:
                    chains.append(chain)
                    chain = []
            chains = [c for c in chains if len(c) > 1 and any(x[0] != "I" for x in c) and (any(x[0] != "W" for x in c) or any(first.get(raw[a:z].lower(), 0) >= 0.1 for _, a, z in c))]
            names = []
            for c in chains:
                cuts = [0, *split_names("".join(x[0] for x in c)), len(c)]
                names += [c[x:y] for x, y in zip(cuts, cuts[1:])]
            used = {x[1] for c in names for x in c}
            for k, c in enumerate(names):
                if len(c) == 2 and "P" in (c[0][0], c[1][0]):  # a likely surname beside a first name and a patronymic
                    i = next(n for n, x in enumerate(spans) if x[1] == c[0][1])
                    for n in (i - 1, i + 2):
                        if len(names[k]) == 2 and 0 <= n < len(spans) and spans[n][1] not in used and p.get(spans[n][0].lower(), 0) >= _FAINT:
                            names[k] = sorted([*c, ("W", *spans[n][1:])], key=lambda x: x[1])
                            used.add(spans[n][1])
            if not names and len(spans) == 2:  # a settled first name and a possible surname
                known_as = sorted((first.get(t.lower(), 0), p.get(t.lower(), 0)) for t, _, _ in spans)
                if known_as[1][0] >= 0.3 and known_as[0][1] >= _FAINT:
                    names = [[("W", *x[1:]) for x in spans]]
            if names:  # the word before a run vouches for its first name only
                out += [(doc, s + c[0][1], s + c[-1][2], None if k else cue, 1, None) for k, c in enumerate(names)]
            elif 2 <= len(spans) <= 3 and not any(t.endswith(".") for t, _, _ in spans):
                out.append((doc, s, s + len(raw), cue, 0, spans[0][0].lower()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, _OUT)], schema=_OUT)


def disclosing(scanned: DataFrame, least_bits: float) -> DataFrame:
    """The nominated values but for those found in so many texts that they disclose less
    than ``least_bits``. There can't be many of these (a text's mentions times
    2 ** least_bits), so they go to the rows, and no value's rows are brought together."""
    values = scanned.filter("kind IN ('EMAIL', 'PHONE', 'ADDRESS', 'ID_NUMBER')")
    texts = scanned.filter("kind = 'TEXTS'").agg((F.coalesce(F.sum("n"), F.lit(0)) + UNSEEN).alias("texts"))  # one row
    held = values.groupBy("kind", "text").agg(F.sum("n").alias("held"))
    public = held.crossJoin(F.broadcast(texts)).filter(F.log2(F.col("texts") / F.col("held")) < least_bits).select("kind", "text")
    return values.join(F.broadcast(public), ["kind", "text"], "left_anti").select("doc_id", F.col("kind").alias("pii_type"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))


def mentions(docs: DataFrame, towns: list[str], least_bits: float = LEAST_BITS, cue_limit: float = 0.6) -> DataFrame:
    """Every mention of personal information: MENTIONS, positions in code points.

    docs: doc_id (unique), text; null and empty texts have none; further columns are
    ignored. least_bits: what a term must disclose at least; cue_limit: least share of
    names among the runs after a word for that word to vouch for an unknown run, which must
    begin with a term that stands mostly after such words.
    """
    scanned = written(scan_corpus(docs, towns), "pii", "kind")
    settled = disclosing(scanned, least_bits)

    cues = scanned.filter("kind = 'CUE'").groupBy(F.col("text").alias("cue")).agg(
        F.sum(F.when(F.col("cue") == "strong", F.col("n")).otherwise(0)).alias("strong"), F.sum("n").alias("all")
    )
    sure = cues.filter(F.col("strong") >= 0.2 * F.col("all")).select("cue")
    numbers = scanned.filter("kind = 'NUMBER'").join(sure, "cue", "left_semi").select("doc_id", F.lit("ID_NUMBER").alias("pii_type"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))

    terms = disclosure(scanned).filter(F.col("p") >= 0.01).select("term", F.pow(F.lit(2.0), F.col("bits") - least_bits).alias("p"), "first")
    runs = scanned.filter("kind = 'RUN'").select("doc_id", "s", "text", "cue")
    parts = runs.select("doc_id", "s", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]{2,}', 0)"))).alias("term"))
    known = parts.join(terms, "term").groupBy("doc_id", "s").agg(F.collect_list(F.struct("term", "p", "first")).alias("known"))  # the words of one run
    named = runs.join(known, ["doc_id", "s"], "left").mapInArrow(_assemble, "doc_id long, s int, e int, cue string, sure int, head string")
    named = written(named, "names")
    vouch = named.groupBy("cue").agg(F.avg("sure").alias("share"), F.count("*").alias("n")).filter(f"share >= {cue_limit} AND n >= 5").select("cue", F.lit(1).alias("vouched"))
    open_runs = named.filter("sure = 0").join(vouch, "cue", "left")
    heads = open_runs.groupBy("head").agg(F.avg(F.coalesce("vouched", F.lit(0))).alias("after_cue")).filter("after_cue >= 0.5").select("head")
    names = named.filter("sure = 1").unionByName(open_runs.filter("vouched = 1").join(heads, "head", "left_semi").select(named.columns))
    names = names.select("doc_id", F.lit("NAME").alias("pii_type"), F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
    return settled.unionByName(numbers).unionByName(names)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, n_mentions: each mention replaced by a placeholder of its type, the rest
    of the text as it was. Overlapping mentions: the one that starts first, then the longer."""
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("m"), "end_pos", "pii_type"))).alias("spans"))  # the mentions of one text
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x["start_pos"] < a["at"], a).otherwise(F.struct(
        x["end_pos"].alias("at"),
        F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start_pos"] - a["at"]), F.lit("["), x["pii_type"], F.lit("]")).alias("out"),
        (a["n"] + 1).alias("n"),
    ))
    joined = docs.select("doc_id", "text").join(per, "doc_id", "left")
    done = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start_pos:int,m:int,end_pos:int,pii_type:string>>")), start, step)
    return joined.withColumn("_r", done).select("doc_id", F.concat("_r.out", F.expr("substring(text, _r.at + 1)")).alias("text"), F.col("_r.n").alias("n_mentions"))
