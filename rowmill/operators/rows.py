"""Rows of the residents' table: what belongs to which cell of a row, row by row.

A row is an array of its words (text, left, top, width, height, in reading order), so every
operator is an expression over one row; the words of a page are brought into rows by the
as-of bands of ``layout``."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.text import NAME_STOPS, clamp, let, merge_hyphens, name_tokens, ws
from rowmill.functions.text import name_words as name_text
from rowmill.operators import departures as P
from rowmill.operators import identity as D
from rowmill.operators.layout import anchored_groups
from rowmill.operators.reconcile import split_tokens, without_noise

WORD = "struct<top:int,left:int,ord:int,text:string,width:int,height:int>"
DATE = r"\d{2}\.\d{2}\.\d{4}"
# The columns of the table (left, right) on a page of 2480 pixels.
COLUMNS = {"full_name": (0, 560), "birth_date": (500, 930), "current_passport": (1180, 2050), "departure": (2050, 2800)}
# What ends the table, and what its header on a continuation page holds.
ENDS = ["Кроме того", "Наниматель", "Наличие мер", "Субсидия", "Еще проживает"]
HEADER = "(?iu)фамилия|отчество|дата ро|место ро|родствен|серия пас|с какого|дата реги|куда и ко|выдан|москве"


def right(w: Column) -> Column:
    return w["left"] + w["width"]


def middle(w: Column) -> Column:
    return w["left"] + w["width"] / 2


def raw_text(words: Column) -> Column:
    """The words of a cell in reading order, in one line."""
    return ws(F.array_join(F.transform(F.array_sort(words), lambda w: w["text"]), " "))


def row_words(words: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``words``, the words of each group in reading order (one row of a page)."""
    return words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("top", "left", F.col("ord").cast("int").alias("ord"), "text", "width", "height"))).cast(f"array<{WORD}>").alias("words"))


def box(words: Column) -> Column:
    """struct<left, top, width, height> around words; null for none."""
    low, high = lambda f: F.array_min(F.transform(words, f)), lambda f: F.array_max(F.transform(words, f))
    return F.when(F.size(words) > 0, let(F.struct(low(lambda w: w["left"]).alias("l"), low(lambda w: w["top"]).alias("t"), high(right).alias("r"), high(lambda w: w["top"] + w["height"]).alias("b")), lambda e: F.struct(e["l"].alias("left"), e["t"].alias("top"), (e["r"] - e["l"]).alias("width"), (e["b"] - e["t"]).alias("height"))))


# Bounds of the columns ---------------------------------------------------------------------


def primary_date(words: Column, top: Column, left: Column | int, right_: Column | int) -> Column:
    """The word with a date, its middle within the column, nearest to the row's top; ties: the leftmost."""
    fit = F.filter(words, lambda w: w["text"].rlike(DATE) & (middle(w) >= left) & (middle(w) < right_))
    return F.array_min(F.transform(fit, lambda w: F.struct(F.abs(w["top"] - top).alias("far"), w["left"].alias("left"), w.alias("word"))))["word"]


def document_like(words: Column, min_left: Column | int) -> Column:
    """Words right of ``min_left`` that only a document has."""
    return F.filter(words, lambda w: (right(w) > min_left) & w["text"].rlike("(?iu)паспорт|свидетель|выдан|мвд|овд|уфмс|№|\\d{6}"))


def document_start(words: Column, min_left: Column | int, otherwise: int) -> Column:
    """The left edge of a row's document: of its words, else of a number or date there, else the usual one."""
    edge = lambda ws_: F.array_min(F.transform(ws_, lambda w: w["left"]))
    numbers = F.filter(words, lambda w: (w["left"] >= min_left) & w["text"].rlike(rf"\d{{6}}|{DATE}"))
    return F.coalesce(edge(document_like(words, min_left)), edge(numbers), F.lit(otherwise))


def row_bounds(words: Column, top: Column, columns: dict[str, tuple[int, int]] = COLUMNS) -> Column:
    """struct<name_right, birth_left, birth_right, document_left, document_right, departure_left>: the usual
    columns moved to where this row's birthday and document begin, within fixed limits, none over another."""
    (name_l, name_r), (birth_l, birth_r), (doc_l, doc_r), (dep_l, _) = (columns[c] for c in ("full_name", "birth_date", "current_passport", "departure"))
    int_ = lambda c: c.cast("int")

    def moved(b: Column) -> Column:
        bl = F.when(b.isNull(), F.lit(birth_l)).otherwise(clamp(b["left"] - 18, birth_l - 120, birth_l + 80))
        br = F.when(b.isNull(), F.lit(birth_r)).otherwise(clamp(right(b) + 28, birth_r - 120, birth_r + 120))
        nr = F.when(b.isNull(), F.lit(name_r)).otherwise(F.least(F.lit(name_r), bl - 16))
        dl = clamp(document_start(words, br, doc_l) - 12, doc_l - 180, doc_l + 120)
        return F.struct(int_(nr).alias("nr"), int_(bl).alias("bl"), int_(br).alias("br"), int_(dl).alias("dl"))

    def apart(m: Column) -> Column:
        nr = F.greatest(m["nr"], F.lit(name_l + 140))
        bl = F.greatest(m["bl"], nr - 40)
        br = F.greatest(F.least(m["br"], m["dl"] - 20), bl + 90)
        dl = F.greatest(m["dl"], br + 20)
        dr = F.lit(min(doc_r, dep_l - 10))
        return F.struct(nr.alias("name_right"), bl.alias("birth_left"), br.alias("birth_right"), dl.alias("document_left"), dr.alias("document_right"), F.greatest(F.lit(dep_l), dr + 10).alias("departure_left"))

    return let(primary_date(words, top, birth_l, birth_r), lambda b: let(moved(b), apart))


def adaptive_columns(rows: DataFrame, by: list[str], columns: dict[str, tuple[int, int]] = COLUMNS, first: int = 6) -> DataFrame:
    """``by`` and the columns of a table by the medians of its first rows: name_right, birth_left, birth_right, document_left, document_right.
    rows: ``by``, anchor_top, words."""
    (_, name_r), (birth_l, birth_r), (doc_l, doc_r) = (columns[c] for c in ("full_name", "birth_date", "current_passport"))
    w = Window.partitionBy(*by).orderBy("anchor_top")
    each = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first).withColumn("b", primary_date(F.col("words"), F.col("anchor_top"), max(0, birth_l - 160), birth_r + 160))
    docs = document_like(F.col("words"), birth_r - 40)
    edges = each.select(
        *by, F.col("b.left").alias("bl"), right(F.col("b")).alias("br"), F.array_min(F.transform(docs, lambda x: x["left"])).alias("dl"), F.array_max(F.transform(docs, right)).alias("dr"),
        F.array_max(F.transform(F.filter("words", lambda x: (x["left"] < F.coalesce(F.col("b.left"), F.lit(birth_l))) & ~x["text"].rlike(DATE)), right)).alias("nr"),
    )
    mid = lambda c, off, low, high, usual: F.coalesce(clamp(F.floor(F.median(c)).cast("int") + off, low, high), F.lit(usual)).cast("int")
    m = edges.groupBy(*by).agg(mid("nr", 35, 420, 760, name_r).alias("nr"), mid("bl", -35, 420, 760, birth_l).alias("bl"), mid("br", 55, 700, 1050, birth_r).alias("br"), mid("dl", -30, 900, 1320, doc_l).alias("dl"), mid("dr", 50, 1250, 2050, doc_r).alias("dr"))
    nr = F.least(F.col("nr"), F.col("bl") - 25)
    return m.select(*by, nr.alias("name_right"), F.greatest(F.col("bl"), nr - 80).alias("birth_left"), F.least(F.col("br"), F.col("dl") - 30).alias("birth_right"), F.col("dl").alias("document_left"), F.col("dr").alias("document_right"))


def table_end(words: DataFrame, by: list[str]) -> DataFrame:
    """``by``, end_top: where the table of a page ends (its first word of what follows it)."""
    ends = functools.reduce(lambda a, b: a | b, [F.col("text").contains(e) for e in ENDS])
    return words.filter(ends).groupBy(*by).agg(F.min("top").alias("end_top"))


def header_bottom(words: DataFrame, by: list[str], usual: int) -> DataFrame:
    """``by``, bottom: where the header of a continuation page ends; ``usual`` if it has none above that."""
    above = F.when((F.col("top") < usual) & F.col("text").rlike(HEADER), F.col("top"))
    return words.groupBy(*by).agg(F.coalesce(F.max(above) + 24, F.lit(usual)).cast("int").alias("bottom"))


# Words of the cells ------------------------------------------------------------------------


def overlapping(words: Column, left: Column | int, right_: Column | int) -> Column:
    """Words that reach into a column."""
    return F.filter(words, lambda w: (w["left"] < right_) & (right(w) > left))


def name_words(words: Column, bounds: Column) -> Column:
    """Words of the name column, which may spill over 180 pixels (patronymics do)."""
    return overlapping(words, 0, bounds["name_right"] + 180)


def birth_words(words: Column, bounds: Column) -> Column:
    """Dates that reach into the birthday column, and other words whose middle lies in it."""
    left, end = bounds["birth_left"], bounds["birth_right"]
    return F.filter(words, lambda w: F.when(w["text"].rlike(DATE), (w["left"] < end) & (right(w) > left)).otherwise((middle(w) >= left) & (middle(w) < end)))


def has_head(words: Column) -> Column:
    """Whether words begin a document: its name, or the sign and six digits."""
    return raw_text(words).rlike("(?iu)паспорт|свидетель|справка|№\\s*\\d{6}")


def document_words(words: Column, bounds: Column) -> Column:
    """Words of the document column; without a document's head also what stands left of it, up to the birthday."""
    own = overlapping(words, bounds["document_left"], bounds["document_right"])
    wider = F.filter(words, lambda w: (right(w) > F.greatest(bounds["birth_right"] - 220, bounds["birth_left"] + 40)) & (w["left"] < bounds["document_right"]))
    return let(own, lambda o: F.when(has_head(o), o).otherwise(F.array_sort(F.array_distinct(F.concat(o, wider)))))


def anchor_points(text: Column) -> Column:
    """How surely a word begins a document: 5 its name, 4 the sign and number, 3 six digits, 2 "issued", 1 a date."""
    return F.when(text.rlike("(?iu)паспорт|свидетель|справка"), 5).when(text.rlike("№\\s*\\d{6,8}"), 4).when(text.rlike("\\d{6}"), 3).when(text.rlike("(?iu)выдан"), 2).when(text.rlike(DATE), 1).otherwise(0)


def departure_points(text: Column) -> Column:
    """How surely a word begins a departure."""
    low = F.translate(F.lower(text), "ё", "е")
    return F.when(low.rlike("смерт|умер|форм[ыа] 6|отрывному талону"), 6).when(low.contains("а/з") | (low == "аз") | text.rlike("(?<!\\d)\\d{21}(?!\\d)"), 5).when(low.rlike("оф\\.|загс"), 4).otherwise(0)


def _anchor(words: Column, min_left: Column, points) -> Column:
    scored = F.transform(F.filter(words, lambda w: (right(w) > min_left) & (points(w["text"]) > 0)), lambda w: F.struct((-points(w["text"])).alias("p"), w["left"].alias("l"), w.alias("w")))
    return F.array_min(scored)["w"]


def document_cluster(words: Column, bounds: Column) -> Column:
    """From the word that begins a document most surely, all words right of it up to the departure; empty if none does."""
    near = lambda a: F.filter(words, lambda w: (right(w) > F.greatest(bounds["birth_right"] - 40, a["left"] - 24)) & (w["left"] < bounds["departure_left"]))
    return let(_anchor(words, bounds["birth_right"] - 80, anchor_points), lambda a: F.when(a.isNotNull(), near(a)).otherwise(F.array().cast(f"array<{WORD}>")))


def departure_cluster(words: Column, bounds: Column) -> Column:
    """The same for departures; without such a word, what stands right of the middle of the words at the right edge."""
    near = lambda a: F.filter(words, lambda w: right(w) > F.greatest(bounds["document_right"] - 20, a["left"] - 30))
    edge = F.filter(words, lambda w: right(w) > F.greatest(bounds["document_right"] + 80, bounds["departure_left"] - 80))
    return let(_anchor(words, bounds["document_right"] - 40, departure_points), lambda a: F.when(a.isNotNull(), near(a)).otherwise(rightmost(edge)))


def rightmost(words: Column) -> Column:
    """Words from 60 pixels left of the middle left edge on."""
    lefts = F.array_sort(F.transform(words, lambda w: w["left"]))
    return let(F.get(lefts, F.floor(F.size(lefts) / 2).cast("int")), lambda pivot: F.filter(words, lambda w: w["left"] >= pivot - 60))


def begins_departure(words: Column) -> Column:
    low = F.translate(F.lower(raw_text(words)), "ё", "е")
    return low.rlike("по смерти|дата смерти|умер|форм[ыа] 6|отрывному талону|а/")


def deep_words(table: Column, top: Column, bottom: Column, next_top: Column, bounds: Column, below: int, over_next: int, left: Column) -> Column:
    """Words right of ``left`` from a row's top to ``below`` under its end, not beyond ``over_next`` under the next row's top."""
    end = F.least(bottom + below, F.coalesce(next_top + over_next, bottom + below))
    return F.filter(table, lambda w: (w["top"] >= top) & (w["top"] < end) & (right(w) > left))


# Clusters of a document --------------------------------------------------------------------


def left_of_second_head(words: Column) -> Column:
    """Words left of the second document's head, if a row holds two at least 220 pixels apart; else null."""
    heads = F.array_sort(F.transform(F.filter(words, lambda w: anchor_points(w["text"]) >= 4), lambda w: w["left"]))
    second = F.array_min(F.filter(heads, lambda l: l - heads[0] >= 220))
    return let(second, lambda s: F.when(s.isNotNull(), F.filter(words, lambda w: w["left"] < s - 30)))


def clusters(words: Column, gap: int = 140) -> Column:
    """array<array<word>>: words by their left edge; one that begins more than ``gap`` right of all before it opens a new cluster."""
    empty = F.array().cast(f"array<array<{WORD}>>")
    reach = lambda c: F.array_max(F.transform(c, right))
    step = lambda acc, w: F.when((F.size(acc) == 0) | (w["left"] - reach(F.element_at(acc, -1)) > gap), F.array_append(acc, F.array(w))).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array_append(F.element_at(acc, -1), w)))
    )
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(w["left"].alias("l"), w["top"].alias("t"), w.alias("w")))), lambda s: s["w"])
    return F.aggregate(ordered, empty, step)


def cluster_points(raw: Column) -> Column:
    """How much a cluster looks like a document."""
    word = lambda p, n: F.when(raw.rlike(f"(?iu){p}"), n).otherwise(0)
    return word("паспорт", 4) + word("свидетель", 4) + word("справка", 4) + word("выдан", 2) + F.when(raw.rlike("№\\s*\\d{6,10}"), 3).when(raw.rlike("\\d{6}"), 2).otherwise(0) + word(DATE, 1) + word("мвд|уфмс|овд|загс", 1)


def primary_cluster(words: Column) -> Column:
    """The words of the row's own document: left of a second head; else, of its clusters, the leftmost that
    scores at least max(2, best - 1) and lies within 120 pixels of the leftmost best; else all."""

    def chosen(cs: Column) -> Column:
        scored = F.filter(F.transform(cs, lambda c: F.struct(F.array_min(F.transform(c, lambda w: w["left"])).alias("left"), cluster_points(raw_text(c)).alias("points"), c.alias("words"))), lambda s: s["points"] > 0)

        def best(ss: Column) -> Column:
            top = F.array_max(F.transform(ss, lambda s: s["points"]))
            near = F.array_min(F.transform(F.filter(ss, lambda s: s["points"] == top), lambda s: s["left"]))
            fit = F.filter(ss, lambda s: (s["points"] >= F.greatest(F.lit(2), top - 1)) & (s["left"] <= near + 120))
            return F.coalesce(F.array_min(fit)["words"], F.get(F.filter(ss, lambda s: s["points"] == top), F.lit(0))["words"])

        return let(scored, lambda ss: F.when(F.size(ss) > 0, F.array_sort(best(ss))).otherwise(words))

    return let(left_of_second_head(words), lambda l: F.when(l.isNotNull(), l).otherwise(let(clusters(words), lambda cs: F.when(F.size(cs) <= 1, words).otherwise(chosen(cs)))))


def leftmost_cluster(words: Column, jump: int = 160) -> Column:
    """The words left of the first jump between neighbouring left edges; without a jump, the leftmost cluster."""

    def split(lefts: Column) -> Column:
        pairs = F.zip_with(F.slice(lefts, F.lit(1), F.size(lefts) - 1), F.slice(lefts, F.lit(2), F.size(lefts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        first = F.get(F.filter(pairs, lambda p: p["b"] - p["a"] >= jump), F.lit(0))
        return F.when(F.size(lefts) > 1, first["a"] + F.floor((first["b"] - first["a"]) / 2))

    cut = lambda at: F.when(at.isNotNull(), F.array_sort(F.filter(words, lambda w: w["left"] < at))).otherwise(F.array_sort(clusters(words)[0]))
    return F.when(F.size(words) > 0, let(split(F.array_sort(F.array_distinct(F.transform(words, lambda w: w["left"])))), cut)).otherwise(words)


# What a row says ---------------------------------------------------------------------------


def name_cluster(words: Column) -> Column:
    """Words of the name, line by line: no word beyond 860 pixels, 520 right of its line's first word, or 260 right of the words before it."""
    tops = F.array_distinct(anchored_groups(F.array_sort(F.array_distinct(F.transform(words, lambda w: w["top"]))), 18))
    none = F.array().cast(f"array<{WORD}>")
    reach = lambda acc: F.array_max(F.transform(acc, right))
    take = lambda acc, w: F.when((F.size(acc) == 0) | ~((middle(w) > 860) | (w["left"] > acc[0]["left"] + 520) | (w["left"] - reach(acc) > 260)), F.array_append(acc, w)).otherwise(acc)
    by_left = lambda t: F.transform(F.array_sort(F.transform(F.filter(words, lambda w: (w["top"] >= t) & (w["top"] <= t + 18)), lambda w: F.struct(w["left"].alias("l"), w.alias("w")))), lambda s: s["w"])
    return F.flatten(F.transform(tops, lambda t: F.aggregate(by_left(t), none, take)))


def full_name(words: Column) -> Column:
    """The name of a row: Cyrillic words with a capital, parted where they run together, without the form's
    words and places; three at most."""
    tidy = lambda t: name_text(F.regexp_replace(t, f"{DATE}.*$", ""))
    tokens = F.flatten(F.transform(F.array_sort(name_cluster(words)), lambda w: F.regexp_extract_all(tidy(w["text"]), F.lit("([А-ЯЁа-яё-]+)"), F.lit(1))))
    joined = F.split(merge_hyphens(F.array_join(split_tokens(tokens), " ")), " ")
    kept = F.filter(F.transform(joined, lambda t: F.btrim(t, F.lit("-"))), lambda t: (F.length(t) >= 2) & ~t.isin(NAME_STOPS) & t.rlike("^[А-ЯЁ]"))
    return D.blank(F.array_join(F.slice(without_noise(kept), 1, 3), " "))


def tail_of_page_before(name: Column, words: Column) -> Column:
    """Whether a row at the top of a page only ends the row of the page before."""
    t = name_tokens(name)
    return F.coalesce((F.size(words) == 0) | name.isNull() | (F.size(t) < 2) | F.exists(t, lambda w: w.isin(NAME_STOPS)), F.lit(True))


READING = "array<struct<raw:string,wanted:string>>"


def readings(words: Column) -> Column:
    """READING: the texts a cell's document may be read from: its own cluster, all its words where they
    are more, and its cluster as the kind it seems to continue; empty for no words."""

    def of(own: Column) -> Column:
        def kinds(raw: Column) -> Column:
            guess = F.when(D.continues_certificate(raw), D.CERTIFICATE).when(D.continues_reference(raw), D.REFERENCE).when(D.continues_passport(raw), D.PASSPORT)
            none = F.lit(None).cast("string")
            more = F.when(F.size(own) < F.size(words), F.array(F.struct(raw_text(words).alias("raw"), none.alias("wanted")))).otherwise(F.array().cast(READING))
            return F.concat(F.array(F.struct(raw.alias("raw"), none.alias("wanted"))), more, F.array(F.struct(F.concat_ws(" ", guess, raw).alias("raw"), guess.alias("wanted"))))

        return let(raw_text(own), kinds)

    return F.when(F.size(words) > 0, let(primary_cluster(words), of)).otherwise(F.array().cast(READING))


def documents_of(texts: Column) -> Column:
    """The documents of READING texts, those that are none left out."""
    return F.filter(F.transform(texts, lambda t: D.read_cell(t["raw"], t["wanted"])), lambda d: d.isNotNull())


def document_of(words: Column) -> Column:
    """The document in a cell's words (see :func:`readings`; the first that is one)."""
    return F.get(documents_of(readings(words)), F.lit(0))


def strong(document: Column) -> Column:
    return F.coalesce(D.has(document["number"]) & D.has(document["issue_date"]), F.lit(False))


def persons_rows(rows: DataFrame, columns: dict[str, tuple[int, int]] = COLUMNS) -> DataFrame:
    """Rows with ``bounds``, ``_birthday`` and ``_name``, those that lack a birthday or a name left out.

    Most bands of a page are none of the table. The birthday is cheaper than the name and lacks more often, so it is asked for first.
    """
    w, edges = F.col("words"), row_bounds(F.col("words"), F.col("anchor_top"), columns)
    dates = lambda b: F.filter(birth_words(w, b), lambda x: x["text"].rlike(DATE))
    # Bounds are bound once a row: a column would be put in where a lambda uses it, and worked out for every word.
    birthday = let(edges, lambda b: D.blank(F.regexp_extract(raw_text(dates(b)), f"({DATE})", 1)))
    at = rows.withColumn("_birthday", birthday).filter("_birthday IS NOT NULL")
    return at.withColumn("_name", let(edges, lambda b: full_name(name_words(w, b)))).filter("_name IS NOT NULL").withColumn("bounds", edges)


def read_rows(rows: DataFrame, columns: dict[str, tuple[int, int]] = COLUMNS) -> DataFrame:
    """Rows (anchor_top, words and keys) with full_name, birthday_date, document, departure, departure_raw, row_box, document_box.

    A document that lacks number or date is read again from its cluster, a departure that isn't
    found from its own; the more complete reading stays. Rows without a name or birthday are left out.
    """
    keys = [c for c in rows.columns if c != "words"]
    w, b = F.col("words"), F.col("bounds")
    at = persons_rows(rows, columns)
    at = at.withColumn("_d", document_words(w, b)).withColumn("_x", overlapping(w, b["departure_left"], columns["departure"][1]))
    at = at.withColumn("_c", document_cluster(w, b)).withColumn("_y", departure_cluster(w, b))
    # All texts a row's document may be read from go through one expression; so do those of its departure.
    texts = F.concat(F.transform(readings(F.col("_d")), lambda x: F.struct(F.lit(0).alias("from"), x["raw"].alias("raw"), x["wanted"].alias("wanted"))), F.transform(readings(F.col("_c")), lambda x: F.struct(F.lit(1).alias("from"), x["raw"].alias("raw"), x["wanted"].alias("wanted"))))
    at = at.withColumn("_t", texts).withColumn("_r", F.filter(F.transform("_t", lambda x: F.struct(x["from"].alias("from"), D.read_cell(x["raw"], x["wanted"]).alias("d"))), lambda r: r["d"].isNotNull()))
    of = lambda n: F.get(F.filter("_r", lambda r: r["from"] == n), F.lit(0))["d"]
    at = at.withColumn("_d1", of(0)).withColumn("_d2", F.when(~strong(F.col("_d1")), of(1)))
    at = at.withColumn("_p", F.transform(F.array(raw_text(F.col("_x")), raw_text(F.col("_y"))), P.read)).withColumn("_x1", F.col("_p")[0]).withColumn("_x2", F.when(F.col("_x1").isNull(), F.col("_p")[1]))
    second = F.coalesce(D.completeness(F.col("_d2")) > D.completeness(F.col("_d1")), F.lit(False))
    return at.select(
        *keys, F.col("_name").alias("full_name"), F.col("_birthday").alias("birthday_date"), F.when(second, F.col("_d2")).otherwise(F.col("_d1")).alias("document"), F.coalesce("_x1", "_x2").alias("departure"),
        raw_text(F.when(F.col("_x1").isNull() & F.col("_x2").isNotNull(), F.col("_y")).otherwise(F.col("_x"))).alias("departure_raw"), box(w).alias("row_box"), box(F.when(second, F.col("_c")).otherwise(F.col("_d"))).alias("document_box"),
    )


# Reading again -----------------------------------------------------------------------------

# Padding of a crop (sides, top, bottom) by what is cropped.
CROPS = {"document": (80, 24, 24), "document_wide": (180, 40, 50), "departure": (80, 24, 220), "departure_wide": (180, 40, 340), "row_right": (80, 24, 24), "row_right_wide": (180, 40, 50)}


def crop(mode: str, cell: Column, row: Column, width: int, height: int) -> Column:
    """struct<left, top, right, bottom> of the crop ``mode`` of a cell; without a cell, of the right part of its row."""
    pad_x, above, below = CROPS[mode]
    start = lambda c, skip: F.struct((c["left"] + F.floor(c["width"] * skip)).cast("int").alias("l"), c["top"].alias("t"), (c["left"] + c["width"]).alias("r"), (c["top"] + c["height"]).alias("b"))
    own = start(row, 0.45) if mode.startswith("row") else F.when(cell.isNotNull(), start(cell, 0.0)).otherwise(start(row, 0.45))
    return let(own, lambda e: F.struct(F.greatest(F.lit(0), e["l"] - pad_x).alias("left"), F.greatest(F.lit(0), e["t"] - above).alias("top"), F.least(F.lit(width), e["r"] + pad_x).alias("right"), F.least(F.lit(height), e["b"] + below).alias("bottom")))


def read_again(d: Column) -> Column:
    """Whether a document should be read again from a crop: its kind's fields are missing, or its confidence is below 0.8."""
    lacks = lambda *f: functools.reduce(lambda a, b: a | b, [~D.has(d[x]) for x in f])
    missing = F.when(d["document_type"] == D.PASSPORT, lacks("number", "series") | ~D.has(d["issued_by"]) & ~D.has(d["issue_date"])).when(d["document_type"] == D.CERTIFICATE, lacks("number", "issued_by", "issue_date")).when(d["document_type"] == D.REFERENCE, lacks("number", "issued_by")).otherwise(F.lit(False))
    return d.isNotNull() & (missing | (D.confidence(d) < 0.8))


def quality(d: Column) -> Column:
    """Points of a document read anew: confidence and its fields, less for fields of the wrong form and for words of the form in them."""
    by, raw = F.coalesce(d["issued_by"], F.lit("")), F.coalesce(d["raw"], F.lit(""))
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    wrong = lambda f, p, n: plus(D.has(d[f]) & ~d[f].rlike(p) & (d["document_type"] == D.PASSPORT), n)
    spoilt = plus(by.rlike("указывается|Ф\\.И\\.О|имеются|человек в семье|должностного лица"), 1.2) + plus(by.rlike("\\d"), 0.5) + plus(by.rlike("[A-Za-z]"), 0.5) + plus(by.rlike("^[a-zа-яё]") | (F.length(by).between(1, 3)), 0.5)
    total = D.confidence(d) + sum((plus(D.has(d[f]), 0.2) for f in ("number", "issued_by", "issue_date")), F.lit(0.0)) - wrong("series", r"^\d{2}\s\d{2}$", 0.6) - wrong("number", r"^\d{6}$", 0.6) - wrong("issue_date", f"^{DATE}$", 0.5) - F.when(by != "", spoilt).otherwise(0.0) - plus(raw.rlike("указывается|человек в семье|имеются тя"), 1.0)
    return F.when(d.isNull(), 0.0).otherwise(F.round(total, 4))


def replaces(new: Column, old: Column) -> Column:
    """Whether a new reading takes the place of the old: it is better, and neither number nor series (where a number is known) contradict."""
    differ = lambda f: F.coalesce(D.has(new[f]) & D.has(old[f]) & (new[f] != old[f]), F.lit(False))
    return (quality(new) > quality(old)) & ~differ("number") & ~(differ("series") & F.coalesce(D.has(old["number"]), F.lit(False)))
