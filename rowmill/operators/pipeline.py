"""Documents from their pages to the published record: pages are recognised, page 1 and the
residents' table read, persons reconciled, and all of it put into one record a document, with
warnings and a trace. One shuffle by document for the pages, one for the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.text import NAME_STOPS, let, name_confidence, ws
from rowmill.operators import departures as P
from rowmill.operators import housing as H
from rowmill.operators import identity as D
from rowmill.operators import layout as L
from rowmill.operators import persons as N
from rowmill.operators import reconcile as R
from rowmill.operators import rows as W
from rowmill.operators.lines import clean_lines
from rowmill.operators.page1 import block
from rowmill.sources import ports

# What stands before and behind the people who stay for a time, and what a form says of support.
TEMPORARY = ("Кроме того, на данной площади зарегистрированы по месту пребывания", "другой жилой площади не имеют/имеют")
SUPPORT = "наличие мер социальной поддержки"
_START = r"([А-ЯЁ][а-яё-]+)\s+([А-ЯЁ][а-яё-]+)\s+(\d{2}\.\d{2}\.\d{4})"
_FATHER = r"(?iu)\d{2}\.\d{2}\.\d{4}.*?(?<![\wа-яё])([А-ЯЁ][а-яё-]*(?:ич|ична|овна|евна|кызы))(?![\wа-яё])"
#: Steps over records that leave them as they are until others are put in their place.
NORMALIZERS = dict.fromkeys(("dates", "addresses", "money", "persons"), lambda records: records)
REQUIRED = ("document_type", "page_1")


def page_texts(words: DataFrame, by: list[str]) -> DataFrame:
    """``by``, page_number, text: the lines of each page."""
    lines = L.greedy_lines(words, 18)
    parts = F.sort_array(F.collect_list(F.struct("line_top", "line_text")))
    return lines.groupBy(*by, "page_number").agg(F.array_join(F.transform(parts, lambda p: p["line_text"]), "\n").alias("text"))


def benefits(text: Column) -> Column:
    """What a form says about subsidies: its word, "no" where only the headings of that block stand; null if nothing does."""
    low = F.translate(F.lower(text), "ё", "е")
    word = F.lower(F.regexp_extract(text, r"(?iu)Субсидия\s*:?\s*(нет|имеется|есть)", 1))
    return F.when(word != "", word).when(low.contains(SUPPORT) & low.contains("кроме того") | low.contains(TEMPORARY[0].lower()), "нет")


def continues_table(text: Column) -> Column:
    """Whether a page has the header of the residents' table."""
    low = F.translate(F.lower(text), "ё", "е")
    return low.contains("фамилия") & low.rlike("паспорт|дата ро|отчество")


def between(text: Column, start: str, end: str) -> Column:
    """The text between two marks (any case); to its end without the second, nothing without the first."""
    after = F.regexp_extract(text, f"(?isu)\\Q{start}\\E(.*)$", 1)
    return F.trim(F.regexp_replace(after, f"(?isu)\\Q{end}\\E.*$", ""))


def chunk_people(text: Column) -> Column:
    """array<struct<full_name, birthday_date, document>> of running text: surname, first name and birthday begin a person,
    the patronymic and the document stand behind."""
    flat = ws(text)
    chunks = F.filter(F.split(F.regexp_replace(flat, f"(?={_START})", "\u0001"), "\u0001"), lambda c: c.rlike(f"^{_START}"))
    name = lambda c: ws(F.concat_ws(" ", F.regexp_extract(c, _START, 1), F.regexp_extract(c, _START, 2), F.regexp_extract(c, _FATHER, 1)))
    return F.transform(chunks, lambda c: F.struct(name(c).alias("full_name"), F.regexp_extract(c, _START, 3).alias("birthday_date"), F.regexp_extract(c, f"^{_START}(.*)$", 4).alias("rest")))


def temporary_people(text: Column) -> Column:
    return chunk_people(between(text, *TEMPORARY))


def page1_record(text: Column) -> Column:
    """struct of page 1's fields, from its text."""
    kind = D.blank(ws(F.regexp_extract(text, r"Вид заселения:[ \t]*([^\n]+)", 1)))

    def fields(lines: Column, kind: Column, who: Column) -> Column:
        return F.struct(
            D.blank(F.regexp_extract(text, r"по состоянию на (\d{2}\.\d{2}\.\d{4})", 1)).alias("document_date"), kind.alias("settlement_type"), who.alias("applicant"), let(block(lines, "address"), H.address).alias("property_address"),
            let(block(lines, "company"), H.company).alias("management_company"), let(block(lines, "owners"), lambda b: H.owners(b, kind, who)).alias("owners"), let(block(lines, "owners"), lambda b: H.tenant(b, kind)).alias("primary_tenant"),
            let(F.filter(lines, lambda x: x.rlike("(?iu)паспорт")), lambda p: D.read_cell(D.blank(F.array_join(H.passport_lines(p), " ")))).alias("passport"),
        )

    return let(clean_lines(text), lambda lines: let(kind, lambda k: let(H.applicant(lines), lambda who: fields(lines, k, who))))


def table_rows(words: DataFrame) -> DataFrame:
    """Rows of the residents' tables of all pages after the first, above the table's end."""
    w = words.filter("page_number > 1")
    ends = W.table_end(w, L.PAGE)
    inside = w.join(ends, L.PAGE, "left").filter("end_top IS NULL OR top < end_top - 20").drop("end_top")
    left, right = W.COLUMNS["birth_date"]
    dated = inside.filter((F.col("left") + F.col("width") / 2 >= 0) & (F.col("left") + F.col("width") / 2 < right))
    return W.read_rows(W.row_words(L.row_bands(inside, L.anchors(dated, W.DATE)), [*L.PAGE, "anchor_top"]))


def parse(pages: DataFrame, engine: str = "mock", steps: tuple[str, ...] = ("contrast", "classify")) -> DataFrame:
    """One record a document: doc_id, pages, document_type, page_1, page_2, warnings, metadata.

    pages: doc_id, page_number, image (and image_path). Documents without words have a record with
    null fields. Pages are recognised once; page 1 and the table are read from the same words.
    """
    from rowmill.session import written

    own = ports.preprocess(pages, steps)
    words = written(ports.recognize(own, engine), "words")
    texts = page_texts(words, ["doc_id"])
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list(F.struct("page_number", "image_path"))).alias("_images"))
    one = texts.filter("page_number = 1").select("doc_id", page1_record(F.col("text")).alias("page_1"))
    one = written(one, "page1")
    parts = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    whole = texts.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("_text"), F.map_from_entries(F.transform(parts, lambda p: F.struct(F.concat(F.lit("page_"), p["page_number"].cast("string")), p["text"]))).alias("ocr_preview"))
    found = written(table_rows(words), "rows")  # read by the record, its trace and the reconciliation
    people = found.withColumn("key", F.xxhash64("doc_id", "page_number", "anchor_top")).withColumn("unregistered", N.registration_status(F.col("departure_raw")) == "without_registration")
    none = F.array().cast("array<string>")
    candidates = F.array_compact(F.concat(F.coalesce(F.transform("page_1.owners", lambda o: o["full_name"]), none), F.array("page_1.primary_tenant")))
    subject = F.coalesce("page_1.applicant", "page_1.primary_tenant", F.when(F.size("page_1.owners") == 1, F.col("page_1.owners")[0]["full_name"]))
    known = one.select("doc_id", candidates.alias("candidates"), subject.alias("subject"), F.col("page_1.passport").alias("page1_document"))
    published = R.reconcile(people.select("doc_id", "key", "full_name", "birthday_date", "document", "unregistered"), known, ["doc_id"]).join(people.select("key", "departure", "page_number", "anchor_top"), "key")
    person = F.struct("page_number", "anchor_top", F.struct("full_name", "birthday_date", F.col("document").alias("passport"), "departure").alias("p"))
    block_ = published.groupBy("doc_id").agg(F.sort_array(F.collect_list(person)).alias("ps"))
    out = people.filter("unregistered").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "anchor_top", "full_name", "birthday_date", F.col("departure_raw").alias("raw")))).alias("_out"))
    persons = F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast(f"array<struct<full_name:string,birthday_date:string,passport:{D.DOCUMENT},departure:{P.DEPARTURE}>>"))
    record = counted.join(one, "doc_id", "left").join(whole, "doc_id", "left").join(block_, "doc_id", "left").join(out, "doc_id", "left")
    page2 = F.struct(F.struct(F.size(persons).alias("count"), persons.alias("persons")).alias("registered_persons_constantly"), temporary_people(F.col("_text")).alias("temporary"), benefits(F.col("_text")).alias("benefits"))
    trace = F.struct(F.transform(persons, lambda p: F.struct(p["full_name"].alias("full_name"), name_confidence(p["full_name"]).alias("full_name_confidence"), F.coalesce(D.confidence(p["passport"]), F.lit(0.0)).alias("passport_confidence"))).alias("persons"), F.col("_out").alias("without_registration_persons"))
    record = record.withColumn("document_type", F.lit("housing_form")).withColumn("page_2", page2).withColumn("_trace", trace)
    return record.select(
        "doc_id", "pages", "document_type", "page_1", "page_2", warnings_of(REQUIRED).alias("warnings"),
        F.struct(F.lit(engine).alias("ocr_engine"), F.transform("_images", lambda i: i["image_path"]).alias("page_images"), "ocr_preview", F.col("_trace").alias("extraction_trace")).alias("metadata"),
    )


def warnings_of(required: tuple[str, ...]) -> Column:
    """array<string>: which of the required fields are missing."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]))


def inspect(files: DataFrame) -> DataFrame:
    """What is known of files without reading them: filename, page_count 0, and a warning that says so."""
    return files.select("filename", F.lit(0).alias("page_count"), F.array(F.lit("inspection is not implemented")).alias("warnings"))


def identity_or_none(d: Column) -> Column:
    """A document for the unified format: null unless it has series, number or issuer; without its text."""
    keep = F.struct(*[d[f].alias(f) for f in D.FIELDS[:-1]])
    return F.when(D.has(d["series"]) | D.has(d["number"]) | D.has(d["issued_by"]), keep)


def departure_or_none(d: Column) -> Column:
    return F.when(D.has(d["status"]), F.struct(*[d[f].alias(f) for f in ("status", "reason", "death_date", "departure_date")]))


def callbacks(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """job_id, callback_url, status, filename, error of the message each finished job's receiver gets: the first
    completed file that has data (in the order of the files) makes it completed; else it failed, with the job's
    error, the first error of a file, or none read. Jobs without an address or not yet finished have no message.

    jobs: job_id, status, callback_url, error; files: job_id, file_index, filename, status, extracted_data_json, error.
    """
    good = F.when((F.col("status") == "completed") & D.has(F.col("extracted_data_json")), F.struct("file_index", "filename"))
    bad = F.when(D.has(F.col("error")), F.struct("file_index", "error"))
    own = files.groupBy("job_id").agg(F.min(good).alias("g"), F.min(bad).alias("b"))
    done = jobs.filter(D.has(F.col("callback_url")) & F.col("status").isin("completed", "completed_with_errors", "failed")).join(own, "job_id", "left")
    ok = F.col("status").isin("completed", "completed_with_errors") & F.col("g").isNotNull()
    error = F.coalesce(D.blank(F.col("error")), F.col("b.error"), F.lit("No data extracted"))
    return done.select("job_id", "callback_url", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(ok, F.col("g.filename")).alias("filename"), F.when(~ok, error).alias("error"))


def left_name_tokens(words: Column, birthday: Column) -> Column:
    """The words of a name left of a row's birthday: Cyrillic, with a capital, no places; in reading order."""
    from rowmill.functions.text import merge_hyphens, name_words

    left = F.filter(words, lambda w: (w["left"] < F.greatest(F.lit(0), birthday["left"] - 20)) & ~w["text"].rlike(W.DATE) & (w["left"] < 650))
    tokens = F.flatten(F.transform(F.array_sort(left), lambda w: F.regexp_extract_all(name_words(w["text"]), F.lit("([А-ЯЁа-яё-]+)"), F.lit(1))))
    merged = F.split(merge_hyphens(F.array_join(tokens, " ")), " ")
    return F.filter(merged, lambda t: t.rlike("^[А-ЯЁ]") & ~t.isin(NAME_STOPS) & (F.length(F.btrim(t, F.lit("-"))) >= 2))
