"""Replaceable adapters: documents to page images, page images to words.

A renderer maps (doc_id, content) rows to page rows, an engine maps page rows to word rows;
both are functions over batches for ``mapInPandas`` (an engine with ``arrow``: for ``mapInArrow``), chosen by name. Adapters whose
libraries or programs are missing say so when they are used, not when they are imported.
Everything is keyed by doc_id and page number, never by a file's name.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id long, page_number int, width int, height int, image_path string, image binary"
WORDS = "doc_id long, page_number int, ord int, text string, confidence double, polygon array<array<double>>"
Batches = Iterator[pd.DataFrame]
Renderer = Callable[[Batches], Batches]
Engine = Callable[[Batches], Batches]


def documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id, path, filename, length, content of the files under a folder, one row a file.
    Files without content are left out, as Spark reads none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def document_stream(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """The same as they arrive; the content is read when a batch needs it."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def numeric_first(name: Column) -> list[Column]:
    """Sort keys: files whose name is a number first, by the number, then the others by name."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return [F.coalesce(F.when(stem.rlike(r"^\d+$"), stem.cast("long")), F.lit(10**9)), stem]


# Renderers ------------------------------------------------------------------------------


def poppler(dpi: int = 300) -> Renderer:
    """PDF pages by the program pdftoppm, each document in a folder of its own that is removed."""

    def run(batches: Batches) -> Batches:
        if shutil.which("pdftoppm") is None:
            raise RuntimeError("pdftoppm is not installed on this executor")
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                with tempfile.TemporaryDirectory() as where:
                    source = Path(where, "in.pdf")
                    source.write_bytes(content)
                    subprocess.run(["pdftoppm", "-png", "-r", str(dpi), str(source), str(Path(where, "p"))], check=True, capture_output=True)
                    for n, page in enumerate(sorted(Path(where).glob("p*.png")), 1):
                        data = page.read_bytes()
                        rows.append((doc, n, int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), None, data))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    return run


def one_page() -> Renderer:
    """One blank page per document (for tests)."""

    def run(batches: Batches) -> Batches:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_number": 1, "width": 2480, "height": 3508, "image_path": None, "image": pdf["content"]})

    return run


RENDERERS: dict[str, Callable[[], Renderer]] = {"poppler": poppler, "one_page": one_page}

# Engines --------------------------------------------------------------------------------


#: Words in a batch an engine hands on: one Arrow batch of pages may hold millions.
BATCH_WORDS = 20_000
_WORDS = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("ord", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("polygon", pa.list_(pa.list_(pa.float64())))])


def _word_batch(docs: list[int], pages: list[int], ords: list[int], texts: list[str], lefts: list[int], lines: list[int]) -> pa.RecordBatch:
    """WORDS of upright boxes, a sign 12 and a line 40 pixels, built by column."""
    n = len(texts)
    left, top = 12.0 * np.array(lefts, float), 40.0 * np.array(lines, float)
    right, below = left + 12.0 * np.fromiter(map(len, texts), float, n), top + 24
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * n + 1, 2, dtype=np.int32)), pa.array(np.stack([left, top, right, top, right, below, left, below], 1).ravel()))
    polygons = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), points)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pages, pa.int32()), pa.array(ords, pa.int32()), pa.array(texts, pa.string()), pa.array(np.full(n, 0.99)), polygons], schema=_WORDS)


def mock() -> Engine:
    """Words of plain text in the image bytes, one box per word; other bytes give none. An engine over
    Arrow batches (``arrow``), which hands on ``BATCH_WORDS`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = docs, pages, ords, texts, lefts, lines = [], [], [], [], [], []
            for doc, page, image in zip(b.column("doc_id").to_pylist(), b.column("page_number").to_pylist(), b.column("image")):
                try:
                    text = image.as_py().decode("utf-8") if image.is_valid else ""
                except UnicodeDecodeError:
                    text = ""
                n = 0
                for y, line in enumerate(text.split("\n")):
                    x = 0
                    for w in line.split(" "):
                        if w:
                            docs.append(doc)
                            pages.append(page)
                            ords.append(n)
                            texts.append(w)
                            lefts.append(x)
                            lines.append(y)
                            n += 1
                        x += len(w) + 1
                    if len(texts) >= BATCH_WORDS:
                        yield _word_batch(*columns)
                        for c in columns:
                            c.clear()
            yield _word_batch(*columns)

    run.arrow = True
    return run


def _external(module: str, read: Callable) -> Callable[[], Engine]:
    def make() -> Engine:
        def run(batches: Batches) -> Batches:
            import importlib

            try:
                library = importlib.import_module(module)
            except ImportError as e:
                raise RuntimeError(f"the engine needs {module}, which this executor lacks") from e
            yield from read(library, batches)

        return run

    return make


def _easy(library, batches: Batches) -> Batches:
    reader = library.Reader(["ru", "en"], gpu=False)
    for pdf in batches:
        rows = []
        for doc, page, image in zip(pdf["doc_id"], pdf["page_number"], pdf["image"]):
            for n, (polygon, text, confidence) in enumerate(reader.readtext(bytes(image))):
                rows.append((doc, page, n, text, float(confidence), [[float(x), float(y)] for x, y in polygon]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])


def _paddle(library, batches: Batches) -> Batches:
    reader = library.PaddleOCR(use_doc_orientation_classify=False, use_doc_unwarping=False, lang="ru")
    for pdf in batches:
        rows = []
        for doc, page, image in zip(pdf["doc_id"], pdf["page_number"], pdf["image"]):
            n = 0
            for found in reader.predict(_pixels(bytes(image))):
                for polygon, text, confidence in zip(found["rec_polys"], found["rec_texts"], found["rec_scores"]):
                    rows.append((doc, page, n, text, float(confidence), [[float(x), float(y)] for x, y in polygon]))
                    n += 1
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])


def _pixels(image: bytes):
    import io

    import numpy as np
    from PIL import Image

    return np.array(Image.open(io.BytesIO(image)).convert("RGB"))


def empty() -> Engine:
    """No words for any page (an engine that is named but not built yet)."""

    def run(batches: Batches) -> Batches:
        for _ in batches:
            yield pd.DataFrame(columns=[c.split()[0] for c in WORDS.split(", ")])

    return run


ENGINES: dict[str, Callable[[], Engine]] = {"mock": mock, "easyocr": _external("easyocr", _easy), "paddleocr": _external("paddleocr", _paddle), "tesseract": empty}

#: Steps between rendering and recognition, by name; each maps pages to pages. They leave a page as it
#: is until one is put in their place.
PREPROCESS: dict[str, Callable[[DataFrame], DataFrame]] = dict.fromkeys(("contrast", "denoise", "deskew", "classify"), lambda pages: pages)


def preprocess(pages: DataFrame, steps: tuple[str, ...] = ("contrast", "classify")) -> DataFrame:
    """Pages after the named steps, in their order."""
    for name in steps:
        if name not in PREPROCESS:
            raise ValueError(f"no step {name!r}; there are {sorted(PREPROCESS)}")
        pages = PREPROCESS[name](pages)
    return pages


def crops(pages: DataFrame, boxes_: DataFrame, cut: Callable[[bytes, tuple[int, int, int, int]], bytes] | None = None) -> DataFrame:
    """Page rows of parts of pages: doc_id, page_number, crop, image. boxes_: doc_id, page_number, crop
    (its number), left, top, right, bottom. cut: image bytes and box to image bytes (an image library by default)."""
    own = cut or _cut

    def run(batches: Batches) -> Batches:
        for pdf in batches:
            made = [own(bytes(i), (a, b, c, d)) for i, a, b, c, d in zip(pdf["image"], pdf["left"], pdf["top"], pdf["right"], pdf["bottom"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_number": pdf["page_number"], "crop": pdf["crop"], "image": made})

    met = boxes_.join(pages.select("doc_id", "page_number", "image"), ["doc_id", "page_number"])
    return met.select("doc_id", "page_number", "crop", "left", "top", "right", "bottom", "image").mapInPandas(run, "doc_id long, page_number int, crop int, image binary")


def _cut(image: bytes, box: tuple[int, int, int, int]) -> bytes:
    import io

    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("cutting images needs PIL, which this executor lacks; give a function of your own") from e
    out = io.BytesIO()
    Image.open(io.BytesIO(image)).crop(box).save(out, "PNG")
    return out.getvalue()


def crop_texts(parts: DataFrame, engine: str) -> DataFrame:
    """doc_id, page_number, crop, text of page parts, read by the engine of that name."""
    numbered = parts.select("doc_id", (F.col("page_number") * 1000 + F.col("crop")).cast("int").alias("page_number"), "image")
    words = recognize(numbered, engine)
    ordered = F.sort_array(F.collect_list(F.struct("top", "left", "ord", "text")))
    texts = words.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text"))
    return texts.select("doc_id", F.expr("page_number div 1000").cast("int").alias("page_number"), (F.col("page_number") % 1000).alias("crop"), "text")


def render(docs: DataFrame, name: str = "poppler") -> DataFrame:
    """Pages of documents (doc_id, content)."""
    if name not in RENDERERS:
        raise ValueError(f"no renderer {name!r}; there are {sorted(RENDERERS)}")
    return docs.select("doc_id", "content").mapInPandas(RENDERERS[name](), PAGES)


def boxes(words: DataFrame) -> DataFrame:
    """Polygons as upright boxes in whole pixels; texts with squeezed blanks, empty ones left out."""
    x, y = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    left, top = F.array_min(x).cast("int"), F.array_min(y).cast("int")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return words.select("doc_id", "page_number", "ord", text.alias("text"), "confidence", left.alias("left"), top.alias("top"), (F.array_max(x).cast("int") - left).alias("width"), (F.array_max(y).cast("int") - top).alias("height")).filter("text <> ''")


def recognize(pages: DataFrame, name: str = "mock") -> DataFrame:
    """A words table of pages by the engine of that name."""
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; there are {sorted(ENGINES)}")
    engine, asked = ENGINES[name](), pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "image")
    return boxes(asked.mapInArrow(engine, WORDS) if getattr(engine, "arrow", False) else asked.mapInPandas(engine, WORDS))


def second_pass(rows: DataFrame, pages: DataFrame, engine: str, needs: Column, key: str, text: str) -> DataFrame:
    """Rows that ``needs`` marks are recognised again and their text replaced if the second
    reading has more words; only these rows meet their pages. rows: doc_id, page_number, key, text."""
    again = rows.filter(needs).select("doc_id", "page_number", key).join(pages.select("doc_id", "page_number", "image"), ["doc_id", "page_number"])
    read = recognize(again.select("doc_id", "page_number", "image").dropDuplicates(["doc_id", "page_number"]), engine)
    parts = F.sort_array(F.collect_list(F.struct("top", "left", "ord", "text")))
    texts = read.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("_again"))
    joined = rows.join(again.select(key).distinct().withColumn("_need", F.lit(True)), key, "left").join(texts, ["doc_id", "page_number"], "left")
    better = F.col("_need") & (F.size(F.split("_again", " ")) > F.size(F.split(F.coalesce(text, F.lit("")), " ")))
    return joined.withColumn("replaced", F.coalesce(better, F.lit(False))).withColumn(text, F.when(F.col("replaced"), F.col("_again")).otherwise(F.col(text))).drop("_need", "_again")
