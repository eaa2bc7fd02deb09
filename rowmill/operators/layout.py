"""Words on pages: reading order, lines, columns, bands, clusters, boxes.

A words table has one row per recognised word: doc_id, page_number, ord (original order),
text, confidence, left, top, width, height. All operators are window or higher-order
expressions partitioned by page, so a plan shuffles once on (doc_id, page_number) and the
operators after it reuse the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]


def words_of_texts(docs: DataFrame, lines_per_page: int = 60) -> DataFrame:
    """A words table from plain texts: one box per word, 12 pixels a character, 40 a line,
    ``lines_per_page`` lines a page. Null texts have no words; blanks make none."""
    lines = docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line"))
    toks = lines.select("doc_id", "li", F.posexplode(F.split("line", " ")).alias("wi", "text"))
    w = Window.partitionBy("doc_id", "li").orderBy("wi")
    n = F.length("text")
    at = F.sum(n + 1).over(w) - n - 1
    return toks.select(
        "doc_id", "li", "wi", "text", (1 + F.expr(f"li div {lines_per_page}")).cast("int").alias("page_number"), (12 * at).cast("int").alias("left"),
        (40 * (F.col("li") % lines_per_page)).cast("int").alias("top"), (12 * n).cast("int").alias("width"), F.lit(24).alias("height"),
    ).filter("text <> ''").withColumn("ord", F.col("li") * 100000 + F.col("wi"))


def reading_order() -> list:
    """The order in which a page is read; the original order decides between equal places."""
    return ["top", "left", "ord"]


def page_text(words: DataFrame) -> DataFrame:
    """doc_id, page_number, page_text: the words in reading order, one per line."""
    parts = F.sort_array(F.collect_list(F.struct("top", "left", "ord", "text")))  # the words of one page
    return words.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("page_text"))


def bounding_boxes(words: DataFrame, *by: str) -> DataFrame:
    """Smallest box around the words of each group, and how many they are."""
    return words.groupBy(*by).agg(
        F.min("left").alias("box_left"), F.min("top").alias("box_top"), F.max(F.col("left") + F.col("width")).alias("box_right"), F.max(F.col("top") + F.col("height")).alias("box_bottom"), F.count("*").alias("n_words")
    )


def anchored_groups(values: Column, tolerance: int) -> Column:
    """For ascending values: the first value of the group each belongs to. A value joins the
    open group while it is within ``tolerance`` of the group's first value (not its last)."""
    start = F.array().cast("array<int>")
    return F.aggregate(values, start, lambda acc, v: F.array_append(acc, F.when((F.size(acc) > 0) & (v - F.element_at(acc, -1) <= tolerance), F.element_at(acc, -1)).otherwise(v)))


def greedy_lines(words: DataFrame, tolerance: int = 18) -> DataFrame:
    """doc_id, page_number, line_top, line_text, n_words: words grouped into lines by the top of
    the first word of a line. The fold runs over the distinct tops of a page, not its words."""
    tops = words.groupBy(*PAGE).agg(F.sort_array(F.collect_set("top")).alias("tops"))
    anchors = tops.select(*PAGE, F.explode(F.arrays_zip(F.col("tops").alias("top"), anchored_groups(F.col("tops"), tolerance).alias("line_top"))).alias("z")).select(*PAGE, "z.top", "z.line_top")
    parts = F.sort_array(F.collect_list(F.struct("left", "top", "ord", "text")))
    return words.join(anchors, [*PAGE, "top"]).groupBy(*PAGE, "line_top").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line_text"), F.count("*").alias("n_words"))


def gap_clusters(words: DataFrame, gap: int = 140, by: tuple[str, ...] = ("doc_id", "page_number", "top")) -> DataFrame:
    """Words with ``cluster``: a word more than ``gap`` right of all words before it opens a new one."""
    w = Window.partitionBy(*by).orderBy("left", "ord")
    right = F.max(F.col("left") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("left") - right > gap, 1).otherwise(0)
    return words.withColumn("_o", opens).withColumn("cluster", F.sum("_o").over(w).cast("int")).drop("_o")


def leftmost_part(words: DataFrame, jump: int = 160, by: tuple[str, ...] = ("doc_id", "page_number", "top")) -> DataFrame:
    """The words of each group left of the first jump between neighbouring left edges."""
    w = Window.partitionBy(*by).orderBy("left", "ord")
    before = F.lag("left").over(w)
    jumps = F.sum(F.when(F.col("left") - before >= jump, 1).otherwise(0)).over(w)
    return words.withColumn("_j", jumps).filter("_j = 0").drop("_j")


def anchors(words: DataFrame, pattern: str, apart: int = 12) -> DataFrame:
    """doc_id, page_number, anchor_top: tops of words that match ``pattern``, none within
    ``apart`` pixels of the anchor before it."""
    tops = words.filter(F.col("text").rlike(pattern)).groupBy(*PAGE).agg(F.sort_array(F.collect_set("top")).alias("tops"))
    return tops.select(*PAGE, F.explode(F.array_distinct(anchored_groups(F.col("tops"), apart))).alias("anchor_top"))


def row_bands(words: DataFrame, anchor_rows: DataFrame, above: int = 18) -> DataFrame:
    """Words with ``anchor_top``: the band of the last anchor at most ``above`` pixels below
    the word's top. An as-of join: words and anchors go through one sort, no pair is formed.
    Words above the first anchor belong to no band and are left out."""
    marks = anchor_rows.select(*PAGE, (F.col("anchor_top") - above).alias("_at"), F.lit(0).alias("_kind"), "anchor_top")
    rest = [c for c in words.columns if c not in PAGE]
    placed = words.select(*PAGE, F.col("top").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("anchor_top"), F.struct(*rest).alias("_w"))
    both = placed.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*PAGE).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("anchor_top", F.last("anchor_top", ignorenulls=True).over(w)).filter("_kind = 1 AND anchor_top IS NOT NULL").select(*PAGE, "anchor_top", "_w.*")


def assign_columns(words: DataFrame, columns: list[tuple[str, int, int]]) -> DataFrame:
    """Words with ``column_name``: the first column whose [left, right) the word's middle lies in."""
    middle = F.col("left") + F.col("width") / 2
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, left, right in columns:
        out = out.when((middle >= left) & (middle < right), F.lit(name))
    return words.withColumn("column_name", out)


def cells(banded: DataFrame) -> DataFrame:
    """doc_id, page_number, anchor_top, column_name, cell_text: words of a band and column in reading order."""
    parts = F.sort_array(F.collect_list(F.struct("top", "left", "ord", "text")))
    return banded.filter("column_name IS NOT NULL").groupBy(*PAGE, "anchor_top", "column_name").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("cell_text"))


def adaptive_column(words: DataFrame, pattern: str, first: int = 6, offset: int = -35, low: int = 420, high: int = 760) -> DataFrame:
    """doc_id, edge: the median left of the first ``first`` words that match, moved by ``offset`` and kept within bounds."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "top", "left", "ord")
    hits = words.filter(F.col("text").rlike(pattern)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    return hits.groupBy("doc_id").agg(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.median("left") + offset)).alias("edge"))


def mean_of_first(words: DataFrame, pattern: str, first: int = 12) -> DataFrame:
    """doc_id, mean_left of the first ``first`` words that match."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "top", "left", "ord")
    hits = words.filter(F.col("text").rlike(pattern)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    return hits.groupBy("doc_id").agg(F.round(F.avg("left"), 4).alias("mean_left"))


def nearest_word(words: DataFrame, pattern: str, top: int) -> DataFrame:
    """doc_id, page_number, word, word_top, word_left: the matching word nearest to height ``top``; ties: the leftmost."""
    best = F.min_by(F.struct("text", "top", "left"), F.struct(F.abs(F.col("top") - top), "left", "top", "ord"))
    return words.filter(F.col("text").rlike(pattern)).groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, F.col("b.text").alias("word"), F.col("b.top").alias("word_top"), F.col("b.left").alias("word_left"))


def crop_bounds(boxes: DataFrame, pad_x: int, pad_top: int, pad_bottom: int, width: int, height: int) -> DataFrame:
    """Boxes with padding, kept inside the page and at least one pixel wide and high."""
    left = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("box_left") - pad_x))
    top = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("box_top") - pad_top))
    return boxes.withColumn("crop_left", left).withColumn("crop_top", top).withColumn("crop_right", F.greatest(F.col("crop_left") + 1, F.least(F.lit(width), F.col("box_right") + pad_x))).withColumn(
        "crop_bottom", F.greatest(F.col("crop_top") + 1, F.least(F.lit(height), F.col("box_bottom") + pad_bottom))
    )


def cluster_choice(clusters: DataFrame, score: Column, within: int = 120) -> DataFrame:
    """Of scored clusters (doc_id, page_number, top, cluster, box_left) the leftmost that scores at
    least max(2, best - 1) and lies within ``within`` pixels of the leftmost best one."""
    w = Window.partitionBy(*PAGE, "top")
    scored = clusters.withColumn("score", score)
    scored = scored.withColumn("best", F.max("score").over(w))
    scored = scored.withColumn("at", F.min(F.when(F.col("score") == F.col("best"), F.col("box_left"))).over(w))
    fit = scored.filter((F.col("score") >= F.greatest(F.lit(2), F.col("best") - 1)) & (F.col("box_left") <= F.col("at") + within))
    return fit.groupBy(*PAGE, "top").agg(F.min_by("cluster", "box_left").alias("cluster"), F.max("best").alias("best_score"))


def layout_variant(pages: DataFrame, by: list[str], signals: dict[str, str]) -> DataFrame:
    """``by``, variant_signals, confidence of documents by their pages (``by``, page_number, text): which signals
    any page has (patterns on small letters), and whether there is a third page; 0.35 + 0.2 for each, at most 1."""
    low = F.translate(F.lower(F.coalesce("text", F.lit(""))), "ё", "е")
    any_ = pages.groupBy(*by).agg(*[F.max(low.rlike(p)).alias(n) for n, p in signals.items()], (F.max("page_number") >= 3).alias("continuation_page"))
    found = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in (*signals, "continuation_page")]))
    return any_.select(*by, found.alias("s")).select(*by, F.array_join("s", ",").alias("variant_signals"), F.round(F.least(F.lit(1.0), 0.35 + 0.2 * F.size("s")), 4).alias("confidence"))
