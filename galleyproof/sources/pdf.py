"""Text of paged documents from tables of glyphs and lines, which a decoder of the binary format provides.

* glyphs: doc_id, page, idx (order in the content stream), text, x0, x1, top, bottom, size, fontname
* lines: doc_id, page, top, bottom, text
* placements (of pictures): doc_id, page, idx, x0, x1, y0, y1, page_width, page_height

All steps are windows and aggregates by document and page, after one shuffle by these; a
page bounds every group. Glyphs without a size count as size 10. Combining marks are the
characters of category Mn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyproof.functions import text as tx

#: Gaps that part words, headings by size, bold fonts, the corner where logos are.
LEAST_GAP, GAP_BY_SIZE, CLOSE_GAP, DEFAULT_SIZE, BOX_SLACK = 1.5, 0.28, 0.3, 10.0, 2
HEADINGS = ((1.55, 1), (1.30, 2), (1.15, 3))
BOLD_FONT = "bold|black|heavy"
HYPHEN = r"^[-\x{2010}\x{2011}]$"
LOGO = {"left": 0.22, "top": 0.14, "width": 0.45, "height": 0.15}

_PAGE = ("doc_id", "page")
_LINE = (*_PAGE, "line")


def _is_mark(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{Mn}"), F.lit(False))


def usable_glyphs(glyphs: DataFrame, lines: DataFrame) -> DataFrame:
    """Glyphs that are not in a line of stock text, such as a footer."""
    stock = lines.where(tx.is_boilerplate_line(tx.rtl_fix_line(F.col("text")))).select(*_PAGE, F.col("top").alias("box_top"), F.col("bottom").alias("box_bottom"))
    inside = (F.col("top") >= F.col("box_top") - BOX_SLACK) & (F.col("bottom") <= F.col("box_bottom") + BOX_SLACK)
    g, b = glyphs.alias("g"), stock.alias("b")
    return g.join(b, (F.col("g.doc_id") == F.col("b.doc_id")) & (F.col("g.page") == F.col("b.page")) & inside, "left_anti")


def text_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs with their ``line``: the rounded top; marks go to the line nearest to them."""
    key = F.bround(F.col("top").cast("double"), 0)
    lines = F.collect_set(F.when(~_is_mark(F.col("text")), key)).over(Window.partitionBy(*_PAGE))
    near = F.array_min(F.transform(lines, lambda k: F.struct(F.abs(k - F.col("top")).alias("d"), k.alias("k"))))["k"]
    return glyphs.withColumn("line", F.when(_is_mark(F.col("text")), F.coalesce(near, key)).otherwise(key))


def reading_order(glyphs: DataFrame) -> DataFrame:
    """Glyphs of ``text_lines`` with ``rtl`` and ``at``, their place in the line.

    Lines read by x. In right-to-left lines a mark stands just left of the glyph that
    follows it in the stream, and characters of other scripts keep their stream order.
    """
    stream, whole = Window.partitionBy(*_LINE).orderBy("idx"), Window.partitionBy(*_LINE)
    arabic, letters = (F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p))).over(whole) for p in (tx.RTL_SCRIPT, tx.LETTER))
    own = F.when(F.col("rtl") & _is_mark(F.col("text")), F.lead("x0").over(stream) - 0.01)
    placed = glyphs.withColumn("rtl", tx.is_mostly_rtl(arabic, letters)).withColumn("x", F.coalesce(own, F.col("x0"), F.lit(0.0)))
    across = Window.partitionBy(*_LINE).orderBy(F.when(F.col("rtl"), -F.col("x")).otherwise(F.col("x")), "idx")
    foreign = ~F.coalesce(tx.is_rtl_word(F.col("text")), F.lit(False))
    ranked = placed.withColumn("across", F.row_number().over(across)).withColumn("foreign", F.col("rtl") & foreign)
    run = F.sum(F.when(F.col("rtl") & ~F.col("foreign"), 1).otherwise(0)).over(across)
    ranked = ranked.withColumn("run", F.when(F.col("rtl"), run).otherwise(F.col("across")))
    order = Window.partitionBy(*_LINE).orderBy("run", "foreign", F.when(F.col("foreign"), F.col("idx")).otherwise(0), "across")
    return ranked.withColumn("at", F.row_number().over(order)).drop("x", "across", "foreign", "run")


def words(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line, word, text, size, fontname) of usable ``glyphs``.

    A space or a wide gap ends a word. Of words that are much closer than the page's
    median gap, those are one that spaces or hyphens have parted by mistake.
    """
    g = reading_order(text_lines(glyphs))
    size = F.coalesce(F.nullif(F.col("size").cast("double"), F.lit(0.0)), F.lit(DEFAULT_SIZE))
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    g = g.withColumn("size", size).withColumn("blank", blank).withColumn("mark", _is_mark(F.col("text")))
    line = Window.partitionBy(*_LINE).orderBy("at")
    g = g.withColumn("stretch", F.sum(F.col("blank").cast("int")).over(line)).where(~F.col("blank"))
    g = g.withColumn("edge", F.when(~F.col("mark"), F.when(F.col("rtl"), F.col("x0")).otherwise(F.col("x1"))))
    stretch = Window.partitionBy(*_LINE, "stretch").orderBy("at")
    before = F.last("edge", ignorenulls=True).over(stretch.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(~F.col("mark"), F.when(F.col("rtl"), before - F.col("x1")).otherwise(F.col("x0") - before))
    wide = F.coalesce(gap > F.greatest(F.lit(LEAST_GAP), F.col("size") * GAP_BY_SIZE), F.lit(False))
    g = g.withColumn("starts", (wide | (F.row_number().over(stretch) == 1)).cast("int")).withColumn("word", F.sum("starts").over(line))
    w = g.groupBy(*_LINE, "word").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("text"),
        F.max_by("size", "at").alias("size"),
        F.max_by("fontname", "at").alias("fontname"),
        F.min_by(F.when(F.col("rtl"), F.col("x1")).otherwise(F.col("x0")), "at").alias("start"),
        F.max_by("edge", F.when(F.col("edge").isNotNull(), F.col("at"))).alias("end"),
    )
    by_word = Window.partitionBy(*_LINE).orderBy("word")
    w = w.withColumn("gap", F.abs(F.col("start") - F.lag("end").over(by_word))).withColumn("last", F.lag("text").over(by_word))
    long = (F.length("text") > 1) & (F.length("last") > 1)
    gaps = F.sort_array(F.collect_list(F.when(long, F.col("gap"))).over(Window.partitionBy(*_PAGE)))
    w = w.withColumn("median", F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")))
    odd = tx.is_rtl_word(F.col("text")) | F.col("text").rlike(HYPHEN) | F.substring("last", -1, 1).rlike(HYPHEN)
    parted = F.coalesce((F.col("median") != 0) & (F.col("gap") < F.col("median") * CLOSE_GAP) & odd, F.lit(False))
    w = w.withColumn("whole", F.sum((~parted).cast("int")).over(by_word))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda p: p["text"]), "")
    return w.groupBy(*_LINE, F.col("whole").alias("word")).agg(joined.alias("text"), F.min_by("size", "word").alias("size"), F.min_by("fontname", "word").alias("fontname"))


def tokens(glyphs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, word, position, text, norm, bold, heading_level): tokens for alignment, in reading order by these columns.

    Headings stand out by size against the page's most common (rounded) size, of equally common ones the smallest.
    """
    used = usable_glyphs(glyphs, lines)
    sizes = used.where("size is not null").groupBy(*_PAGE, F.bround(F.col("size").cast("double"), 0).alias("body")).agg(F.count("*").alias("n"))
    body = sizes.groupBy(*_PAGE).agg(F.min(F.struct(-F.col("n"), "body")).alias("m")).select(*_PAGE, F.col("m.body").alias("body"))
    w = words(used).join(body, list(_PAGE), "left").withColumn("body", F.coalesce("body", F.lit(DEFAULT_SIZE)))
    level = F.when(F.lit(False), 0)
    for ratio, k in HEADINGS:
        level = level.when(F.col("size") >= F.col("body") * ratio, k)
    bold = F.lower(F.coalesce("fontname", F.lit(""))).rlike(BOLD_FONT)
    each = w.select(*_LINE, "word", F.posexplode(tx.tokens(tx.strip_boilerplate(F.col("text")))).alias("position", "text"), bold.alias("bold"), level.otherwise(0).alias("heading_level"))
    return each.withColumn("norm", tx.norm_compare(F.col("text")))


def text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines without stock phrases, in page order; documents without any have no row."""
    bare = tx.strip_boilerplate(F.col("text"))
    kept = lines.select("doc_id", F.struct("page", "top", tx.rtl_fix_line(bare).alias("t")).alias("piece"), bare.alias("bare")).where("bare <> ''")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["t"]), "\n").alias("text"))


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title): the first line that is not only stock text."""
    kept = lines.withColumn("bare", tx.strip_boilerplate(F.col("text"))).where("bare <> ''")
    return kept.groupBy("doc_id").agg(F.min_by("bare", F.struct("page", "top")).alias("title"))


def content_placements(placements: DataFrame) -> DataFrame:
    """Pictures outside the corner of the page where logos are, with their ``width`` and ``height``."""
    p = placements.withColumn("width", F.col("x1") - F.col("x0")).withColumn("height", F.col("y1") - F.col("y0"))
    corner = (F.col("x0") <= F.col("page_width") * LOGO["left"]) & (F.col("page_height") - F.col("y1") <= F.col("page_height") * LOGO["top"])
    small = (F.col("width") <= F.col("page_width") * LOGO["width"]) & (F.col("height") <= F.col("page_height") * LOGO["height"])
    return p.where(~F.coalesce(corner & small, F.lit(False)))
