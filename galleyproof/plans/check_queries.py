"""Queries that run all checks on pairs whose differences are planted, so that SQL can name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.operators import checks
from galleyproof.plans.registry import query, read
from galleyproof.plans.source_queries import _W, _packed, _pdf_glyphs
from galleyproof.sources import docx, pdf, rtf

_SOURCE, _TARGET = ("concat('alpha beta caf\u00e9 gamma ', text, ' omega')", "concat('alpha zebra cafe\u0301 gamma ', text)")
_TEXTS = "select item_id, 'Changed Text' as category, 'beta' as expected, 'zebra' as actual from benchmark union all select item_id, 'Missing Text', 'omega', '' from benchmark"
_NAMES = "select item_id, 'Filename Mismatch', concat('item', cast(item_id as varchar)), concat('page', cast(item_id as varchar)) from benchmark where item_id % 2 = 0"
_PAGE = "select item_id, 'Unclosed Tag', '</i>', 'missing closing tag' from benchmark union all select item_id, 'Broken Link', null, concat('gone', cast(item_id as varchar), '.html') from benchmark"
_TITLE = "select item_id, 'Title Mismatch', 'Right title', 'Wrong' from benchmark where item_id % 3 = 0"


def _items(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("pair_id"), "text", F.expr(_SOURCE).alias("source"), F.expr(_TARGET).alias("target"))


def _pairs(items: DataFrame, source: str, target: str) -> DataFrame:
    name = F.expr("concat('out/', if(pair_id % 2 = 0, 'page', 'item'), pair_id, '.html')")
    return items.select("pair_id", F.lit(source).alias("source_kind"), F.lit(target).alias("target_kind"), F.concat(F.lit("in/item"), "pair_id", F.lit(f".{source}")).alias("source_path"), name.alias("target_path"))


def _html(text: Column) -> Column:
    title = F.expr("if(pair_id % 3 = 0, 'Wrong', 'Right title')")
    shown = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<html lang='en'><head><title>"), title, F.lit("</title></head><body>\n<p>"), shown, F.lit("</p><a href='gone"), "pair_id", F.lit(".html'></a><a href='./there"), "pair_id", F.lit(".html'></a></body></html>\n<i>"))


def _listing(items: DataFrame) -> DataFrame:
    return items.select("pair_id", F.concat(F.lit("there"), "pair_id", F.lit(".html")).alias("path"))


def _rich_files(items: DataFrame) -> DataFrame:
    plain = F.replace(F.regexp_replace("source", r"[\\{}]", r"\\$0"), F.lit("\n"), F.lit("\\par\n"))
    coded = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.ascii(c), F.lit("?")))), "")
    return items.select(F.col("pair_id").alias("doc_id"), F.lit("a.rtf").alias("path"), F.concat(F.lit(r"{\rtf1\ansi\ansicpg1252 "), coded, F.lit("}")).alias("raw"))


def _rich_inputs(items: DataFrame) -> dict[str, DataFrame]:
    files = _rich_files(items)
    text = rtf.lines(files).groupBy(F.col("doc_id").alias("pair_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return {"source_texts": text, "source_tokens": checks.rtf_tokens(rtf.tokens(files))}


def _rows(inputs: checks.Inputs) -> DataFrame:
    return checks.run_checks(inputs).select(F.col("pair_id").alias("item_id"), "category", "expected", "actual")


@query("run_checks_rtf", f"{_TEXTS} union all {_NAMES} union all {_PAGE}")
def run_checks_rtf(spark, sf):
    """Rich text against HTML; the target's accents are decomposed."""
    items = _items(spark, sf)
    return _rows(checks.Inputs(_pairs(items, "rtf", "html"), **_rich_inputs(items), pages=items.select("pair_id", _html(F.col("target")).alias("html")), existing=_listing(items)))


@query("run_checks_pdf", f"{_TEXTS} union all {_NAMES} union all {_PAGE} union all {_TITLE}")
def run_checks_pdf(spark, sf):
    """Pages of glyphs against HTML, with titles."""
    items = _items(spark, sf)
    lines = items.select(F.col("pair_id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"), F.col("source").alias("text"))
    texts = pdf.text(lines).withColumnRenamed("doc_id", "pair_id")
    tokens = checks.pdf_tokens(pdf.tokens(_pdf_glyphs(lines), lines))
    titles = items.select("pair_id", F.lit("Right title").alias("title"))
    return _rows(checks.Inputs(_pairs(items, "pdf", "html"), texts, tokens, items.select("pair_id", _html(F.col("target")).alias("html")), titles, existing=_listing(items)))


def _word_file(key: int, text: str) -> dict[str, str]:
    from xml.sax.saxutils import escape

    return {"word/document.xml": f'<w:document {_W}><w:body><w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p></w:body></w:document>'}


@query("run_checks_word", f"{_TEXTS} union all {_NAMES}")
def run_checks_word(spark, sf):
    """Rich text against word files, which get no checks of tags, titles and links."""
    items = _items(spark, sf)
    files = _packed(items.select("pair_id", "target"), "page_id", _word_file)
    pages = docx.pages(files).withColumnRenamed("page_id", "pair_id")
    return _rows(checks.Inputs(_pairs(items, "rtf", "word"), **_rich_inputs(items), pages=pages, existing=_listing(items)))


@query("rule_links_listed", "select page_id, href from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages) where not regexp_matches(href, '^(http|mailto:|#|javascript:)') and not (length(href) % 2 = 0)")
def rule_links_listed(spark, sf):
    """Broken links where every other target is there, by the length of its name."""
    from galleyproof.operators import dom

    tree = dom.nodes(read(spark, sf, "pages").select("page_id", "html"))
    listed = tree.where("tag = 'a'").select("page_id", F.col("attrs")["href"].alias("path")).where("length(path) % 2 = 0").distinct()
    return dom.broken_links_of(tree, listed).select("page_id", F.col("actual").alias("href"))
