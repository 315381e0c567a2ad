"""Rules on trees of pages and on names: metadata of right-to-left pages, titles, and the opt-in rules of house style.

Each rule returns issues (page_id, line, category, engine_severity, expected, actual).
Issues of one page that agree in category, line, markup, expected and actual are one.
Null attributes and empty elements never raise an error; pages without the element in
question have no issue, except where its absence is the issue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.operators import dom

#: Languages written from right to left with their codes, titles that say nothing, the house style of lists.
RTL_CODES = {"Urdu": "ur", "Arabic": "ar"}
EMPTY_TITLES = ("", "-", "—", "_", "untitled", "document", "title")
BULLET = "•"
LIST_STYLE = {"padding-left": "23pt", "text-indent": "-10pt", "line-height": "110%", "text-align": "left"}
_RTL_CSS = r"(?i)direction\s*:\s*rtl"
_KEYS = ("page_id", "line", "category", "engine_severity", "expected", "actual")


def _attribute(*names: str) -> Column:
    """The first of these attributes that is not empty."""
    return F.coalesce(*(F.nullif(F.element_at("attrs", n), F.lit("")) for n in names), F.lit(""))


def _clean(c: Column) -> Column:
    return tx.collapse(F.coalesce(c, F.lit("")))


def _style(name: str) -> Column:
    return F.element_at(tx.inline_style(_attribute("style")), name)


def _within(tag: str) -> Column:
    return F.exists("path", lambda p: p["tag"] == tag)


def _issues(rows: DataFrame, category: str, expected: Column, actual: Column, severity: str = "error") -> DataFrame:
    out = rows.select("page_id", "line", F.lit(category).alias("category"), F.lit(severity).alias("engine_severity"), expected.alias("expected"), actual.alias("actual"), "markup")
    return out.dropDuplicates().select(*_KEYS)


# ---- metadata


def rtl_metadata(tree: DataFrame, languages: DataFrame) -> DataFrame:
    """Language, direction and title of pages whose ``languages`` (page_id, language) are written from right to left."""
    codes = F.create_map(*(F.lit(x) for pair in RTL_CODES.items() for x in pair))
    wanted = languages.where(F.col("language").isin(*RTL_CODES)).select("page_id", "language", codes[F.col("language")].alias("code"))
    element = F.col("kind") == "element"
    first = lambda tag, value: F.min_by(F.when(element & (F.col("tag") == tag), value), F.when(element & (F.col("tag") == tag), F.col("node_id")))
    lang, direction = F.lower(_clean(_attribute("lang", "xml:lang", "data-lang"))), _clean(_attribute("dir"))
    in_style = (F.col("kind") == "text") & _within("style") & F.col("text").rlike(_RTL_CSS)
    facts = tree.groupBy("page_id").agg(
        first("html", lang).alias("html_lang"),
        first("body", lang).alias("body_lang"),
        first("html", F.col("line")).alias("html_line"),
        first("html", direction).alias("html_dir"),
        first("body", direction).alias("body_dir"),
        F.bool_or((element & ((F.lower(direction) == "rtl") | _attribute("style").rlike(_RTL_CSS))) | in_style).alias("rtl"),
    )
    shown = dom.elements(tree, "title", "h1", "h2", "h3")
    pick = lambda c, where: F.min_by(F.when(where, F.col(c)), F.when(where, F.col("node_id")))
    title, heading = F.col("tag") == "title", F.col("tag") != "title"
    names = shown.groupBy("page_id").agg(pick("text", title).alias("title"), pick("line", title).alias("title_line"), pick("text", heading).alias("heading"))
    p = wanted.join(facts, "page_id", "left").join(names, "page_id", "left").withColumn("markup", F.lit(""))
    p = p.withColumn("lang", F.coalesce(F.nullif("html_lang", F.lit("")), F.nullif("body_lang", F.lit("")), F.lit("")))
    quoted = lambda before, c, after='"': F.concat(F.lit(before), F.coalesce(c, F.lit("")), F.lit(after))
    some_dir = (F.coalesce("html_dir", F.lit("")) != "") | (F.coalesce("body_dir", F.lit("")) != "")
    by_html = p.withColumn("line", F.col("html_line"))
    no_lang = _issues(by_html.where(F.substring_index("lang", "-", 1) != F.col("code")), "Missing Language Attribute", quoted('<html lang="', F.col("code"), '">'), F.when(F.col("lang") != "", quoted('lang="', F.col("lang"))).otherwise("No lang attribute found"), "warning")
    summary = F.when(some_dir, F.concat(quoted('html dir="', F.col("html_dir"), '", '), quoted('body dir="', F.col("body_dir")))).otherwise('No dir="rtl" found on html/body or text containers')
    no_dir = _issues(by_html.where(~F.coalesce("rtl", F.lit(False))), "Missing RTL Direction", F.lit('<html dir="rtl">'), summary, "warning")
    bare = _clean(F.col("title"))
    meant = F.coalesce(F.nullif(_clean(F.col("heading")), F.lit("")), F.concat(F.lit("Meaningful "), "language", F.lit(" document title")))
    no_title = _issues(p.withColumn("line", F.col("title_line")).where(F.lower(bare).isin(*EMPTY_TITLES)), "Missing Title", quoted("<title>", meant, "</title>"), F.when(F.col("title").isNull(), "No <title> tag found").otherwise(quoted("<title>", bare, "</title>")))
    return no_lang.unionByName(no_dir).unionByName(no_title)


def title_issues(tree: DataFrame, expected: DataFrame) -> DataFrame:
    """The first title of each page against ``expected`` (page_id, title); an empty expected title asks for nothing."""
    found = dom.elements(tree, "title").groupBy("page_id").agg(F.min_by("text", "node_id").alias("text"), F.min_by("line", "node_id").alias("line"))
    both = expected.where(F.coalesce("title", F.lit("")) != "").join(found, "page_id", "left").withColumn("markup", F.lit(""))
    none = _issues(both.where("text is null"), "Missing Title Tag", F.col("title"), F.lit(""), "warning")
    differs = tx.norm_text(F.col("title")) != tx.norm_text(F.col("text"))
    return none.unionByName(_issues(both.where("text is not null").where(differs), "Title Mismatch", F.col("title"), F.col("text")))


def filename_issues(pairs: DataFrame) -> DataFrame:
    """``pairs`` (page_id, source_path, target_path) whose stems differ, in case too."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    rows = pairs.withColumn("line", F.lit(None).cast("int")).withColumn("markup", F.lit(""))
    return _issues(rows.where(stem("source_path") != stem("target_path")), "Filename Mismatch", stem("source_path"), stem("target_path"))


# ---- house style, opt-in


def label_bold(tree: DataFrame) -> DataFrame:
    """Labels before a colon in paragraphs of lists are bold."""
    kinds = dom.elements(tree, "p", "b", "strong")
    label = tx.label_prefix(tx.collapse(F.col("text")))
    paragraphs = kinds.where(F.col("tag") == "p").where(_within("li")).withColumn("label", label).where(F.col("label") != "")
    bold = kinds.where(F.col("tag") != "p").select("page_id", F.explode(F.filter("path", lambda p: p["tag"] == "p")).alias("p"), F.lower("text").alias("low"))
    wrapped = bold.select("page_id", F.col("p.node_id").alias("node_id"), "low").distinct()
    missing = paragraphs.withColumn("low", F.lower("label")).join(wrapped, ["page_id", "node_id", "low"], "left_anti")
    return _issues(missing, "Missing B Tag", F.concat(F.lit("<b>"), "label", F.lit("</b>")), F.col("label"))


def heading_bold(tree: DataFrame) -> DataFrame:
    """Headings of the first three levels have bold text within."""
    heads = dom.elements(tree, "h1", "h2", "h3").where(F.col("text") != "")
    inside = tree.where(F.col("tag").isin("b", "strong")).select("page_id", F.explode(F.filter("path", lambda p: p["tag"].isin("h1", "h2", "h3"))).alias("p"))
    bold = inside.select("page_id", F.col("p.node_id").alias("node_id")).distinct()
    expected = F.concat(F.lit("<"), "tag", F.lit("><b>"), "text", F.lit("</b></"), "tag", F.lit(">"))
    return _issues(heads.join(bold, ["page_id", "node_id"], "left_anti"), "Missing B Tag", expected, F.substring("markup", 1, 200))


def list_attributes(tree: DataFrame) -> DataFrame:
    """Marker attributes of list items, and the styles of paragraphs in lists."""
    kinds = dom.elements(tree, "li", "p").where(F.col("text") != "")
    shown = lambda c: F.concat(F.lit('data-list-text="'), c, F.lit('"'))
    marker = F.trim(_attribute("data-list-text"))
    items = _issues(kinds.where(F.col("tag") == "li").where(marker != BULLET), "Tag Attribute Mismatch", shown(F.lit(BULLET)), shown(marker))
    styled = kinds.where(F.col("tag") == "p").where(_within("li")).withColumn("style", tx.inline_style(_attribute("style")))
    wanted = F.explode(F.create_map(*(F.lit(x) for pair in LIST_STYLE.items() for x in pair))).alias("property", "value")
    each = styled.select("*", wanted).withColumn("has", F.element_at("style", F.col("property")))
    named = lambda c: F.concat("property", F.lit(": "), c)
    wrong = _issues(each.where(~F.col("has").eqNullSafe(F.col("value"))), "Style Attribute Mismatch", named(F.col("value")), named(F.coalesce("has", F.lit("missing"))))
    right = F.element_at("style", "padding-right")
    return items.unionByName(wrong).unionByName(_issues(styled.where(right.isNotNull()), "Style Attribute Mismatch", F.lit("padding-left: 23pt"), F.concat(F.lit("padding-right: "), right)))


def alignment(tree: DataFrame) -> DataFrame:
    """Text of lists and paragraphs is not aligned to the right; stock lines outside lists may be."""
    kinds = dom.elements(tree, "p", "span", "div").where(F.col("text") != "").where(_style("text-align") == "right")
    listed = _within("li")
    plain = (F.col("tag") == "p") & ~listed & ~tx.is_boilerplate_line(F.col("text"))
    return _issues(kinds.where(listed | plain), "Style Attribute Mismatch", F.lit("text-align: left"), F.lit("text-align: right"))


def list_markers(tree: DataFrame) -> DataFrame:
    """Other markers than the bullet, and markers that a style takes away, on direct items of unordered lists."""
    kinds = dom.elements(tree, "ul", "li")
    lists = kinds.where(F.col("tag") == "ul").select("page_id", F.col("node_id").alias("parent_id"), _attribute("style").alias("list_style"))
    items = kinds.where((F.col("tag") == "li") & (F.col("text") != "")).join(lists, ["page_id", "parent_id"])
    items = items.withColumn("marker", F.trim(_attribute("data-list-text"))).withColumn("markup", F.substring("text", 1, 80))
    none = lambda c: F.coalesce(F.element_at(tx.inline_style(c), "list-style-type") == "none", F.lit(False))
    both = F.lower(F.replace(F.concat_ws(";", "list_style", _attribute("style")), F.lit(" "), F.lit("")))
    removed = none(F.col("list_style")) | none(_attribute("style")) | both.rlike("list-style(-type)?:none")
    other = _issues(items.where(~F.col("marker").isin("", BULLET)), "Bullet Marker Mismatch", F.lit(BULLET), F.col("marker"))
    return other.unionByName(_issues(items.where(removed), "Missing Bullet Marker", F.lit(BULLET), F.lit("missing / hidden bullet")))


def bare_list_paragraphs(tree: DataFrame) -> DataFrame:
    """Paragraphs directly in an unordered list."""
    found = dom.elements(tree, "p").where(F.col("text") != "").where(F.try_element_at("path", F.lit(-1))["tag"] == "ul")
    return _issues(found.withColumn("markup", F.substring("text", 1, 120)), "Missing List Item Tag", F.lit('<li data-list-text="•"><p>...</p></li>'), F.lit("<ul><p>...</p></ul>"))


#: The opt-in rules by name.
HOUSE_STYLE = {"label_bold": label_bold, "heading_bold": heading_bold, "list_attributes": list_attributes, "alignment": alignment, "list_markers": list_markers, "bare_list_paragraphs": bare_list_paragraphs}


def house_style(tree: DataFrame, *names: str) -> DataFrame:
    """Issues of the named opt-in rules, of all by default."""
    return reduce(DataFrame.unionByName, (HOUSE_STYLE[n](tree) for n in names or HOUSE_STYLE))
