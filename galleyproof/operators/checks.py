"""All checks of pairs of a source and its target, as one operator over tables of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.functions.language import detect_language
from galleyproof.operators import align, dom, images, rules, tags

#: Findings on pictures that a run leaves out.
IGNORED = ("Image Display Size Mismatch", "Image Aspect Ratio Mismatch", "Image File Aspect Ratio Mismatch")
#: Kinds of targets that are word files.
WORD_TARGETS = ("word", "docx", "pdf_word", "pdf-word")
_COLUMNS = {"pair_id": "bigint", "line": "int", "category": "string", "engine_severity": "string", "expected": "string", "actual": "string"}


@dataclass
class Inputs:
    """Tables of many pairs; pairs without a row in one have nothing there.

    pairs: (pair_id, source_kind: pdf or rtf, target_kind: html or word, source_path, target_path).
    source_texts: (pair_id, text). source_tokens: (pair_id, tokens), as ``pdf_tokens`` and
    ``rtf_tokens`` make them. pages: (pair_id, html) of both kinds of targets, word files as
    ``docx.pages`` gives them. titles: (pair_id, title) of PDF sources. The pictures of both
    sides: (pair_id, idx, phash, chash). existing: (pair_id, path) of what local links may name.
    """

    pairs: DataFrame
    source_texts: DataFrame
    source_tokens: DataFrame
    pages: DataFrame
    titles: DataFrame | None = None
    source_images: DataFrame | None = None
    target_images: DataFrame | None = None
    existing: DataFrame | None = None


def _token(text: Column, line: Column, bold: Column, level: Column) -> Column:
    parts = {"text": text, "norm": tx.norm_compare(text), "line": line, "node": F.lit(None), "tag": F.lit(None), "bold": bold, "heading_level": level, "in_allowed_block": F.lit(True)}
    return F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v))).cast(align.TOKEN_TYPE)


def _gathered(rows: DataFrame, place: list[str]) -> DataFrame:
    """Tokens by document in the order of ``place``; one document is one array, as alignment needs it whole."""
    return rows.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*place, "token"))), lambda p: p["token"]).alias("tokens"))


def pdf_tokens(found: DataFrame) -> DataFrame:
    """(pair_id, tokens) of ``sources.pdf.tokens``."""
    token = _token(tx.nfc("text"), F.col("line").cast("int"), F.col("bold"), F.col("heading_level"))
    return _gathered(found.select(F.col("doc_id").cast("long").alias("pair_id"), "page", "line", "word", "position", token.alias("token")), ["page", "line", "word", "position"])


def rtf_tokens(found: DataFrame) -> DataFrame:
    """(pair_id, tokens) of ``sources.rtf.tokens``, which are plain."""
    token = _token(tx.nfc("text"), F.col("line").cast("int"), F.lit(False), F.lit(0))
    return _gathered(found.select(F.col("doc_id").cast("long").alias("pair_id"), "line", "position", token.alias("token")), ["line", "position"])


def languages(source_texts: DataFrame) -> DataFrame:
    """(pair_id, language) of each source."""
    return source_texts.select("pair_id", detect_language(F.col("text")).alias("language"))


def _shaped(issues: DataFrame, key: str = "page_id") -> DataFrame:
    have = issues.withColumnRenamed(key, "pair_id")
    return have.select(*((F.col(c) if c in have.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


def run_checks(inputs: Inputs, storage: StorageLevel = StorageLevel.DISK_ONLY) -> DataFrame:
    """(pair_id, line, category, engine_severity, expected, actual): all issues of all pairs.

    Word targets get no checks of metadata, title, raw tags and links. Issues whose texts
    differ in the spacing of hyphens only are left out, and so are the ``IGNORED``
    categories. Texts are composed before they are compared. Six checks read the parsed
    pages, so these are kept in ``storage``, parsed once and anew where an executor is lost.
    """
    word = F.col("target_kind").isin(*WORD_TARGETS)
    pairs = inputs.pairs.select("pair_id", F.lower("source_kind").alias("source_kind"), F.lower("target_kind").alias("target_kind"), "source_path", "target_path")
    html = pairs.where(~word).select("pair_id")
    pages = inputs.pages.select(F.col("pair_id").alias("page_id"), tx.nfc("html").alias("html"))
    of_pages = lambda rows: rows.select(F.col("pair_id").alias("page_id"))
    only_html = lambda rows: rows.join(of_pages(html), "page_id", "left_semi")
    tree = dom.nodes(pages).persist(storage)
    shown = dom.visible_text(tree)
    texts = inputs.source_texts.select("pair_id", tx.nfc("text").alias("text"))
    spoken = languages(texts).withColumnRenamed("pair_id", "page_id")
    found = [
        _shaped(rules.rtl_metadata(only_html(tree), only_html(spoken))),
        _shaped(rules.filename_issues(pairs.withColumnRenamed("pair_id", "page_id"))),
        _shaped(tags.raw_tag_issues(only_html(pages))),
        _shaped(align.token_issues(inputs.source_tokens, _with_empty(align.page_tokens(shown), pairs)), "pair_id"),
    ]
    if inputs.titles is not None:
        titled = inputs.titles.join(pairs.where(~word & (F.col("source_kind") == "pdf")).select("pair_id"), "pair_id", "left_semi")
        found.append(_shaped(rules.title_issues(tree, titled.select(F.col("pair_id").alias("page_id"), "title"))))
    if inputs.source_images is not None and inputs.target_images is not None:
        sides = [t.select(F.col("pair_id").alias("doc_id"), "idx", "phash", "chash") for t in (inputs.source_images, inputs.target_images)]
        pictures = images.image_issues(*sides).withColumn("engine_severity", F.lit("error"))
        found.append(_shaped(pictures.where(~F.col("category").isin(*IGNORED)), "doc_id"))
    late = [_shaped(dom.garbled(shown)), _shaped(dom.placeholders(shown))]
    if inputs.existing is not None:
        late.append(_shaped(dom.broken_links_of(only_html(tree), inputs.existing.select(F.col("pair_id").alias("page_id"), "path"))))
    out = found[0]
    for more in found[1:] + late:
        out = out.unionByName(more)
    return out.where(~tx.hyphen_noise(F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))))


def _with_empty(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tokens`` with an empty row for each pair that has none, so that an empty target lacks all of its source."""
    return pairs.select("pair_id").join(tokens, "pair_id", "left").select("pair_id", F.coalesce("tokens", F.array().cast(f"array<{align.TOKEN_TYPE}>")).alias("tokens"))
