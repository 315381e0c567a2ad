"""Alignment of source and target tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.functions import text as tx
from galleyproof.session import map_arrow, ship

_OPS = pa.list_(pa.struct([("op", pa.string()), ("i1", pa.int32()), ("i2", pa.int32()), ("j1", pa.int32()), ("j2", pa.int32())]))
_SCHEMA = "pair_id long, ops array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>"


def _opcodes(a: list[str] | None, b: list[str] | None) -> list[dict]:
    found = SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes()
    return [dict(zip(("op", "i1", "i2", "j1", "j2"), o, strict=True)) for o in found]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ops = [_opcodes(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ops, _OPS)], ["pair_id", "ops"])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in ("i1", "i2", "j1", "j2"))])))
def _align_unequal(pairs: pa.Array) -> pa.Array:
    return pa.array([None if p is None else _opcodes(p["a"], p["b"]) for p in pairs.to_pylist()], _OPS)


def opcodes(pairs: DataFrame) -> DataFrame:
    """(pair_id, ops) of ``pairs`` (pair_id, source, target: arrays of normalised tokens).

    Longest contiguous blocks first (Ratcliff and Obershelp), without junk. Equal
    sequences need no alignment and stay in the JVM.
    """
    same = F.col("source") == F.col("target")
    one = F.expr("if(size(source) = 0, array(), array(named_struct('op', 'equal', 'i1', 0, 'i2', size(source), 'j1', 0, 'j2', size(target))))").cast(_SCHEMA.split("ops ", 1)[1])
    equal = pairs.where(same).select(F.col("pair_id").cast("long").alias("pair_id"), one.alias("ops"))
    other = pairs.where(~same).select(F.col("pair_id").cast("long").alias("pair_id"), "source", "target")
    return equal.unionByName(map_arrow(other, _align, _SCHEMA))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once though ``body`` names it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_ops(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    """``rows`` with ``ops``, what ``opcodes`` finds for two arrays in the row they are in; null if they are equal, which never leave the JVM.

    Each step names the one before it twice, so that the optimizer keeps them apart: the
    arrays are made once, and rows that wait for Python hold them only where they differ.
    """
    both = rows.withColumns({"a": source, "b": target})
    unequal = both.select(*rows.columns, F.when(F.col("a") != F.col("b"), F.struct("a", "b")).alias("unequal"))
    return unequal.select(*rows.columns, F.when(F.col("unequal").isNotNull(), _align_unequal("unequal")).alias("ops"))


def _joined(tokens: Column, taken: Column, join: Callable[[Column, Column, Column], Column]) -> Column:
    """``tokens`` with those at the indices ``taken`` joined with their neighbours."""
    kept = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~F.array_contains(taken, i) & ~F.array_contains(taken, i - 1))
    one = lambda i: F.when(F.array_contains(taken, i + 1), join(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))).otherwise(F.get(tokens, i))
    return F.when(F.size(taken) == 0, tokens).otherwise(F.transform(kept, one))


def _hyphens(words: Column) -> Column:
    """Indices of hyphens between plain words, from left to right without overlaps: of two around one word the first."""
    plain = f"^{tx.WORD}+$"
    at = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    between = F.filter(at, lambda i: (F.get(words, i) == "-") & F.get(words, i - 1).rlike(plain) & F.get(words, i + 1).rlike(plain))
    step = lambda a, i: F.when(F.coalesce(F.get(a, F.size(a) - 1) == i - 2, F.lit(False)), a).otherwise(F.concat(a, F.array(i)))
    return F.aggregate(between, F.expr("cast(array() as array<int>)"), step)


def merge_hyphens(words: Column) -> Column:
    """Words with each word, hyphen, word joined; only hyphens are folded, so long texts stay cheap."""
    return _let(words, lambda w: _let(_hyphens(w), lambda at: _joined(w, at, F.concat)))


def merge_hyphen_tokens(tokens: Column) -> Column:
    """The same for tokens with flags: line and node are the first word's, bold and heading hold if they hold for one, the block for all."""

    def join(a: Column, h: Column, b: Column) -> Column:
        text = F.concat(a["text"], h["text"], b["text"])
        flags = {"line": a["line"], "node": a["node"], "tag": a["tag"], "bold": a["bold"] | h["bold"] | b["bold"], "heading_level": F.greatest(a["heading_level"], h["heading_level"], b["heading_level"]), "in_allowed_block": a["in_allowed_block"] & h["in_allowed_block"] & b["in_allowed_block"]}
        parts = {"text": text, "norm": tx.norm_compare(text), **flags}
        return F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v))).cast(TOKEN_TYPE)

    texts = lambda all_: F.transform(all_, lambda t: t["text"])
    return _let(tokens, lambda own: _let(_let(texts(own), _hyphens), lambda at: _joined(own, at, join)))


TOKEN_TYPE = "struct<text:string,norm:string,line:int,node:int,tag:string,bold:boolean,heading_level:int,in_allowed_block:boolean>"


def page_texts(shown: DataFrame) -> DataFrame:
    """(pair_id, texts) of the shown texts of pages, in document order and with their flags: a page in little space, as its tokens each repeat the flags."""
    piece = F.struct("node_id", "line", tx.strip_boilerplate(F.col("text")).alias("text"), F.col("parent_tag").alias("tag"), "bold", "heading_level", "in_allowed_block")
    return shown.select(F.col("page_id").alias("pair_id"), piece.alias("piece")).groupBy("pair_id").agg(F.sort_array(F.collect_list("piece")).alias("texts"))


def _text_words(texts: Column) -> Column:
    return F.flatten(F.transform(texts, lambda p: tx.tokens(p["text"])))


def _text_tokens(texts: Column, norms: Callable[[Column], Column]) -> Column:
    """Tokens of ``page_texts``; ``norms`` makes an array of words another of the same size."""

    def of(p: Column, words: Column, normed: Column) -> Column:
        flags = {"line": p["line"], "node": p["node_id"], "tag": p["tag"], "bold": p["bold"], "heading_level": p["heading_level"], "in_allowed_block": p["in_allowed_block"]}
        return F.transform(words, lambda t, i: F.named_struct(*(x for k, v in ({"text": t, "norm": F.get(normed, i)} | flags).items() for x in (F.lit(k), v))))

    return F.flatten(F.transform(texts, lambda p: _let(tx.tokens(p["text"]), lambda words: _let(norms(words), lambda normed: of(p, words, normed)))))


def page_tokens(shown: DataFrame) -> DataFrame:
    """(pair_id, tokens) of the shown texts of pages: words in document order, each with the flags of its text."""
    return page_texts(shown).select("pair_id", _text_tokens(F.col("texts"), tx.norm_words).alias("tokens"))


def token_issues(sources: DataFrame, targets: DataFrame, emit_capitalization: bool = False) -> DataFrame:
    """Issues of aligned documents, ``sources`` and ``targets`` being (pair_id, tokens).

    (pair_id, position, category, engine_severity, line, expected, actual). Differences of
    words give text issues at the line of the next target token. Equal words give
    issues where the source is bold or a heading and the target is not, where levels differ,
    and where a target is outside any block. Issues alike in all but position are one.
    A side without tokens is empty; pairs without any row on one side do not appear.
    Differences in case alone are found only on request.
    """
    ship(sources.sparkSession)
    both = sources.select("pair_id", merge_hyphen_tokens(F.col("tokens")).alias("s")).join(targets.select("pair_id", merge_hyphen_tokens(F.col("tokens")).alias("t")), "pair_id")
    norms = (F.transform(c, lambda x: x["norm"]) for c in ("s", "t"))
    return _issues(_with_ops(both, *norms), emit_capitalization)


def page_issues(sources: DataFrame, targets: DataFrame, emit_capitalization: bool = False) -> DataFrame:
    """``token_issues`` of shown texts of pages: these are joined, and tokens are made of a pair at a time, so no shuffle and no sort holds tokens."""
    ship(sources.sparkSession)
    both = page_texts(sources).withColumnRenamed("texts", "s").join(page_texts(targets).withColumnRenamed("texts", "t"), "pair_id")
    norms = (tx.norm_words(merge_hyphens(_text_words(F.col(c)))) for c in ("s", "t"))
    made = (merge_hyphen_tokens(_text_tokens(F.col(c), lambda words: words)).alias(c) for c in ("s", "t"))  # their norms are not read
    return _issues(_with_ops(both, *norms).select("pair_id", "ops", *made), emit_capitalization)


def _rules(p: Column, h: Column, emit_capitalization: bool) -> list[tuple[Column, str, Column, Column, str]]:
    """(broken, category, expected, actual, severity) of a source token and the equal target token."""
    name, heads, has = F.coalesce(h["tag"], h["text"]), p["heading_level"] > 0, h["heading_level"] > 0
    level = F.concat(F.lit("h"), p["heading_level"])
    rules = [
        (p["bold"] & ~heads & ~h["bold"], "Missing Strong/Bold Tag", F.lit("strong/b or font-weight:bold"), name, "warning"),
        (heads & ~has, "Missing Heading Tag", level, name, "warning"),
        (heads & has & (p["heading_level"] != h["heading_level"]), "Heading Level Mismatch", level, F.concat(F.lit("h"), h["heading_level"]), "warning"),
        (~h["in_allowed_block"] & ~heads, "Missing Paragraph/List Tag", F.lit("p/li/h1-h6/td/th/figcaption"), name, "warning"),
    ]
    if emit_capitalization:
        rules.append(((p["text"] != h["text"]) & (F.lower(p["text"]) == F.lower(h["text"])) & tx.has_case(p["text"]), "Capitalization Mismatch", p["text"], h["text"], "error"))
    return [(F.coalesce(broken, F.lit(False)), *rest) for broken, *rest in rules]


_FOUND = f"array<struct<op:string,position:int,line:int,sp:array<string>,tp:array<string>,p:{TOKEN_TYPE},h:{TOKEN_TYPE}>>"


def _issues(pairs: DataFrame, emit_capitalization: bool) -> DataFrame:
    """Issues of ``pairs`` (pair_id, s, t, ops), ``ops`` being null where the norms of ``s`` and ``t`` are equal.

    Each pair is gone through once, and only what is found leaves its row.
    """
    own = F.coalesce("ops", F.expr("if(size(s) = 0, array(), array(named_struct('op', 'equal', 'i1', 0, 'i2', size(s), 'j1', 0, 'j2', size(t))))").cast(_SCHEMA.split("ops ", 1)[1]))
    part = lambda c, a, b: F.slice(F.col(c), a + 1, b - a)
    texts = lambda tokens: F.transform(tokens, lambda x: x["text"])
    struct = lambda **parts: F.struct(*(v.alias(k) for k, v in parts.items()))
    none, no_token = F.lit(None).cast("array<string>"), F.lit(None).cast(TOKEN_TYPE)

    def differing(o: Column) -> Column:
        line = F.get("t", o["j1"])["line"]
        return F.array(struct(op=o["op"], position=o["i1"], line=line, sp=texts(part("s", o["i1"], o["i2"])), tp=texts(part("t", o["j1"], o["j2"])), p=no_token, h=no_token)).cast(_FOUND)

    def equal(o: Column) -> Column:
        broken = lambda p, h: F.when(reduce(Column.__or__, (r[0] for r in _rules(p, h, emit_capitalization))), F.struct(p.alias("p"), h.alias("h")))
        zipped = F.zip_with(part("s", o["i1"], o["i2"]), part("t", o["j1"], o["j2"]), broken)
        placed = F.transform(zipped, lambda x, i: F.when(x.isNotNull(), struct(op=o["op"], position=o["i1"] + i, line=x["h"]["line"], sp=none, tp=none, p=x["p"], h=x["h"])))
        return F.filter(placed, lambda x: x.isNotNull()).cast(_FOUND)

    # outer, as else the optimizer adds a filter that computes the whole array once more
    found = pairs.select("pair_id", F.inline_outer(F.flatten(F.transform(own, lambda o: F.when(o["op"] == "equal", equal(o)).otherwise(differing(o)))))).where("op is not null")
    shaped = lambda broken, category, severity, expected, actual: F.when(broken, struct(category=category, engine_severity=F.lit(severity), expected=expected, actual=actual))
    same = F.col("op") == "equal"
    before, after = F.array_join("sp", " "), F.array_join("tp", " ")
    issues = [shaped(~same & ~tx.hyphen_noise(before, after), _text_category("op"), "error", before, after)]
    issues += [shaped(same & broken, F.lit(category), severity, expected, actual) for broken, category, expected, actual, severity in _rules(F.col("p"), F.col("h"), emit_capitalization)]
    out = found.select("pair_id", "position", "line", F.inline(F.filter(F.array(*issues), lambda x: x.isNotNull())))
    return out.groupBy("pair_id", "category", "engine_severity", "line", "expected", "actual").agg(F.min("position").alias("position"))


def _text_category(op: str) -> Column:
    """What a difference is, by its operation ``op`` and the texts of its sides ``sp`` and ``tp``."""
    marks = lambda c: F.forall(c, tx.is_punctuation)
    return (
        F.when(F.col(op) == "replace", F.when(marks("sp") | marks("tp"), "Punctuation Mismatch").otherwise("Changed Text"))
        .when(F.col(op) == "delete", F.when(marks("sp"), "Missing Punctuation").otherwise("Missing Text"))
        .otherwise(F.when(marks("tp"), "Extra Punctuation").otherwise("Extra Text"))
    )


def text_issues(pairs: DataFrame) -> DataFrame:
    """Issues of ``pairs`` (pair_id, source_text, target_text): one for each difference of their tokens.

    Differences in the spacing of hyphens only are none. Issues that agree in category,
    expected and actual are one; its position is that of the first.
    """
    cut = lambda c: merge_hyphens(tx.tokens(tx.norm_scan(F.col(c))))
    tokens = pairs.select("pair_id", cut("source_text").alias("s"), cut("target_text").alias("t"))
    norms = tokens.select("pair_id", F.transform("s", tx.norm_compare).alias("source"), F.transform("t", tx.norm_compare).alias("target"))
    found = opcodes(norms).select("pair_id", F.explode("ops").alias("o")).where("o.op <> 'equal'").join(tokens, "pair_id")
    part = lambda c, a, b: F.slice(F.col(c), F.col(f"o.{a}") + 1, F.col(f"o.{b}") - F.col(f"o.{a}"))
    parts = found.select("pair_id", "o", part("s", "i1", "i2").alias("sp"), part("t", "j1", "j2").alias("tp"))
    out = parts.select("pair_id", F.col("o.i1").alias("position"), _text_category("o.op").alias("category"), F.lit("error").alias("engine_severity"), F.array_join("sp", " ").alias("expected"), F.array_join("tp", " ").alias("actual"))
    kept = out.where(~tx.hyphen_noise(F.col("expected"), F.col("actual")))
    return kept.groupBy("pair_id", "category", "engine_severity", "expected", "actual").agg(F.min("position").alias("position"))
