"""Text normalisation, tokens and small string rules, as column functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are dropped or folded.
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
ZERO_WIDTH = "​‌‍﻿"
QUOTES_FROM, QUOTES_TO = "“”‘’", "\"\"''"
DASHES = "‐‒–—−"
ARABIC_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
ARABIC_FROM, ARABIC_TO = "أإآٱكيىۀ،؛؟۔", "ااااکییہ,;?."
BULLETS = ("•", "●", "◦", "▪", "▫", "·", "‣", "⁃", "◉", "○", "■")
WORD = r"[\p{L}\p{M}\p{N}]"
# possessive throughout: the regex engine recurses for each turn of a group that it may have to undo
TOKEN = f"{WORD}++(?:[-'’{DASHES}]{WORD}++)*+|[\\p{{P}}\\p{{S}}]"

#: Page labels and reservations of rights, in languages of the documents.
BOILERPLATE = (
    r"\bPage\s+\d+\b",
    r"تمام\s*حقوق\s*محفوظ\s*است[\s\.,،؛؟]*",
    r"جملہ\s*حقوق\s*محفوظ\s*ہیں[\s\.,،؛؟]*",
    r"جميع\s*الحقوق\s*محفوظة[\s\.,،؛؟]*",
    r"(?:صفحه\s*\d+|\d+\s*صفحه)",
    r"(?:الصفحة\s*\d+|\d+\s*الصفحة)",
)


def boilerplate_of(company: str) -> tuple[str, ...]:
    """Patterns of stock phrases with the footers of ``company``; with or without rights reserved and a page number."""
    name = re.sub(r"\W", lambda m: "\\" + m[0], company)
    return (rf"(?:©\s*)?20\d{{2}}\s+{name},\s*Inc\.?\s+All\s+Rights\s+Reserved\.?(?:\s+Page\s+\d+)?", rf"©\s*20\d{{2}}\s+{name}\s*,?\s*Inc\.?", *BOILERPLATE)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it. Texts of plain Latin never need it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_scan(c: Column) -> Column:
    """Light normalisation before tokens are cut; the text must be composed (``nfc``). Null is empty."""
    c = F.coalesce(c, F.lit(""))
    return collapse(F.translate(c, QUOTES_FROM + DASHES + BIDI + ZERO_WIDTH, QUOTES_TO + "-" * len(DASHES)))


def norm_compare(c: Column) -> Column:
    """Strong normalisation for comparisons: also Arabic marks and letter variants, and case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), ARABIC_MARKS, "")
    source = QUOTES_FROM + DASHES + ARABIC_FROM + BIDI + ZERO_WIDTH
    return F.lower(collapse(F.translate(c, source, QUOTES_TO + "-" * len(DASHES) + ARABIC_TO)))


def norm_words(words: Column) -> Column:
    """``norm_compare`` of each of ``words``, which hold no white space, folded as one text."""
    source = QUOTES_FROM + DASHES + ARABIC_FROM + BIDI + ZERO_WIDTH
    bare = F.regexp_replace(F.array_join(words, " "), ARABIC_MARKS, "")
    folded = F.lower(F.translate(bare, source, QUOTES_TO + "-" * len(DASHES) + ARABIC_TO))
    return F.when(F.size(words) > 0, F.split(folded, " ")).otherwise(F.expr("cast(array() as array<string>)"))


def norm_text(c: Column) -> Column:
    return F.regexp_replace(norm_compare(c), r"\.+$", "")


def tokens(c: Column) -> Column:
    """Words (joined by hyphens and apostrophes) and single marks, without bullets."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*BULLETS))


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^[\p{P}\p{S}]$")


def has_case(c: Column) -> Column:
    return F.lower(c) != F.upper(c)


def strip_boilerplate(c: Column, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    c = norm_scan(c)
    for p in patterns:
        c = F.regexp_replace(c, f"(?iU){p}", " ")
    return collapse(c)


def is_boilerplate_line(c: Column, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    """Nothing left, or no letter left, or just a page number."""
    return ~strip_boilerplate(c, patterns).rlike(r"\p{L}") | collapse(F.coalesce(c, F.lit(""))).rlike(r"(?i)^page\s+\d+$")


def hyphen_canonical(c: Column) -> Column:
    """For comparisons: no spaces around a hyphen between words."""
    return F.regexp_replace(norm_compare(c), f"(?<={WORD})\\s*-\\s*(?={WORD})", "-")


def hyphen_noise(expected: Column, actual: Column) -> Column:
    """Whether two texts differ in the spacing or kind of hyphens only."""
    e, a = F.trim(expected), F.trim(actual)
    left, right = (F.regexp_replace(hyphen_canonical(x), r"\.+$", "") for x in (e, a))
    raw = F.lower(F.concat_ws(" ", e, a))
    return F.coalesce((e != "") & (a != "") & (left == right) & F.contains(left, F.lit("-")) & raw.rlike(f" -|- |[{DASHES}]"), F.lit(False))


def label_prefix(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"^(.{1,90}?:)", 1))


def css_length(c: Column) -> Column:
    """The first number of a length, as double; null without one."""
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def inline_style(c: Column) -> Column:
    """A style attribute as a map of lower-case names and values; the last of a name wins."""
    parts = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    return F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def safe_cell(c: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))
    return F.when(plain.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)


def sanitise_name(c: Column, longest: int = 40) -> Column:
    """A file stem of ASCII letters, digits, _ and -; accents must be off already (``without_marks``)."""
    stem = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(F.translate(F.trim(stem), " ", "_"), r"[^A-Za-z0-9_\-]+", "")
    plain = F.trim(F.regexp_replace(plain, "_+", "_"), F.lit("_-"))
    return F.substring(F.when(plain == "", "Uploaded_Batch").otherwise(plain), 1, longest)


#: Folder names that tell a document's language.
LANGUAGE_FOLDERS = ("english", "spanish", "french", "russian", "polish", "vietnamese", "chinese", "arabic", "farsi", "urdu", "german", "portuguese", "italian", "dutch")


def pair_key(path: Column, mode: str = "pdf") -> Column:
    """What a source and its target share: the folded stem; for ``rtf`` after language and category folders."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    if mode == "rtf":
        language = F.coalesce(F.get(F.filter(parts, lambda p: p.isin(*LANGUAGE_FOLDERS)), F.lit(0)), F.lit(""))
        parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")
        stem = F.concat(language, F.when(parent.rlike(r"^[\p{L}\p{N}]{1,3}$"), parent).otherwise(""), stem)
    return F.regexp_replace(F.replace(stem, F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def context(words: Column, index: Column, radius: int = 8) -> Column:
    """The words around ``index`` (from 0)."""
    first = F.greatest(index - radius, F.lit(0))
    return F.array_join(F.slice(words, (first + 1).cast("int"), (index + radius + 1 - first).cast("int")), " ")


#: Characters of the Arabic script, those that turn with the reading direction (not its digits), and letters of any script.
RTL_SCRIPT = r"\p{IsArabic}"
_TURNING = "\u0600-\u065f\u066a-\u06ef\u06fa-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff"
LETTER = r"[\p{L}\p{N}_]"


def is_mostly_rtl(arabic: Column, letters: Column) -> Column:
    """Whether Arabic characters are at least three and 40 % of all letters."""
    return (letters > 0) & (arabic >= F.greatest(F.lit(3.0), 0.4 * letters))


def is_rtl_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return is_mostly_rtl(F.regexp_count(c, F.lit(RTL_SCRIPT)), F.regexp_count(c, F.lit(LETTER)))


def is_rtl_word(c: Column) -> Column:
    """Whether a word has an Arabic letter, not only digits."""
    return c.rlike(f"[{_TURNING}]")


def rtl_fix_line(c: Column) -> Column:
    """In mostly Arabic text each run of Arabic words reversed as a whole, the rest as it is."""
    runs = F.regexp_extract_all(c, F.lit(f"[{_TURNING}]++(?:(?U:\\s++)[{_TURNING}]++)*+|[^{_TURNING}]++"), F.lit(0))
    fixed = F.array_join(F.transform(runs, lambda r: F.when(is_rtl_word(r), F.reverse(r)).otherwise(r)), "")
    return F.when(is_rtl_text(c), fixed).otherwise(c)
