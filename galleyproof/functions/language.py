"""Language guesses from scripts and trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyproof.functions.text import norm_scan

#: How many characters of a text are looked at, and what decides.
SAMPLE = 3000
SCRIPTS = (("Hindi", "[ऀ-ॿ]"), ("Chinese", "[一-鿿]"), ("Japanese", "[぀-ヿ]"), ("Korean", "[가-힯]"))
URDU_LETTERS = "[ٹڈڑگچپژکںھہےۓ]"
DIACRITICS = "[à-æç-öø-ýÿœ]"
TRIGRAMS = {
    "French": ["es ", "de ", "ent", "les", "on ", "la ", "ons", "que", "tion", "le "],
    "German": ["en ", "der", "ie ", "die", "und", "ein", "ich", "das", "sch", "ng "],
    "Spanish": ["de ", "es ", "en ", "que", "la ", "el ", "ón ", "ion", "os ", "con"],
    "Portuguese": ["de ", "os ", "as ", "que", "em ", "do ", "da ", "ão ", "es ", "ar "],
    "Italian": ["del", "che", "la ", "di ", "le ", "in ", "ne ", "on ", "per", "una"],
    "Dutch": ["en ", "de ", "het", "van", "ing", "ge ", "een", "te ", "dat", "ij "],
    "English": ["the", " th", "he ", "ing", "and", "ion", "ed ", "ent", "or ", "al "],
}


def _count(c: Column, part: str) -> Column:
    """Occurrences that do not overlap; counted by bytes, whose number a string knows."""
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(part), F.lit("")))) / len(part.encode())


def detect_language(text: Column) -> Column:
    """A language name: by script if a script has over 20 letters, else by trigrams; ties go to the first."""
    sample = F.lower(norm_scan(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)))
    return F.get(F.transform(F.array(sample), _language_of), F.lit(0))  # the sample is made once for all counts


def _language_of(sample: Column) -> Column:
    scores = {name: reduce(lambda a, b: a + b, (_count(sample, t) for t in grams)) for name, grams in TRIGRAMS.items()}
    plain = F.regexp_count(sample, F.lit(DIACRITICS)) < 5
    scores["English"] = F.when(plain, scores["English"] * 1.5).otherwise(scores["English"])
    ranked = F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())))
    out = F.when(F.regexp_count(sample, F.lit("[Ѐ-ӿ]")) > 20, "Russian")
    arabic = F.regexp_count(sample, F.lit(r"\p{IsArabic}")) > 20
    out = out.when(arabic & (F.regexp_count(sample, F.lit(URDU_LETTERS)) >= 3), "Urdu").when(arabic, "Arabic")
    for name, letters in SCRIPTS:
        out = out.when(F.regexp_count(sample, F.lit(letters)) > 20, name)
    return out.otherwise(F.array_min(ranked)["n"])
