"""Severity and area of issues, and what they make of files and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories by displayed severity and by area.
CRITICAL = ("Changed Text", "Missing Text", "Extra Text", "Title Mismatch", "Missing Title", "Broken Image", "Missing Image", "Image Mismatch", "Image Content Mismatch", "Garbled Text", "Encoding / Mojibake", "Unexpected Closing Tag", "Unclosed Tag", "HTML Parse Error", "Missing Punctuation", "Extra Punctuation", "Punctuation Mismatch")
MAJOR = ("Missing Heading Tag", "Heading Level Mismatch", "Missing B Tag", "Missing Required B Tag", "Missing Strong/Bold Tag", "Unexpected Strong/Bold Tag", "Missing Emphasis/Italic Tag", "Unexpected Emphasis/Italic Tag", "Bullet Marker Mismatch", "Missing Bullet Marker", "Missing List Item Tag", "Style Attribute Mismatch", "Tag Attribute Mismatch", "Text Outside Expected HTML Tags", "Broken Link", "Missing Language Attribute", "Missing RTL Direction", "RTL Direction Mismatch")
MINOR = ("Filename Mismatch", "Placeholder Text", "Placeholder", "Image Order Mismatch")
AREAS = {
    "Content": ("Changed Text", "Missing Text", "Extra Text", "Missing Punctuation", "Extra Punctuation", "Punctuation Mismatch", "Garbled Text", "Encoding / Mojibake"),
    "Structure": ("Missing Heading Tag", "Heading Level Mismatch", "Missing B Tag", "Missing Required B Tag", "Missing Strong/Bold Tag", "Unexpected Strong/Bold Tag", "Missing Emphasis/Italic Tag", "Unexpected Emphasis/Italic Tag", "Bullet Marker Mismatch", "Missing Bullet Marker", "Missing List Item Tag", "Tag Attribute Mismatch", "Unexpected Closing Tag", "Unclosed Tag", "HTML Parse Error"),
    "Style": ("Style Attribute Mismatch", "Missing RTL Direction", "RTL Direction Mismatch"),
    "Image": ("Broken Image", "Missing Image", "Image Mismatch", "Image Content Mismatch", "Image Order Mismatch"),
    "Metadata": ("Filename Mismatch", "Title Mismatch", "Missing Title", "Broken Link", "Missing Language Attribute"),
}
SEVERITIES = ("Critical", "Major", "Minor", "Passed")


def severity(category: Column, raw: Column) -> Column:
    return F.when(category.isin(*CRITICAL), "Critical").when(category.isin(*MAJOR), "Major").when(category.isin(*MINOR), "Minor").when(F.lower(raw) == "error", "Critical").when(F.lower(raw) == "warning", "Major").otherwise("Minor")


def area(category: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, categories in AREAS.items():
        out = out.when(category.isin(*categories), name)
    return out.otherwise("Other")


def classify(issues: DataFrame) -> DataFrame:
    """Issues with displayed ``severity`` and ``area``; the checks' own severity is ``engine_severity``."""
    return issues.withColumn("severity", severity(F.col("category"), F.col("engine_severity"))).withColumn("area", area(F.col("category")))


def severity_rank(c: Column) -> Column:
    return F.when(c == "Critical", 0).when(c == "Major", 1).when(c == "Minor", 2).otherwise(3)


def file_severity(critical: Column, major: Column, minor: Column) -> Column:
    return F.when((critical >= 1) | (major >= 5), "Critical").when((major >= 1) | (minor >= 8), "Major").when(minor >= 1, "Minor").otherwise("Passed")


def count_severities(issues: DataFrame, *keys: str) -> DataFrame:
    """Per file: critical, major, minor and the file's overall severity."""
    counted = issues.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES[:3]))
    return counted.withColumn("file_severity", file_severity(F.col("critical"), F.col("major"), F.col("minor")))


def sorted_rank(issues: DataFrame, *keys: str) -> DataFrame:
    """Issues numbered in report order: severity, line (none last), category; ties by the other columns."""
    order = [severity_rank(F.col("severity")), F.coalesce("line", F.lit(999_999)), "category", *(c for c in ("issue_id",) if c in issues.columns)]
    return issues.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_of_each(issues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of issues that agree in ``keys`` only the first by ``order``."""
    return issues.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
