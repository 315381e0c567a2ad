"""The register of queries, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galleyproof.functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def on(template: str, column: str) -> str:
    """A SQL template with its {} filled in."""
    return template.replace("{}", column)


SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"
DROP = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200D}\x{FEFF}]"
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
SCAN = f"trim(regexp_replace(translate(regexp_replace(nfc_normalize({{}}), '{DROP}', '', 'g'), '“”‘’‐‒–—−', '\"\"''''-----'), '{SPACES}', ' ', 'g'))"
COMPARE = f"lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(nfc_normalize({{}}), '{DROP}', '', 'g'), '{MARKS}', '', 'g'), '“”‘’‐‒–—−أإآٱكيىۀ،؛؟۔', '\"\"''''-----ااااکییہ,;?.'), '{SPACES}', ' ', 'g')))"
TOKEN = r"[\p{L}\p{M}\p{N}]+(?:[-''’‐‒–—−][\p{L}\p{M}\p{N}]+)*|[\p{P}\p{S}]"
BULLETS = quoted(tx.BULLETS)
TOKENS = f"list_filter(regexp_extract_all({{}}, '{TOKEN}'), lambda t: t not in ({BULLETS}))"
