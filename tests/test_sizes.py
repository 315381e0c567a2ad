"""What keeps queries within bounds on larger tables, and on texts that small tables do not hold."""

import duckdb
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.operators import align, dom
from galleyproof.plans import queries as plans

SF = "/root/testdata/sf0.001"

#: Headings with references that are whole, cut off, unknown, without a semicolon, or escaped themselves.
HEADINGS = ["a &amp; b", "token = &quot;77", "Than*** oreshe&&&amp", "in&&&am", "R&a", "x &quo", "&lt &#39;c&#39; &#x41", "&amp;quot; &amp;amp;", "&copy 2026 &unknown;", "gege&", "&", "plain"]


def same_as_sql(spark, folder, name: str, **tables) -> bool:
    """Whether a query and its SQL have the same rows for ``tables`` of the columns and rows given."""
    db = duckdb.connect()
    for table, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"create or replace view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    said = db.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    found = sorted(map(tuple, plans.queries()[name](spark, str(folder)).select(columns).collect()), key=str)
    expected = sorted(said.fetchall(), key=str)
    return bool(found) and found == expected


def pages_of(headings, each: int = 1):
    page = '<!DOCTYPE html><html lang="{0}"><head><title>{1}</title></head><body><article><h1>{1}</h1><p>{1}</p></article></body></html>'
    made = [page.format(("en", "ar", "ur")[i % 3], h) for i, h in enumerate(headings)]
    return "page_id long, url string, html string", [(i * each + k, "u", h) for i, h in enumerate(made) for k in range(each)]


def test_references_in_elements_are_those_of_the_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "dom_elements", pages=pages_of(HEADINGS))


def test_references_in_metadata_are_those_of_the_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "rule_rtl_metadata", pages=pages_of(HEADINGS, 20))


def test_references_in_titles_are_those_of_the_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "rule_title_issues", pages=pages_of(HEADINGS, 3))


def test_elements_resolve_all_references(spark):
    pages = spark.createDataFrame([(1, "<h1>&quot;a&quot; &amp b &lt;i&gt;</h1>")], "page_id long, html string")
    assert dom.elements(dom.nodes(pages), "h1").first()["text"] == '"a" & b <i>'


def test_pages_are_aligned_in_one_pass(spark):
    plan = plans.queries()["align_headings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join ") == 1 and plan.count("Union") == 0


def test_issues_of_pages_are_those_of_their_tokens(spark):
    def shown(*pages):
        return dom.visible_text(dom.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))

    sources = shown("<p><b>Big</b> word</p>", "<h2>T</h2>same", "<p>a</p><p>b c</p>", "<p>mini - stroke b</p>", "<p>x</p>", "<p>only here</p>", "<h1>One - two</h1> - <p>3 - 4 - 5</p>", "<p>ـ کتاب</p>")
    targets = shown("<p>Big word</p>", "<p>T</p>same", "<div>a</div>b d", "<p>mini-stroke\n</p>\n<p>c</p>", "<p>•</p>", "", "<p>One - two</p><h3>3-4 - 5</h3>", "<p>ـ كتاب</p>")
    columns = ["pair_id", "position", "category", "engine_severity", "line", "expected", "actual"]
    rows = lambda found: sorted(map(tuple, found.select(columns).collect()), key=str)
    found = rows(align.page_issues(sources, targets))
    assert found == rows(align.token_issues(align.page_tokens(sources), align.page_tokens(targets)))
    assert (0, 0, "Missing Strong/Bold Tag", "warning", 1, "strong/b or font-weight:bold", "p") in found and (4, 0, "Missing Text", "error", None, "x", "") in found
    assert {r[0] for r in found} == {0, 1, 2, 3, 4, 6}


def test_words_are_folded_together_as_one_by_one(spark):
    words = ["Big", "ـ", "أحمد", "ΣΑΣ", "ΟΔΟΣ", "İ", "؟", "X‑rays", "“", "É"]
    row = spark.createDataFrame([(words, [])], "w array<string>, none array<string>")
    found = row.select(tx.norm_words(F.col("w")).alias("a"), F.transform("w", tx.norm_compare).alias("b"), tx.norm_words(F.col("none")).alias("c")).first()
    assert found["a"] == found["b"] and found["c"] == []


#: Texts whose cuts of 60 characters hold a letter, or only marks, digits, spaces or bullets.
CUTS = ["Some words in a line " * 6, "x" * 59 + "." + ".", "é" * 120 + ".", "a b " * 15 + "12 34", "- " * 30 + "word", "y" * 180 + " " * 60 + "z", "Ende.", "7", "Big " * 15 + "• ●" + " " * 57 + "end"]


def test_cuts_without_letters_keep_their_words(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "pdf_words", benchmark=("item_id long, text string", list(enumerate(CUTS))))


def test_cuts_without_letters_keep_their_tokens(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "pdf_tokens", benchmark=("item_id long, text string", list(enumerate([*CUTS, " " * 70, "• ●", "", None]))))
