"""Long, broken and hostile inputs of the document checks."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.operators import checks, tags
from galleyproof.sources import packages


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).collect()[0]["x"]


def test_long_tokens(spark):
    for text, n in (("word-" * 200_000 + "end", 1), ("a b " * 250_000, 500_000), ("don't" * 200_000, 1), ("." * 1_000_000, 1_000_000)):
        assert one(spark, text, F.size(tx.tokens(F.col("text")))) == n
    assert one(spark, "well-known dog's - x", tx.tokens(F.col("text"))) == ["well-known", "dog's", "-", "x"]


def test_long_right_to_left_lines(spark):
    text = "كتاب قلم " * 110_000
    fixed = one(spark, text + "abc", tx.rtl_fix_line(F.col("text")))
    assert len(fixed) == len(text) + 3 and fixed.endswith("abc") and fixed.startswith("ملق باتك")


def test_long_tags(spark):
    shapes = ["<b then " + "word " * 200_000, "<a " + "x='1' " * 170_000 + ">text</a>", '<a title="' + "y" * 1_000_000 + '">', "<" * 1_000_000, "<p '" * 1_000]
    events = [one(spark, s, tags.tag_events(F.col("text"))) for s in shapes]
    assert events[1] == ["a", "/a"] and events[2] == ["a"] and events[0] == []


def test_many_tags_take_linear_time():
    for html, n in (("<p>text" * 100_000, 100_000), ("<p>" * 50_000 + "</b>" * 50_000, 100_000), ("<i>" * 50_000 + "<p></p>" * 50_000, 50_000), ("<p><b></p>" * 50_000, 50_000)):
        started = time.perf_counter()
        assert len(tags.page_tag_issues(html)) == n
        assert time.perf_counter() - started < 5


def test_raw_tag_issues_have_lines(spark):
    html = "<div>\n<p><strong>Text</p>\n</ul><br>\n<img src=x/></div>\n<em>"
    pages = spark.createDataFrame([("a", html), ("b", None), ("c", "<!-- <p> --><script>'</p>'</script>")], "file string, raw string")
    found = [tuple(r)[1:7] for r in tags.raw_tag_issues(pages, "file", "raw").orderBy("file", "position").collect()]
    assert found == [
        (0, 2, "Tag Nesting Mismatch", "strong", "</strong> before </p>", "</p>"),
        (1, 3, "Unexpected Closing Tag", "ul", "</div>", "</ul>"),
        (2, 5, "Unclosed Tag", "em", "</em>", "missing closing tag"),
    ]


def archive(*members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_packages_of_all_kinds(spark):
    good = archive(("../../x.html", b"1"), ("/abs/./y.pdf", b"2"), ("a\\..\\b\\z.RTF", b"3"), ("notes.xml", b"4"))
    encrypted = bytearray(archive(("a.pdf", b"x" * 50)))
    for at in (encrypted.find(b"PK\x03\x04") + 6, encrypted.find(b"PK\x01\x02") + 8):
        encrypted[at] |= 1
    unknown = bytearray(archive(("a.pdf", b"x" * 50)))
    for at in (unknown.find(b"PK\x03\x04") + 8, unknown.find(b"PK\x01\x02") + 10):
        unknown[at : at + 2] = b"\x63\x00"
    whole = archive(("a.pdf", bytes(range(256)) * 400))
    broken = bytearray(whole)
    broken[60:90] = b"\xff" * 30
    rows = [("good", good), ("encrypted", encrypted), ("unknown", unknown), ("broken", broken), ("short", whole[: len(whole) // 2]), ("none", None), ("text", bytearray(b"no archive"))]
    found = packages.expand(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted(r["relpath"] for r in found if r["package"] == "good") == ["abs/y.pdf", "a/b/z.RTF", "x.html"] or {r["relpath"] for r in found if r["package"] == "good"} == {"abs/y.pdf", "a/b/z.RTF", "x.html"}
    errors = {r["package"]: r["error"] for r in found if r["package"] != "good"}
    assert set(errors) == {"encrypted", "unknown", "broken", "short", "none", "text"} and all(errors.values())


def test_pairs_with_nothing_in_them(spark):
    pairs = spark.createDataFrame([(1, "rtf", "html", "a.rtf", "a.html"), (2, "PDF", "Word", "b.pdf", "b.docx")], "pair_id long, source_kind string, target_kind string, source_path string, target_path string")
    texts = spark.createDataFrame([(1, None), (2, "")], "pair_id long, text string")
    none = spark.createDataFrame([], f"pair_id long, tokens array<{checks.align.TOKEN_TYPE}>")
    some = none.unionAll(spark.createDataFrame([(2,)], "pair_id long").select("pair_id", F.array(checks._token(F.lit("lost"), F.lit(1), F.lit(False), F.lit(0))).alias("tokens")))
    pages = spark.createDataFrame([(1, None), (2, "")], "pair_id long, html string")
    found = checks.run_checks(checks.Inputs(pairs, texts, some, pages)).collect()
    assert [(r["pair_id"], r["category"], r["expected"]) for r in found] == [(2, "Missing Text", "lost")]
