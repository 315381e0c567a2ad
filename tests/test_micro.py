"""Hand-derived cases of the small rules."""

from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.functions.language import detect_language
from galleyproof.operators import align, classify, dom, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.tokens(tx.norm_scan(F.lit("It’s long–term, 50% • ok")))) == ["It's", "long-term", ",", "50", "%", "ok"]
    assert one(spark, tx.tokens(F.lit("X‑rays"))) == ["X", "‑", "rays"]


def test_norms(spark):
    assert [one(spark, tx.norm_compare(F.lit(t))) for t in ("أحمد", "كتاب", "؟")] == ["احمد", "کتاب", "?"]
    assert one(spark, tx.norm_text(F.lit("Title."))) == "title"
    assert one(spark, tx.norm_compare(F.lit(None).cast("string"))) == ""


def test_boilerplate_lines(spark):
    lines = ["", "42", "1.", "Page 3", "Body text"]
    assert [one(spark, tx.is_boilerplate_line(F.lit(x))) for x in lines] == [True, True, True, True, False]


def test_languages(spark):
    assert one(spark, detect_language(F.lit(""))) == "French"
    assert one(spark, detect_language(F.lit("پچگک" * 6))) == "Urdu"
    assert one(spark, detect_language(F.lit("привет мир " * 5))) == "Russian"


def test_hyphens(spark):
    merged = align.merge_hyphens(F.split(F.lit("a - b - c"), " "))
    assert one(spark, merged) == ["a-b", "-", "c"]
    assert one(spark, tx.hyphen_noise(F.lit("mini - stroke"), F.lit("mini-stroke"))) is True
    assert one(spark, tx.hyphen_noise(F.lit("mini stroke"), F.lit("mini-stroke"))) is False


def test_tag_stack(spark):
    def found(html):
        return [(i["category"], i["tag"]) for i in one(spark, tags.stack_issues(tags.tag_events(F.lit(html))))]

    assert found("<p><strong>T</p></strong>") == [("Tag Nesting Mismatch", "strong"), ("Unexpected Closing Tag", "strong")]
    assert found("<ul><li>x</ul>") == [("Tag Nesting Mismatch", "li")]
    assert found("<br></br><p/>") == []
    assert found("<script>var t = '</p>';</script><!-- <b> -->") == []


def test_severities(spark):
    cases = {"Garbled / Encoding Error": "Critical", "Leftover Placeholder": "Critical", "Image Order Mismatch": "Minor", "Broken Link": "Major"}
    assert {c: one(spark, classify.severity(F.lit(c), F.lit("error"))) for c in cases} == cases
    of = lambda *n: one(spark, classify.file_severity(*map(F.lit, n)))
    assert [of(0, 5, 0), of(0, 1, 0), of(0, 0, 8), of(0, 0, 1), of(0, 0, 0)] == ["Critical", "Major", "Major", "Minor", "Passed"]


def test_keys_and_cells(spark):
    assert one(spark, tx.pair_key(F.lit("Urdu/ab/Doc 1.rtf"), "rtf")) == "urduabdoc1"
    assert one(spark, tx.pair_key(F.lit("Urdu/ab/Doc 1.rtf"))) == "doc1"
    assert one(spark, tx.safe_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, tx.inline_style(F.lit("Padding-Left: 23PT; x; a:b:c"))) == {"padding-left": "23pt", "a": "b:c"}


def test_alignment(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a c"), (2, "a ,", "a"), (3, "Body", "boDy"), (4, "x y", "x z")], "pair_id long, source_text string, target_text string")
    found = {(r["pair_id"], r["category"], r["expected"], r["actual"]) for r in align.text_issues(pairs).collect()}
    assert found == {(1, "Missing Text", "b", ""), (2, "Missing Punctuation", ",", ""), (4, "Changed Text", "y", "z")}


def test_alignment_of_pages(spark):
    def tokens(*pages):
        made = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")
        return align.page_tokens(dom.visible_text(dom.nodes(made)))

    sources = tokens("<p><b>Big</b> word</p>", "<h2>T</h2>", "<p>a</p>", "<p>mini - stroke b</p>", "<p>Body</p>")
    targets = tokens("<p>Big word</p>", "<p>T</p>", "<div>a</div>", "<p>mini-stroke\n</p>\n<p>c</p>", "<p>boDy</p>")
    found = {(r["pair_id"], r["category"], r["line"], r["expected"], r["actual"]) for r in align.token_issues(sources, targets).collect()}
    assert found == {(0, "Missing Strong/Bold Tag", 1, "strong/b or font-weight:bold", "p"), (1, "Missing Heading Tag", 1, "h2", "p"), (2, "Missing Paragraph/List Tag", 1, "p/li/h1-h6/td/th/figcaption", "div"), (3, "Changed Text", 3, "b", "c")}
    loud = align.token_issues(sources, targets, emit_capitalization=True).where("category = 'Capitalization Mismatch'")
    assert [(r["expected"], r["actual"]) for r in loud.collect()] == [("Body", "boDy")]
