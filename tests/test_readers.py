"""Readers of rich text, word files and glyphs on hand-made cases."""

import io
import zipfile

from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.sources import assets, docx, pdf, rtf

GLYPHS = "doc_id long, page int, idx long, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def glyphs(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x0), float(x1), float(top), float(top) + 10, 10.0, "F") for i, (t, x0, x1, top) in enumerate(rows)], GLYPHS)


def found(words):
    return [r["text"] for r in words.orderBy("line", "word").collect()]


def test_rtf_text():
    assert rtf.plain_text(r"{\rtf1\ansicpg1252 caf\'e9\par \u8217 ?x}", "cp1252") == "café\n’x"
    assert rtf.plain_text(r"{\rtf1{\fonttbl{\f0 Arial;}}a{\*\info b}{\pict 00ff}{\field{\*\fldinst INCLUDEPICTURE x}}c\'zz\~d}", "cp1252") == "ac\u00a0d"
    assert rtf.plain_text(r"{\rtf1\uc2\u1571 \'c7\'c7b\uc0\u-3x}", "cp1252") == "أb\ufffdx"
    assert rtf.plain_text(r"{\rtf1 a\'c7", "cp1256") == "aا"
    assert rtf.plain_text("", "cp1252") == ""
    assert rtf.plain_text("{\\fonttbl a", "cp1252") == ""


def test_rtf_code_pages(spark):
    of = lambda raw, path: one(spark, rtf.codepage(F.lit(raw), F.lit(path)))
    assert [of(r"\ansicpg1252\lang1065 ", "a.rtf"), of(r"\ansicpg1252", "a_UR.rtf"), of(r"\ansicpg1250", "a.rtf"), of(r"\ansicpg99999", "a.rtf"), of("", "a.rtf"), of(r"\lang1033", None)] == ["cp1256", "cp1256", "cp1250", "cp1252", "cp1252", "cp1252"]


def test_rtf_references(spark):
    raw = 'INCLUDEPICTURE "a b\\\\c.png" {includepicture d.png}'
    assert one(spark, rtf.image_references(F.lit(raw))) == ["a b//c.png", "d.png"]
    assert one(spark, rtf.image_references(F.lit(None).cast("string"))) == []


def test_rtf_lines_and_pictures(spark):
    png = (b"\x89PNG" + bytes(range(40))).hex()
    files = spark.createDataFrame([(1, "a.rtf", r"{\rtf1 One two\par Page 4\par\par three{\pict\pngblip\picw5 " + png + "}}"), (2, "b.rtf", None), (3, "c.rtf", "")], "doc_id long, path string, raw string")
    assert [(r["doc_id"], r["line"], r["text"]) for r in rtf.lines(files).orderBy("doc_id", "line").collect()] == [(1, 1, "One two"), (1, 2, "three")]
    assert [(r["doc_id"], r["kind"], r["content"][:4]) for r in rtf.embedded_images(files).collect()] == [(1, "png", b"\x89PNG")]


def test_word_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>A&amp;B</w:t></w:r></w:p><w:p/><w:p><w:r><w:rPr><w:b/><w:i w:val="0"/><w:u w:val="single"/></w:rPr><w:t>x</w:t><w:tab/></w:r></w:p>'
    cell = lambda text, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=\"restart\"/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}</w:tr><w:tr>{cell('d', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>')
        z.writestr("word/media/i.png", b"\x89PNGx")
        z.writestr("word/_rels/document.xml.rels", '<R><Relationship Type="http://x/image" Target="media/i.png"/><Relationship Type="http://x/image" Target="http://y" TargetMode="External"/></R>')
    html = docx.to_html(data.getvalue())
    assert "<h1>A&amp;B</h1>\n<p><u><b>x\t</b></u></p>\n<table>" in html
    assert "<tr><td>a</td><td>b</td></tr><tr><td>a</td><td>c</td></tr><tr><td>d</td><td>d</td></tr>" in html
    assert 'src="data:image/png;base64,iVBOR3g="' in html
    assert docx.to_html(None) == docx.to_html(b"junk") == "<html><body></body></html>"


def test_words_by_gaps_and_spaces(spark):
    row = [("a", 0, 5, 0), ("b", 6, 11, 0), (" ", 12, 17, 0), ("c", 18, 23, 0), ("d", 30, 35, 0), ("e", 0, 5, 20)]
    assert found(pdf.words(glyphs(spark, row))) == ["ab", "c", "d", "e"]


def test_words_parted_at_a_hyphen_are_one(spark):
    at = lambda word, x, top=0: [(c, x + 6 * i, x + 6 * i + 5, top) for i, c in enumerate(word)]
    row = at("aa", 0) + at("bb", 30) + at("cc", 60) + at("mini", 90) + [(" ", 114, 114.2, 0)] + at("-", 114.5) + [(" ", 119.6, 119.7, 0)] + at("stroke", 120)
    assert found(pdf.words(glyphs(spark, row))) == ["aa", "bb", "cc", "mini-stroke"]


def test_right_to_left_lines(spark):
    # Drawn in reverse reading order, with the mark before its base and a Latin run in its own order.
    row = [("ب", 0, 5, 0), ("ا", 6, 11, 0), ("ت", 12, 17, 0), ("ك", 18, 23, 0), (" ", 24, 29, 0), ("A", 30, 35, 0), ("1", 36, 41, 0), (" ", 42, 47, 0), ("ّ", 90, 91, 3), ("م", 48, 53, 0), ("ل", 54, 59, 0), ("ق", 60, 65, 0)]
    words = found(pdf.words(glyphs(spark, row)))
    assert words[0] == "قلمّ" and words[-1] == "كتاب" and "A1" in words


def test_tokens_of_pages(spark):
    g = glyphs(spark, [("H", 0, 5, 0), ("x", 0, 5, 20), ("y", 6, 11, 20), ("9", 0, 5, 40)]).withColumn("size", F.when(F.col("top") == 0, 16.0).otherwise(10.0))
    lines = spark.createDataFrame([(1, 0, 40.0, 50.0, "9")], "doc_id long, page int, top double, bottom double, text string")
    assert [(r["text"], r["heading_level"]) for r in pdf.tokens(g, lines).orderBy("line").collect()] == [("H", 1), ("xy", 0)]


def test_turning_lines(spark):
    assert one(spark, tx.rtl_fix_line(F.lit("ملق باتك 2025 x"))) == "كتاب قلم 2025 x"
    assert one(spark, tx.rtl_fix_line(F.lit("latin اب text"))) == "latin اب text"


def test_inline_data(spark):
    of = lambda s: one(spark, assets.inline_data(F.lit(s)))
    assert [of("data:image/png;base64,aGVsbG8"), of("DATA:image/svg+xml,%3Ca+b%3E"), of("x.png"), of("data:image/png")] == [b"hello", b"<a+b>", None, None]
