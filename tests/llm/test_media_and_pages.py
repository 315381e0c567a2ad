"""GIFs: exact round trips and the rules of composition. Pages: main text of different layouts."""

import struct

import numpy as np
import pytest

from galleyproof.llm import gif, html_text


def test_round_trips():
    rng = np.random.default_rng(0)
    for rows in (1, 2, 700, 2500):
        for data in (rng.integers(0, 256, rows * 192).astype(np.uint8).tobytes(), b"ab" * 96 * rows, bytes(192 * rows)):
            assert b"".join(gif.read_samples(gif.decode_gif(gif.store(data)))) == data


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw(bits):
    rng = np.random.default_rng(bits)
    data = rng.integers(0, 1 << bits, 9000).astype(np.uint8)
    assert (gif.lzw_decode(gif.lzw_encode(data.tobytes(), bits), bits, len(data)) == data).all()
    with pytest.raises(ValueError):
        gif.lzw_decode(gif.lzw_encode(data.tobytes(), bits), bits, len(data) + 1)


def picture(*frames):
    """A 2 x 2 GIF; frames: (box, indices, disposal, clear index or None, interlaced)."""
    out = [b"GIF89a", struct.pack("<HHBBB", 2, 2, 0x81, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for (left, top, w, h), index, disposal, clear, laced in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * laced) + b"\x02" + gif._sub_blocks(gif.lzw_encode(bytes(index), 2)))
    return b"".join([*out, b"\x3b"])


def test_composition():
    whole = (0, 0, 2, 2)
    frames = list(gif.decode_gif(picture((whole, [1, 1, 1, 1], 1, None, 0), ((0, 0, 1, 1), [2], 2, None, 0), (whole, [0, 3, 0, 0], 3, 0, 0), (whole, [0, 0, 0, 2], 0, 0, 0))))
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert [f.pixels.reshape(4, 3).tolist() for f in frames] == [[red] * 4, [green, red, red, red], [none, blue, red, red], [none, red, red, green]]
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 50), (50, 50), (100, 50), (150, 50)]
    assert frames[2].covered.tolist() == [[False, True], [True, True]] and frames[2].histogram().sum() == 3
    laced = next(gif.decode_gif(picture(((0, 0, 1, 2), [1, 2], 0, None, 1))))
    assert laced.pixels[:, 0].tolist() == [red, green]


def test_media_table(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in gif.media_table(docs).collect()}
    assert [rows[i]["payload_bytes"] for i in (1, 2, 3, 4)] == [192, 192, 192, 384] and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    frames = gif.gif_frames(spark.createDataFrame([(1, bytearray(rows[4]["media"])), (2, bytearray(b"GIF89a no")), (3, None)], "doc_id long, media binary")).collect()
    assert sorted((f["id"], f["frame"], f["error"] is not None) for f in frames) == [(1, 0, False), (2, None, True)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="content"><h2>On &amp;c.</h2><p>First   paragraph, with <b>bold</b> text.<p>Second&nbsp;one; it has <a href="#">a link</a>, too.
<form><p>Name</p><input></form><ul><li>An item, listed.<li>Another item.</ul></div><aside><p>Related things, of no use.</p></aside>
<div class="comments"><p>I disagree, strongly.</p></div><div class="cookie-notice">We use cookies.</div><script>var t="</p>";</script><footer>&copy; 2020</footer></body>"""


def test_main_text():
    want = "On &c.\n\nFirst paragraph, with bold text.\n\nSecond one; it has a link, too.\n\nAn item, listed.\n\nAnother item."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("just text") == "just text"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE)], "page_id long, url string, html string")
    rows = html_text.extract(pages.selectExpr("*", "'x' as text", "1 as row")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows)[:2] == [(1, 0), (2, 0)] and len(rows) == 4
    assert html_text.extract(pages.where("false")).count() == 0
