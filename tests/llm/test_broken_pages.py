"""Pages with open quotes, marked paragraphs and many kinds of blocks, and very long ones."""

from galleyproof.llm.html_text import main_text


def test_open_quotes_are_no_text():
    assert main_text('<p>He said <a title="x>no</a> more, and so on.</p>') == "He said no more, and so on."
    assert main_text("<p>First, of some length.</p><p class='x>Second, of some length.</p>") == "First, of some length.\n\nSecond, of some length."


def test_marked_paragraphs():
    body = "".join(f"<p>Paragraph {i}, of some length.</p>" for i in range(4))
    page = f'<article>{body}<p class="advert">Buy this, it is cheap.</p></article>'
    assert main_text(page) == "\n\n".join(f"Paragraph {i}, of some length." for i in range(4))


def test_all_kinds_of_blocks_stay():
    parts = "".join(f"<p>{'A long paragraph, with many words in it. ' * 9}</p>" for _ in range(4))
    page = f"<body><article><h1>Bread</h1>{parts}<ul><li>salt</li><li>flour</li></ul><table><caption>Facts</caption><tr><th>Vegan</th><td>Yes</td></tr></table><figure><figcaption>A loaf</figcaption></figure><pre>mix  it</pre><h2>End</h2></article></body>"
    assert main_text(page).split("\n\n")[5:] == ["salt", "flour", "Facts", "Vegan", "Yes", "A loaf", "mix it", "End"]


def test_long_pages():
    page = "<article>" + "<p>Some words, here.</p>" * 20_000 + "</article>"
    assert main_text(page).count("Some words") == 20_000
