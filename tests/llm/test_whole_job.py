"""Cases that cuts would lose: whole vocabularies, all examples, short repeats, long and short blocks, rows without id."""

import corpus_pipeline
import pytest

from galleyproof.llm import html_text, near_dup, repeats, toxicity


@pytest.fixture(scope="module")
def examples(spark):
    """Labelled texts of their own words each; 100 to 103 are toxic."""
    clean = [(i, f"quiet{'abcdefghijklmnopqrst'[i]} gentle{'abcdefghijklmnopqrst'[i]} words", 0) for i in range(20)]
    toxic = [(100 + i, f"{a} {b} words", 1) for i, (a, b) in enumerate([("vile", "nasty"), ("rotten", "foul"), ("cruel", "mean"), ("dumb", "silly")])]
    rows = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    return rows.select("doc_id", "text"), rows.select("doc_id", "toxic")


def test_rare_words_are_terms(spark, examples):
    docs, labels = examples
    asked = spark.createDataFrame([(500, "so rotten"), (501, "gentlec things"), (502, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.scores(docs.unionAll(asked), labels).collect()}
    assert len(found) == 27 and found[500]["evidence"][:1] == [101] and found[501]["evidence"][:1] == [2]
    assert found[500]["score"] > 0.5 > found[501]["score"] and found[502]["evidence"] == []


def test_examples_that_begin_or_end_alike_all_count(spark, examples):
    docs, labels = examples
    opening, closing = "one two three four five six", "seven eight nine ten eleven twelve"
    more = [(200, f"{opening} ghastly wretch"), (201, f"{opening} horrid beast"), (202, f"loathsome creature {closing}"), (203, f"vicious brute {closing}"), (204, f"vicious brute {closing}")]
    texts = docs.unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    marks = labels.unionAll(spark.createDataFrame([(i, 1) for i, _ in more], "doc_id long, toxic int"))
    model = toxicity.learn(texts, marks)
    votes = {int(e): tuple(v) for e, v in zip(model.index.example, model.index.votes, strict=True)}
    assert len(votes) == 28 and votes[203] == (0.0, 2.0) and 204 not in votes
    assert [model.classify(t)[1][0] for _, t in more] == [200, 201, 202, 203, 203]


def test_short_repeats_are_reported(spark):
    texts = {1: "Own start.\nA short line here\nOwn end one.", 2: "Other start. So it is. a  SHORT line here", 3: "So it is. So it is.\nMore"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = sorted((s["doc_id"], texts[s["doc_id"]][s["start"] : s["end"]], s["n_words"], s["first_doc_id"]) for s in repeats.repeated_spans(docs).collect())
    assert found == [(2, "a  SHORT line here", 4, 1), (3, "So it is. So it is.", 6, 2)]
    assert {s["doc_id"] for s in repeats.repeated_spans(docs, min_words=5).collect()} == {3}


def test_long_blocks_do_not_displace_the_others():
    parts = [f"Word, and more of it {'x' * 560} {i}." for i in range(16)]
    quote = "Quoted text, long. " * 1000
    items, cells = [f"Item number {i} of a list" for i in range(8)], [f"cell no {i:04d}" for i in range(20)]
    tags = "".join(f"<p>{t}</p>" for t in parts) + f"<blockquote><p>{quote}</p></blockquote><ul>" + "".join(f"<li>{t}</li>" for t in items)
    tags += "</ul><table><tr>" + "".join(f"<td>{t}</td>" for t in cells) + "</tr></table>"
    for name in ("article", "div"):
        text = html_text.main_text(f"<body><{name}>{tags}</{name}><div><a href=/>Elsewhere</a></div></body>")
        assert text.split("\n\n") == [*parts, quote.strip(), *items, *cells]


def test_marks_do_not_drop_the_article():
    body = "<h2>Title</h2><p>The first paragraph, of some length.</p><p>The second one, of some length as well.</p>"
    want = "Title\n\nThe first paragraph, of some length.\n\nThe second one, of some length as well."
    for opening in ('<div class="layout has-sidebar">', '<div id="content-sidebar-wrap">', '<section class="legal">', "<div class=no-comments>"):
        for inner in (body, f"<article>{body}</article>", f"<main><article>{body}</article></main>"):
            close = "</section>" if "section" in opening else "</div>"
            page = f'<body><div>Top line</div>{opening}{inner}<div class="sidebar"><p>Other things, of no use.</p></div>{close}</body>'
            assert html_text.main_text(page).removeprefix("Top line\n\n") == want
    links = '<p>See <a href="/hidden-valley">the valley</a> there, it is fine.</p><p title="a hidden gem">A gem of a place, really.</p><p data-hidden="false">Plain text, in sight.</p>'
    assert html_text.main_text(links) == "See the valley there, it is fine.\n\nA gem of a place, really.\n\nPlain text, in sight."
    comments = f'<body><article>{body}</article><div class="comments"><article><p>{"I disagree, strongly. " * 3}</p></article></div></body>'
    assert html_text.main_text(comments) == want and html_text.main_text(f"<div hidden>{body}") == ""


def test_rows_without_id_are_decided(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_clean(spark, corpus_pipeline.keep_good(spark, docs, sf), sf).select("doc_id").collect()}
    fine = next(k for k in sorted(label) if label[k] and k in kept)
    poor = next(k for k in sorted(label) if not label[k] and k not in kept)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    bare = docs.where(f"doc_id in ({fine}, {poor})").selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    leaky = docs.where(f"doc_id = {fine}").selectExpr("cast(null as long) as doc_id", f"concat(text, '\\n', '{item}') as text", *docs.columns[2:])
    rows = docs.unionAll(bare).unionAll(leaky)
    found = near_dup.near_duplicates(rows.where("doc_id is null")).collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in found] == [(None, None, True)] * 3
    assert corpus_pipeline.keep_good(spark, rows, sf).where("doc_id is null").count() == 2
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, sf)
    texts = [r["text"] for r in rows.where("doc_id is null").collect()]
    assert texts == [r["text"] for r in docs.where(f"doc_id = {fine}").collect()]
