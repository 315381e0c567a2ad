"""A benchmark that is joined by key gives what one that is sent to the tasks gives."""

import random

import pytest

from galleyproof.llm import decontaminate

SCHEMA = "doc_id long, item_id long, distance int, item_words int, start long, end long"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: text(rnd.choice((1, 2, 3, 5, 12, 20, 45))) for i in range(60)}
    items[60] = list(items[12])  # equal words, another id
    docs = []
    for d in range(300):
        words = text(rnd.randint(0, 150))
        if d % 3:
            passage = list(items[rnd.randrange(60)])
            if len(passage) > 10 and d % 2:
                for _ in range(len(passage) // 8):
                    passage[rnd.randrange(len(passage))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        docs.append((d, ", ".join(words)))
    docs += [(1000, None), (1001, ""), (None, " ".join(items[12])), (5, docs[5][1]), (6, "other text of the same id " + " ".join(items[6]))]
    docs.append((2000, " | ".join(" ".join(w) for w in items.values())))  # a document that is the benchmark
    table = [(i, " ".join(w).upper()) for i, w in items.items()] + [(None, "no id here at all"), (90, None), (91, ""), (92, "..."), (3, " ".join(items[3]))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(table, "item_id long, text string")


def test_same_matches(corpus, monkeypatch):
    docs, items = corpus
    small = _rows(decontaminate.leaks(docs, items))
    assert len(small) > 200 and any(r[2] for r in small)
    monkeypatch.setattr(decontaminate, "SMALL_ITEMS", 0)
    large = _rows(decontaminate.leaks(docs, items))
    assert large == small
    # bit tables with a few bits only: all windows pass, nothing is lost
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 10)
    assert _rows(decontaminate.leaks(docs, items)) == small


def test_nothing_there(corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(decontaminate, "SMALL_ITEMS", -1)
    assert _rows(decontaminate.leaks(docs, items.where("false"))) == []
    assert _rows(decontaminate.leaks(docs.where("false"), items)) == []
    assert decontaminate.leaks(docs, items).schema.simpleString() == decontaminate.leaks(docs, items.limit(2)).schema.simpleString()


@pytest.mark.parametrize("edited", [5, 10, 15, 20])
def test_recall_of_edited_copies(spark, edited):
    """Copies with this percentage of their words inserted, deleted or replaced, between other words."""
    rnd = random.Random(edited)
    vocabulary = ["".join(rnd.choice("abcdefgilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    items = {i: [rnd.choice(vocabulary) for _ in range(rnd.randint(12, 60))] for i in range(100)}
    docs = []
    for d in range(500):
        copy = list(items[d % 100])
        for _ in range(len(copy) * edited // 100):
            at, what = rnd.randrange(len(copy)), rnd.choice(("insert", "delete", "replace"))
            copy[at : at + (what != "insert")] = [] if what == "delete" else [rnd.choice(vocabulary)]
        around = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))] for _ in range(2)]
        docs.append((d, " ".join(around[0] + copy + around[1])))
    docs += [(1000 + d, " ".join(rnd.choice(vocabulary) for _ in range(150))) for d in range(100)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert sum((d, d % 100) in found for d in range(500)) >= 495
    assert not any(d >= 1000 for d, _ in found)
