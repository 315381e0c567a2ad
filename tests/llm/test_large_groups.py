"""Groups of any size: large bands, hubs and hot keys, against brute force."""

import numpy as np
import pytest

from galleyproof.llm import near_dup
from galleyproof.llm.common import join_salted
from galleyproof.llm.graph import components

from test_text_operators import shingle_sets


def brute_force(sets):
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.fixture(scope="module")
def alike():
    """90 documents of one template, near to the threshold on both sides, and some copies with few edits."""
    rng = np.random.default_rng(7)
    stock = [f"stock{i}" for i in range(120)]
    rows = {}
    for k in range(90):
        rows[k] = " ".join(stock + [f"own{k}x{i}" for i in range(int(rng.integers(14, 60)))])
    for k in range(90, 120):
        words = rows[int(rng.integers(0, 60))].split()
        words[int(rng.integers(0, len(words)))] = f"edit{k}"
        rows[k] = " ".join(words)
    rows[200], rows[201] = "one two", "one two"
    return rows


def test_band_size_changes_nothing(spark, alike):
    docs = spark.createDataFrame(list(alike.items()), "doc_id long, text string")
    want = brute_force(shingle_sets(alike))
    assert len(set(want.values())) not in (1, len(want))
    for large in (2, 2000):
        found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, large_band=large).collect()}
        assert found == want, large


def test_common_text_proposes_few_pairs(spark):
    stock = " ".join(f"stock{i}" for i in range(90))
    texts = {k: f"{stock} " + " ".join(f"own{k}x{i}" for i in range(30)) for k in range(600)}
    texts |= {k: texts[k - 600] + " more" for k in range(600, 603)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    places = docs.select(docs.doc_id.alias("node"), docs.doc_id.alias("component"))
    pairs = {(r["u"], r["v"]) for r in near_dup._pairs_by_rare_shingles(places, docs, 0.75).collect()}
    assert pairs == {(0, 600), (1, 601), (2, 602)}


def test_one_id_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "quite other words in this one"), (1, text), (2, text + " more"), (3, "alone")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_recall_at_the_threshold():
    """Pairs of sets at exactly 0.75: nearly all share a band, and the sketch rejects none."""
    rng = np.random.default_rng(5)
    missed = rejected = 0
    n = 1500
    for _ in range(n):
        part = int(rng.integers(1, 60))  # 6 part common, part of each alone
        values = np.unique(rng.integers(0, 2**63, 8 * part).astype(np.uint64))
        common, left, right = values[: 6 * part], values[6 * part : 7 * part], values[7 * part :]
        sets = [np.sort(np.concatenate([common, x])) for x in (left, right)]
        bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        samples = near_dup.minhash(np.concatenate(sets), bounds, near_dup.BANDS * near_dup.ROWS)
        keys = near_dup.band_keys(samples)
        missed += not (keys[0] == keys[1]).any()
        sketch = near_dup.odd_sketch(samples).view(np.uint64)
        filled = min(2 * sum(int(x).bit_count() for x in sketch[0] ^ sketch[1]) / near_dup.SKETCH_BITS, 0.999)
        rejected += 1 + near_dup.SKETCH_BITS / (4 * near_dup.BANDS * near_dup.ROWS) * np.log(1 - filled) < 0.75 - near_dup.SKETCH_SLACK
    assert missed <= n // 500 and rejected <= n // 500


def test_hubs_and_hot_keys(spark):
    edges = spark.createDataFrame([(5000, i) for i in range(11000)] + [(7, 19000), (19001, 19000), (3, 3)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert len(found) == 11002 and set(found.values()) == {0}
    rows = spark.createDataFrame([(1, i) for i in range(2500)] + [(2, 0)], "k long, v long")
    others = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, w string")
    joined = join_salted(rows, others, "k", "v", least=1000).collect()
    assert len(joined) == len({(r["k"], r["v"], r["w"]) for r in joined}) == 5001
