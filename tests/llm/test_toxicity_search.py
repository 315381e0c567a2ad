"""The search for nearest examples against brute force, and how many entries it scores; words and terms against their definition."""

from collections import Counter

import numpy as np

from galleyproof.llm import toxicity


class Looked(np.ndarray):
    """A table that notes how many rows are taken from it at a time."""

    rows: list[int] = []

    def take(self, at, *args, **kwargs):
        Looked.rows.append(len(at))
        return np.asarray(self).take(at, *args, **kwargs)


def units_of(rng, n, terms, factors):
    """Texts of some frequent and many rarer terms: (ids, weights)."""
    out = []
    for _ in range(n):
        often = 1 / np.arange(20, 4116)
        ids = np.unique(np.concatenate([rng.choice(4096, 80, replace=False, p=often / often.sum()), rng.integers(4096, terms, 5)]))
        weight = (1 + np.log(rng.integers(1, 5, len(ids)))) * factors[ids]
        out.append((ids, weight / np.sqrt((weight * weight).sum())))
    return out


def test_search_is_exact_and_scores_few_entries():
    rng = np.random.default_rng(7)
    terms, k = 6000, 15
    factors = 0.5 + rng.random(terms)
    units = units_of(rng, 1500, terms, factors)
    index = toxicity.BlockMaxIndex.of_units(factors, [(u, (1.0, 0.0, i)) for i, u in enumerate(units)])
    index.prepare()
    index.light, Looked.rows = index.light.view(Looked), []
    asked = units_of(rng, 150, terms, factors)
    found = index.nearest_of_all(np.repeat(np.arange(150), [len(i) for i, _ in asked]), np.concatenate([i for i, _ in asked]), np.concatenate([w for _, w in asked]), 150, k)
    dense = np.zeros((1500, terms))
    for i, (ids, weight) in enumerate(units):
        dense[i, ids] = weight.astype(np.float32)
    for (ids, weight), near in zip(asked, found, strict=True):
        cosine = dense[:, ids] @ weight
        assert np.allclose([c for c, _ in near], np.sort(cosine)[::-1][:k], atol=1e-6)
        assert np.allclose(cosine[index.example[[e for _, e in near]]], [c for c, _ in near], atol=1e-6)
    assert len(Looked.rows) == 150
    assert np.mean(Looked.rows) < 500  # with one norm for all light terms instead of one a group, all 1500


def test_words_are_runs_of_letters():
    every = "".join(chr(i) + "aB" for i in range(256))
    for text in ("", every, every[::-1], "It's ÀÉß naïve_2x ²µ½ ª", "Ünder İ Łódź ΣΣ 中文 7th " + every):
        assert toxicity.words_of(text) == Counter(toxicity._WORD.findall(text.lower()))


def test_terms_are_counted_by_their_definition():
    vocabulary = sorted({t for w in ("cat", "cats", "catsy", "catsup", "catsups", "dog", "dogma", "dogmatic", "ab", "élan") for t in toxicity.terms_of(w)})
    vectors = toxicity.Vectors({t: i for i, t in enumerate(vocabulary)}, np.ones(len(vocabulary)))
    texts = ["cat cats CATS catsy catsup", "catsups catsupped dogmas dogmatics dogmatic", "", "none of these 12", "élan élans dog do ab abc", "catsy dogfish catsuits"]
    for _ in range(2):  # words not met before, and met
        text, term, times = vectors.counts_of_all(texts)
        found = [Counter({vocabulary[t]: int(n) for x, t, n in zip(text, term, times, strict=True) if x == k}) for k in range(len(texts))]
        assert found == [Counter(t for w in toxicity._WORD.findall(x.lower()) for t in toxicity.terms_of(w) if t in vectors.index) for x in texts]
        assert sorted(zip(text, term, strict=True)) == list(zip(text, term, strict=True))
