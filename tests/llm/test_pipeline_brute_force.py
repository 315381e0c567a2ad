"""Each stage of the pipeline, and run() as a whole, against plain Python on the small table."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from galleyproof.llm import secrets, tokens

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def statistics(text):
    data, words = text.encode(), words_of(text)
    n, m, distinct = len(data), len(words), len(set(words))
    count = lambda chars: sum(data.count(c) for c in chars.encode())
    rate = lambda x, of: np.log((x + 0.5) / (of + 1.0))
    share = np.array(list(Counter(data).values()), float) / max(n, 1)
    upper, lower = (sum(chr(b) in s for b in data) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    marks = [rate(count(c), n) for c in ("#$%&*@^~<>=+\\_{}[]`", "|", "!", "0123456789", ".,;:?")]
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    return [np.log1p(n), np.log((upper + 0.5) / (lower + 0.5)), *marks, rate(repeated, m), np.log((distinct + 0.5) / (m - distinct + 0.5)), np.log1p((n - m) / (m + 1)), rate(count("\n"), n), -(share * np.log(share)).sum()]


def good(texts, labels):
    x = {k: np.array(statistics(t)) for k, t in texts.items()}
    own = [np.array([x[k] for k, y in labels.items() if y == c and k in x and zlib.crc32(str(k).encode()) % 5]) for c in (0, 1)]
    covs, sizes = [np.cov(o.T, bias=True) for o in own], [len(o) for o in own]
    pooled = sum(n * c for n, c in zip(sizes, covs)) / sum(sizes)
    covs = [0.8 * c + 0.15 * pooled + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(12) for c in covs]
    density = lambda v, c: -0.5 * (v - own[c].mean(0)) @ np.linalg.inv(covs[c]) @ (v - own[c].mean(0)) - 0.5 * np.linalg.slogdet(covs[c])[1]
    return {k for k, v in x.items() if density(v, 1) - density(v, 0) + np.log(sizes[1] / sizes[0]) >= np.log(0.3 / 0.7)}


def distinct(texts):
    sets = {}
    for k, t in texts.items():
        w = words_of(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {k for k, r in root.items() if k == r}


def clean(texts, items):
    """Documents no passage of which is within a quarter of an item's words as edits."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [w for w in map(split, items) if len(w) >= 3]
    ids = {w: i for i, w in enumerate(sorted({w for item in items for w in item}))}
    sizes = np.array([len(i) for i in items])
    table = np.full((len(items), sizes.max()), -1)
    for row, item in zip(table, items):
        row[: len(item)] = [ids[w] for w in item]
    steps, rows, kept = np.arange(sizes.max() + 1), np.arange(len(items)), set()
    for k, t in texts.items():
        row = np.tile(steps, (len(items), 1))
        best = row[rows, sizes]
        for w in split(t):
            after = np.minimum(row + 1, 10**6)
            after[:, 0] = 0
            after[:, 1:] = np.minimum(after[:, 1:], row[:, :-1] + (table != ids.get(w, -2)))
            row = np.minimum.accumulate(after - steps, axis=1) + steps
            best = np.minimum(best, row[rows, sizes])
        if not (best <= sizes // 4).any():
            kept.add(k)
    return kept


def redacted(text, named):
    """Base kinds by their patterns; ``named``: the spans found, of which only the random ones are taken."""
    spans = [m.span() for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [m.span() for p, n in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)) for m in re.finditer(p, text) if len(m[0]) >= n]
    spans += [tuple(map(int, s.split(":")[1:])) for s in named.split(",") if s.startswith("random:")]
    out, at = [], 0
    for a, z in sorted(spans):
        if z > at:
            out += [text[at:a], "[SECRET]"] if a >= at else []
            at = z
    return "".join([*out, text[at:]])


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in read("labels").collect()}
    want = [good(texts, labels)]
    want.append(distinct({k: texts[k] for k in want[-1]}))
    want.append(clean({k: texts[k] for k in want[-1]}, [r["text"] for r in read("benchmark").collect()]))
    assert len(texts) > len(want[0]) > len(want[1]) > len(want[2]) > 0
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:3], want):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(kept), name
    named = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    masked = {k: redacted(texts[k], named[k]) for k in want[-1]}
    assert {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()} == masked
    tokenizer, packed = Tokenizer.from_file(tokens.tokenizer_path()), {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(packed.get(r["doc_id"], b"")) == 4 * r["start"] and len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 2048
        packed[r["doc_id"]] = packed.get(r["doc_id"], b"") + bytes(r["ids"])
    assert packed == {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for k, t in masked.items()}
