import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ctrkit.llm import substrings


def brute(rows, window):
    """Every window against every earlier one; rows in any order."""
    seen, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    words = [(t or "").encode().split() for _, t in rows]
    places = {}
    for i in order:
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s:s + window])
            places.setdefault(key, (rows[i][0], s))
            places[key] = min(places[key], (rows[i][0], s))
    for i in order:
        for s in range(len(words[i]) - window + 1):
            if places[tuple(words[i][s:s + window])] < (rows[i][0], s):
                gone[i] |= set(range(s, s + window))
    out = []
    for (doc, _), w, g in zip(rows, words, gone):
        kept = b" ".join(x for j, x in enumerate(w) if j not in g)
        out.append((doc, len(w), len(g), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_against_all_windows(request, source):
    docs = request.getfixturevalue(source).where("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(substrings.dedup(docs)) == brute(rows, 20)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet_with_planted_passages(spark, seed):
    """Few words, so that anchors repeat, segments differ and windows overlap within documents."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcde") for _ in range(rng.randint(5, 40))] for _ in range(4)]
    rows = []
    for doc in rng.sample(range(-5, 1000), 60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcde") for _ in range(rng.randint(1, 25))]
        rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window, gram in ((20, 6), (8, 3)):
        assert result(substrings.dedup(docs, window, gram)) == brute(rows, window)


def test_null_ids_are_least_and_keep_their_rows(edge_docs):
    rows = substrings.dedup(edge_docs).collect()
    assert len(rows) == edge_docs.count() and [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_hashes_of_stretches():
    words = pa.array("a b c a b c d".split())
    h = substrings.Hashes(words, substrings.BASES[0])
    at = np.array([0, 3, 1])
    got = h.of(at, at + 3)
    assert got[0] == got[1] != got[2]
