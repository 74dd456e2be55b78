import numpy as np
import pyarrow as pa

from ctrkit.llm import langid
from ctrkit.llm.queries import op5_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op5_language(spark, sf).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.98


def brute_grams(word):
    raw = b"\n" + word.encode() + b"\n"
    return sum(max(0, len(raw) - n + 1) for n in langid.GRAMS)


def test_grams_of_each_word_stay_within_it():
    words = ["a", "straße", "über", "x1"]
    feature, owner = langid.word_grams(words)
    for i, w in enumerate(words):
        # The sign before a word belongs to the word before it, or to the word itself at the start.
        alone = np.sort(langid.word_grams([w])[0])
        inside = np.sort(feature[owner == i])
        assert len(inside) >= brute_grams(w) - len(langid.GRAMS)
        assert i or (alone == inside).all()


def test_weights_by_word_equal_the_matrix():
    texts = ["der Hund und die Katze", "the dog, and the cat!", "", "und"]
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(langid.DIMENSIONS, 3))
    words, index, offsets = langid.word_index(pa.array(texts))
    n = np.maximum(np.diff(offsets), 1)[:, None]
    got = langid.sums(langid.per_word(words, weights)[index], offsets) / n
    assert np.allclose(got, langid.matrix(texts) @ weights, atol=1e-4)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0, 0, 1] + 0.3 > 0, 1, -1)
    w = langid.machine(x, y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.95


def test_families():
    assert langid.family_of("de") == langid.family_of("en-GB") == "germanic"
    assert langid.family_of("xx") == "other"


def test_edge_rows(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("lang", edge_docs.id)
    model = langid.train(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {5, 3, 9}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(no_docs, langid.train(no_docs)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(no_docs)).collect()} == {"und"}
