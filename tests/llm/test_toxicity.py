import random

import numpy as np
import pyarrow as pa
import pytest

from ctrkit.llm import toxicity
from ctrkit.llm.queries import op1_toxicity


def auc(scores, labels):
    """Share of (toxic, clean) pairs in the right order, ties half."""
    toxic = [s for s, y in zip(scores, labels) if y]
    clean = [s for s, y in zip(scores, labels) if not y]
    return np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) >= 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.93


@pytest.fixture(scope="module")
def tiny():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(3, 60))
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty"]))
        texts.append(" ".join(text))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def test_back_propagation_against_differences(tiny):
    texts, toxic = tiny
    tokens = toxicity.Tokens(pa.array(texts[:6]))
    net = toxicity.Network(3)
    net.start_from(tokens, np.array(toxic[:6], float), np.arange(6))
    for v in net.p.values():
        v += np.random.default_rng(5).normal(0, 0.05, v.shape).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["embed"][0] = 0
    rows, y = np.arange(6), np.array(toxic[:6], float)

    def loss():
        z = net.forward(tokens, rows)[0]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    z, state = net.forward(tokens, rows)
    g = net.gradients((toxicity.sigmoid(z) - y) / 6, state)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in [int(np.abs(grad).argmax()), *rng.integers(0, flat.size, 3)]:
            if name == "embed" and i < toxicity.DIMENSIONS:
                continue
            at, h = flat[i], 1e-6
            flat[i] = at + h
            up = loss()
            flat[i] = at - h
            down = loss()
            flat[i] = at
            assert grad[i] == pytest.approx((up - down) / 2 / h, abs=1e-4)


def test_scores_do_not_depend_on_the_batch(tiny):
    texts, toxic = tiny
    model = toxicity.Classifier(pa.array(texts), toxic, ["a"] * len(texts), [1.0] * len(texts))
    together = model.scores(pa.array([*texts, "", "vile", "w1"]))
    alone = [float(model.scores(pa.array([t]))[0]) for t in [*texts, "", "vile", "w1"]]
    assert together == pytest.approx(alone, abs=1e-5)
    assert auc(together[:len(texts)], toxic) > 0.98
    assert model.scores(pa.array(["w5 w9 vile w3 " * 2000]))[0] >= 0.5 > together[len(texts)]


def test_threshold_is_amid_the_best_cuts():
    assert toxicity.threshold(np.array([0.0, 1, 4, 5]), np.array([0.0, 0, 1, 1]), np.ones(4)) == 2.5


def test_edge_tables(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(7, 0), (8, 1), (8, 1), (5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    docs = edge_docs.withColumn("lang", edge_docs.id)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 3, 9)}) == 1
    none = toxicity.train(no_docs, labels.limit(0))
    assert toxicity.score(no_docs, none).collect() == []
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, none).collect())


def labelled(spark, texts, toxic):
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    counted = []
    start = toxicity.Network.start
    monkeypatch.setattr(toxicity.Network, "start", lambda self, seen, rows, seed=0: (counted.append(rows.tolist()), start(self, seen, rows, seed)))
    toxic = [int(i < 2100) for i in range(4300)]
    docs, labels = labelled(spark, [f"w{i % 50}" + " vile" * y for i, y in enumerate(toxic)], toxic)
    toxicity.train(docs, labels)
    assert counted[1] == [2200, 2100]
    assert 0.7 < sum(counted[0]) / 4300 < 0.8


def test_shards_make_one_network(spark, tiny, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 40)
    texts, toxic = tiny
    docs, labels = labelled(spark, texts, toxic)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert auc([scores[i] for i in range(len(texts))], toxic) > 0.98


def test_every_row_takes_its_turn(tiny, monkeypatch):
    texts, toxic = tiny
    tokens, met = toxicity.Tokens(pa.array(texts)), []
    forward = toxicity.Network.forward
    monkeypatch.setattr(toxicity.Network, "forward", lambda self, t, rows, dropout=None: (met.extend(rows), forward(self, t, rows, dropout))[1])
    toxicity.Network().train(tokens, np.array(toxic, float), np.arange(len(texts)), least=1)
    assert set(met) == set(range(len(texts))) and len(met) == 4 * toxicity.BATCH


def test_distributed_thresholds(spark):
    rng = np.random.default_rng(4)
    z, toxic, group = rng.normal(size=300), rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    group[:5], toxic[:5] = 7, 0
    group[5:9], toxic[5:9] = 8, 1
    cells = spark.createDataFrame([(int(g), float(x), int(y), int(1 - y)) for g, x, y in zip(group, z, toxic)],
                                  "group int, z double, bad long, good long")
    cuts = toxicity.thresholds_of(cells)
    for g in set(group.tolist()):
        own = group == g
        assert cuts[g] == (pytest.approx(toxicity.threshold(z[own], toxic[own].astype(float), np.ones(own.sum()))), toxic[own].sum(), own.sum())
