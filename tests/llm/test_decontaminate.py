import random

import pyarrow as pa
import pytest

from ctrkit.llm import decontaminate as d


def brute_scores(index, terms, least):
    out = {}
    for t in terms:
        for part, impact in zip(index.docs[t], index.impacts[t]):
            out[part] = out.get(part, 0) + impact
    return {p: s for p, s in out.items() if s >= least - 1e-9}


@pytest.mark.parametrize("block", [1, 3, 16])
@pytest.mark.parametrize("least", [0.05, 0.3, 0.7])
def test_wand_retrieves_all_above_the_threshold(block, least):
    rng = random.Random(block)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    index = d.Index([(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 90)))) for i in range(150)], block)
    for _ in range(60):
        if rng.random() < 0.5:
            words = rng.choice(index.parts)[2][rng.randint(0, 4):] + rng.choices(vocabulary, k=20)
        else:
            words = rng.choices(vocabulary, k=rng.randint(1, 100))
        terms = sorted({index.term_ids[w] for w in words if w in index.term_ids})
        got = index.wand(terms, least)
        assert len({p for p, _ in got}) == len(got)
        want = brute_scores(index, terms, least)
        assert dict(got) == pytest.approx(want)


def overlap_of(item, words):
    whole = d.shingles(d.terms_of(item))
    return len(whole & d.shingles(words)) / len(whole)


def share_of(own, words):
    own = d.shingles(own)
    n = len(next(iter(own), ()))
    return sum(any(tuple(words[i:i + n]) == w for i in range(len(words))) for w in own) / len(own) if own else 0.0


def held_by(text, items):
    """The items in a text by a plain comparison of all shingles."""
    words, out = d.terms_of(text), []
    for i, t in items:
        parts = [share_of(x, words) for x in d.question_and_answer(t)]
        if share_of(d.terms_of(t), words) >= d.LEAST_OVERLAP or len(d.terms_of(t)) >= d.SHINGLE and min(parts) >= d.LEAST_OVERLAP:
            out.append(i)
    return out


def test_question_and_answer_apart_are_found(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(f"u{rng.randrange(5000)}" for _ in range(n))
    items = [(i, f"{say(9)} {say(3)}? {say(2 + i % 4)}.") for i in range(20)]
    rows = []
    for i, text in items:
        q, a = d.question_and_answer(text)
        rows += [(i, f"{' '.join(q)} {say(30)} {' '.join(a)} {say(9)}"), (100 + i, f"{say(40)} {' '.join(a)}")]
    got = {r.doc_id: r for r in d.find(spark.createDataFrame(rows, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: r["items"] for k, r in got.items()} == {k: held_by(t, items) for k, t in rows}
    assert all(got[i]["items"] == [i] and got[100 + i]["items"] == [] for i in range(20))
    assert all(got[i].question_overlap == got[i].answer_overlap == 1.0 > got[i].overlap > 0 for i in range(20))
    assert all(got[100 + i].question_overlap == 0 for i in range(20))


def test_planted_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(6, 60)) + ". " + say(rng.randint(5, 20)) + ".") for i in range(60)]
    items.append((99, ". ".join(say(30) for _ in range(10))))  # longer than a passage
    items.append((98, "two words"))
    rows, want = [], {}
    for doc in range(80):
        words = say(rng.randint(0, 700)).split()
        held = rng.sample([i for i in items if i[0] != 98], k=doc % 3)
        for _, text in held:
            words.insert(rng.randint(0, len(words)), text.upper() if doc % 2 else text)
        text = " ".join(words)
        rows.append((doc, text))
        full = set(held_by(text, items))
        assert {i for i, t in held if t.lower() in text.lower()} <= full
        want[doc] = sorted(full)
    got = {r.doc_id: r.items for r in d.find(spark.createDataFrame(rows, "doc_id long, text string"),
                                             spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_items_with_another_or_no_last_sentence_are_found(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    heads = {i: say(rng.choice([40, 60, 120, 300])) + "." for i in range(24)}
    items = [(i, f"{h} {say(1 + i % 4)}.") for i, h in heads.items()]
    rows = [(i, f"{say(90)} {h} {('', 'Something else.')[i % 2]} {say(90)}") for i, h in heads.items()]
    # The rarest words stand at the end and are cut off: 0.8 of the shingles are left, less of the score.
    common = " ".join(f"v{j}" for j in range(40))
    items += [(90 + k, common + f" rare{k}a rare{k}b rare{k}c rare{k}d rare{k}e rare{k}f rare{k}g rare{k}h") for k in range(3)]
    items += [(200 + k, common + f" v{k}") for k in range(30)]
    rows += [(90, say(70) + " " + common + " " + say(30))]
    want = {doc: held_by(text, items) for doc, text in rows}
    assert all(i in want[doc] for doc, text in rows for i, t in items if overlap_of(t, d.terms_of(text)) >= d.LEAST_OVERLAP)
    assert all(i in want[i] for i in heads) and {90, 91, 92} <= set(want[90])
    got = {r.doc_id: r.items for r in d.find(spark.createDataFrame(rows, "doc_id long, text string"),
                                             spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_given_documents_against_all_shingles(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r.items for r in d.find(docs, items).collect() if r["items"]}
    listed = [(r.item_id, r.text) for r in items.collect()]
    want = {}
    for r in docs.collect():
        words = d.terms_of(r.text)
        held = [i for i, t in listed if overlap_of(t, words) >= d.LEAST_OVERLAP]
        if len(words) < 400:
            assert held == held_by(r.text, listed)
        if held:
            want[r.doc_id] = held
    assert got == want and len(want) > 10


def test_several_indexes_find_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(tuple, d.find(docs, items).collect()))
    one = rows()
    monkeypatch.setattr(d, "INDEX_ITEMS", 30)
    assert rows() == one
    plan = d.find(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a stage holds one index


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "same words here again and again"),
                                   (3, "same words here again and again"), (4, "one"), (5, "?!")],
                                  "item_id long, text string")
    rows = d.find(edge_docs, items).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id for r in rows if 3 in r["items"]} == {4, 6}
    assert {r.doc_id for r in rows if 4 in r["items"]} == {7, 8}
    assert d.find(no_docs, items).collect() == []
    assert all(r["items"] == [] for r in d.find(edge_docs, items.limit(0)).collect())


def test_question_and_answer():
    assert d.question_and_answer("Who was it? It was he.") == (["who", "was", "it"], ["it", "was", "he"])
    assert d.question_and_answer("a b c") == (["a", "b"], ["c"])
    assert d.question_and_answer("") == ([], [])
    assert d.passages(d.Index([]), pa.array(["a", ""]), 0.5) == {}
