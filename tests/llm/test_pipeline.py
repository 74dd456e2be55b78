"""Every stage against a plain version of its rule, and the pipeline as a whole."""

import zlib

import pyarrow as pa
import pytest

import corpus_pipeline
from ctrkit.llm import decontaminate, secrets, simhash, toxicity
from ctrkit.llm.data import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name, spark, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_the_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    from __spark_entry__ import queries
    assert queries()["pipeline"] is corpus_pipeline.run


def test_toxic_documents_go(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = toxicity.train(docs, labels.where(labels.doc_id.isin(learn)))
    scores = {r.doc_id: float(model.scores(pa.array([r.text]))[0]) for r in docs.collect()}
    out = stage("toxicity", spark, docs)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if scores[r.doc_id] < 0.5)
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    assert len(toxic & {r.doc_id for r in out.collect()}) <= 1
    assert docs.count() - out.count() < 2.5 * len(toxic)


def test_one_of_each_group_stays(spark, docs):
    rows = docs.collect()
    prints = {r.doc_id: simhash.fingerprint(r.text.encode().lower().split()) for r in rows}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    out = stage("near_duplicates", spark, docs)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in rows if label[r.doc_id] == r.doc_id)
    assert out.count() < len(rows)


def test_repeated_rows_are_one_document(spark, edge_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(11) == 1 and ids.count(None) == 1 and ids.count(2) == 0 and ids.count(6) == 0
    # Wordless texts are one group, and 3 is the least of its ids.
    assert 3 in ids and 5 not in ids and 9 not in ids


def test_benchmark_passages_go(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

    def holds(text):
        found = decontaminate.shingles(decontaminate.terms_of(text))
        for item in items:
            whole = decontaminate.shingles(decontaminate.terms_of(item.text))
            if len(whole & found) >= decontaminate.LEAST_OVERLAP * len(whole):
                return True
        return False

    out = stage("decontamination", spark, docs)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if not holds(r.text))
    assert out.count() < docs.count()


def test_secrets_are_masked_and_documents_stay(spark, docs):
    out = stage("secrets", spark, docs)
    assert out.columns == COLUMNS and out.count() == docs.count()
    before = {r.doc_id: r for r in docs.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text) and not secrets.base_spans(r.text)
        if r.text != before[r.doc_id].text:
            assert "[secret]" in r.text
        else:
            assert not secrets.base_spans(before[r.doc_id].text)


def test_whole_run_packs_what_the_stages_keep(spark):
    from tokenizers import Tokenizer
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
    tok = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: 1 + len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_no_documents(spark, no_docs):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, no_docs, SF).collect() == [], name
