import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctrkit.llm import align as m
from ctrkit.llm import perfect_hash
from ctrkit.llm.data import PIECE_MODEL, tokenizer_path

A, B = tokenizer_path(), tokenizer_path(PIECE_MODEL)


@pytest.fixture(scope="module")
def plain():
    """The two kinds of (id, bytes) of a text, by the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])
    return tokens


def spans(tokens):
    ends = np.cumsum([len(x) for _, x in tokens]).tolist()
    return list(zip([0, *ends], ends))


def brute(rows, plain):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = plain(text)
        sa, sb = spans(a), spans(b)
        links = [(x[0], y[0]) for x, (s, e) in zip(a, sa) for y, (u, v) in zip(b, sb) if s < v and u < e] if len(a) < 400 else [
            (a[i][0], b[j][0]) for i, j in sweep(sa, sb)]
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [",".join(str(x[0]) for x, (s, e) in zip(a, sa) if lo <= s and e <= hi) + "|"
                  + ",".join(str(y[0]) for y, (s, e) in zip(b, sb) if lo <= s and e <= hi)
                  for lo, hi in zip([0, *cuts], cuts)] if len(a) < 400 else grouped(a, b, sa, sb, cuts)
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, links, g in docs]


def sweep(sa, sb):
    j = 0
    for i, (s, e) in enumerate(sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            yield i, k
            k += 1


def grouped(a, b, sa, sb, cuts):
    by = {}
    for side, (tokens, places) in enumerate(((a, sa), (b, sb))):
        at = np.searchsorted(cuts, [e for _, e in places])
        for (i, _), g in zip(tokens, at.tolist()):
            by.setdefault(g, ([], []))[side].append(str(i))
    return [",".join(by[g][0]) + "|" + ",".join(by[g][1]) for g in range(len(cuts))]


COLS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def same(spark, docs, plain):
    key = lambda r: tuple(map(str, r))
    got = m.align(docs, A, B).select(*COLS).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, plain), key=key)


ODD = ["a▁b c", " lead", "trail ", "two  spaces", "<|endoftext|> and <s> </s> <unk> <0x0A>", "é ß 漢字 \U0001f600\U0001f600", "\n\n a\n b\t",
       " ", "   ", "x", "word,. 12345 it's\r\n", "\x00 nul \x1c\x85 ", "ﬁ ½ ①", "a​b ﻿"]


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_against_the_libraries(spark, request, plain, source):
    same(spark, request.getfixturevalue(source), plain)


def test_odd_texts_and_clashing_columns(spark, plain):
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate([*ODD, *ODD[:3], None])]
    same(spark, spark.createDataFrame(rows, "doc_id long, text string, a string, b string, key string, n_best string"), plain)


def test_several_shards_and_vector_trees(spark, docs_small, plain, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BLOCKS", 3)
    monkeypatch.setattr(m, "FAN", 2)
    monkeypatch.setattr(m, "PIECE", 64)
    monkeypatch.setattr(perfect_hash, "BLOCK_KEYS", 300)
    same(spark, docs_small.repartition(5), plain)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab,.é \n\t's1\x1c\xa0漢A-<>▁", max_size=25), max_size=6))
def test_batches_give_the_ids_of_the_libraries(plain, texts):
    aligner = m.Aligner(A, B)
    got = aligner.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        a, b = plain(text)
        assert np.frombuffer(got["a"][i], aligner.dtype).tolist() == [x for x, _ in a]
        assert np.frombuffer(got["b"][i], aligner.dtype).tolist() == [x for x, _ in b]


def test_perfect_hash(spark, monkeypatch):
    monkeypatch.setattr(perfect_hash, "BLOCK_KEYS", 500)
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, 20_000))
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    rows = perfect_hash.build(df, 40).collect()
    table = perfect_hash.collected(rows, 0, 40, 40)
    at = perfect_hash.indexes(table, keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (table["keys"][at] == keys).all()
    others = np.setdiff1d(np.arange(50_000), keys)
    assert (perfect_hash.indexes(table, others) == -1).all()
    halves = [perfect_hash.collected([r for r in rows if a <= r["block"] < b], a, b, 40) for a, b in ((0, 17), (17, 40))]
    found = np.array([perfect_hash.indexes(h, keys) >= 0 for h in halves])
    assert (found.sum(axis=0) == 1).all()
