import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctrkit.llm import tokenbin
from ctrkit.llm.bpe import UnitEncoder
from ctrkit.llm.data import tokenizer_path
from ctrkit.session import scratch_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab,.é \n\t's1\x1c\xa0漢A-", max_size=25), max_size=6))
def test_units_give_the_ids_of_the_library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    ids, offsets = UnitEncoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == tok.encode(text, add_special_tokens=False).ids


def brute(rows, plain, end_id):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain(text), end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_files_round_trip(spark, request, plain, source):
    docs = request.getfixturevalue(source)
    got = tokenbin.encode_to_files(docs, scratch_path(spark, "t"), tokenizer_path(), end_id=2)
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()], plain, 2)


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  c", "<|endoftext|", "no token", ""]


def test_added_tokens_are_the_librarys(spark, plain):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = tokenbin.encode_to_files(docs, scratch_path(spark, "t"), tokenizer_path(), end_id=2)
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(SPECIAL)), plain, 2)
    assert plain(SPECIAL[0]) == [31373, 220, 50256, 995]


def test_added_tokens_as_text():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    ids, offsets = UnitEncoder(tokenizer_path(), specials_as_text=True).encode(pa.array(SPECIAL, pa.string()))
    for text, a, b in zip(SPECIAL, offsets, offsets[1:]):
        assert ids[a:b].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_wide_ids_need_wide_files():
    assert tokenbin.width_for(tokenizer_path(), 2) == "<u2"
    assert tokenbin.width_for(tokenizer_path(), 70_000) == "<u4"
