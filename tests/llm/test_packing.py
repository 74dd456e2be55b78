import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ctrkit.llm import cutting_stock, packing
from ctrkit.llm.data import tokenizer_path


@pytest.mark.parametrize("source,size", [("docs_small", 2048), ("edge_docs", 2048), ("edge_docs", 16), ("no_docs", 2048)])
def test_every_id_in_one_piece(request, source, size):
    docs = request.getfixturevalue(source).select("doc_id", "text")
    tok = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    unit = packing.UNIT if size == 2048 else 1
    rows = packing.pack(docs, tokenizer_path(), end_id=1, size=size, unit=unit).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        ids = want[doc][0]
        copies = len(want[doc])
        covered = np.zeros(len(ids), int)
        for p in pieces:
            part = ids[p.start:p.start + p.length]
            assert len(part) == p.length > 0 and p.doc_tokens == len(ids)
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
            covered[p.start:p.start + p.length] += 1
        assert (covered == copies).all()
    padding = total = 0
    for pieces in by_seq.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= size
        total += end
        padding += 0 if end & (end - 1) == 0 else size - end
    assert padding <= 0.02 * total


def padding_of(rows, size):
    ends = defaultdict(int)
    for r in rows:
        ends[r.sequence_id] += r.length
    return sum(0 if e & (e - 1) == 0 else size - e for e in ends.values()), sum(ends.values())


@pytest.mark.parametrize("lengths", [[9], range(9, 14), [17], [*range(1, 40)] + [700, 2047, 2048, 2049], range(40, 900)],
                         ids=["nine", "nine to thirteen", "seventeen", "mixed", "many"])
def test_short_texts_leave_little_padding(spark, lengths):
    tok = Tokenizer.from_file(tokenizer_path())
    assert len(tok.encode("the" + " the" * 7, add_special_tokens=False).ids) == 8
    lengths = list(lengths)
    rows = [(i, "the" + " the" * (lengths[i % len(lengths)] - 2)) if lengths[i % len(lengths)] > 1 else (i, "") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    padding, total = padding_of(packing.pack(docs, tokenizer_path(), end_id=1).collect(), packing.SIZE)
    assert total == sum(lengths[i % len(lengths)] for i in range(4000))
    assert padding <= 0.02 * total


def test_fine_classes():
    assert [packing.fine(n) for n in (1, 31, 32, 63, 64, 65, 128, 129, 257, 1025)] == [
        1, 31, 32, 63, 64, 66, 128, 132, 264, 1056]
    assert all(n <= packing.fine(n) <= n * (1 + 1 / packing.EXACT) for n in range(1, 2049))
    assert len({packing.fine(n) for n in range(1, 2049)}) < 300


def test_column_generation_finds_the_optimum():
    sizes, demands = np.array([3, 4, 7]), np.array([40, 30, 20])
    patterns, x = cutting_stock.solve(sizes, demands, 10, gap=0)
    assert (patterns @ sizes <= 10).all() and (x @ patterns >= demands - 1e-6).all()
    # 20 bins of 7+3, then 3+3+4 and 4+4: at least 20 + (20*3 + 30*4)/10 = 38 bins by volume
    assert 38 - 1e-6 <= x.sum() <= 40 + 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_column_generation_near_the_volume_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 120), 60, replace=False))
    demands = rng.integers(1, 500, 60)
    patterns, x = cutting_stock.solve(sizes, demands, 128)
    times = cutting_stock.rounded(patterns, x, demands)
    assert (patterns @ sizes <= 128).all()
    assert (x @ patterns >= demands - 1e-6).all()
    assert (times @ patterns).sum() >= 0.9 * demands.sum()
    assert x.sum() >= demands @ sizes / 128 - 1e-6
