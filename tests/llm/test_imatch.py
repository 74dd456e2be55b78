import hashlib
import re
import struct
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from ctrkit.llm import imatch as m

MASK32 = (1 << 32) - 1


def long_hash(value, seed):
    return xxh64_intdigest(struct.pack("<q", value), seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def terms(text):
    words = {w for w in re.split(r"[\W_]+", text.lower()) if w}
    return {signed(xxh64_intdigest(w.encode(), 42)) for w in words}


def plain_fingerprint(text, lexicon):
    kept = sorted(terms(text) & lexicon)
    out = []
    for level in range(m.LEVELS):
        for j in range(m.REPLICAS):
            subset = [t for t in kept if long_hash(j, long_hash(t, 42)) & ((2 << level) - 1) == 0]
            h = 42
            for t in subset:
                h = long_hash(t, h)
            out.append(h & MASK32 if subset else 0)
    return out if any(out) else [xxh64_intdigest(text.encode(), 42) & MASK32] * len(out)


def alike(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs)


def brute(rows, band):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxh64_intdigest(r[1].encode(), 42))))
    counts = Counter(t for _, text in rows for t in terms(text))
    low, high = (max(m.LEAST_DOCS, share * len(rows)) for share in band)
    lexicon = {t for t, n in counts.items() if low <= n <= high}
    prints = [plain_fingerprint(t, lexicon) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[after][1][:half]
        other = plain_fingerprint(edited, lexicon)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:08x}" for h in prints[k]),
                    "".join(f"{h:08x}" for h in other), pytest.approx(alike(prints[k], other)),
                    pytest.approx(alike(prints[k], prints[after]))))
    return sorted(out, key=lambda r: (r[0] is None, r[:5]))


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_against_plain_python(request, source):
    docs = request.getfixturevalue(source)
    got = sorted(map(tuple, m.fingerprints(docs).collect()), key=lambda r: (r[0] is None, r[:5]))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], m.BAND)


def test_terms_of_one_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_BITS", 1)
    docs = spark.createDataFrame([(i, f"w{i % 40} v{i % 3} only{i}") for i in range(200)], "doc_id long, text string")
    got = sorted(map(tuple, m.fingerprints(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], m.BAND)


def test_one_document_is_its_own_next(spark):
    rows = m.fingerprints(spark.createDataFrame([(3, "abcde fg")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in rows] == [(3, 1.0)]
    assert rows[0].edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest()


def test_edited_texts_are_nearer_than_strangers(docs_small):
    rows = m.fingerprints(docs_small).collect()
    assert sum(r.near_edited for r in rows) > 3 * sum(r.near_next for r in rows)


def test_no_python_in_the_plan(docs_small):
    plan = m.fingerprints(docs_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
