import random

import numpy as np
import pytest
import xxhash

from ctrkit.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i:i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(id, fingerprint, component) by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    seen, comp = set(), {}
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            a = todo.pop()
            for b in range(len(rows)):
                if b not in group and (fps[a] ^ fps[b]).bit_count() <= 3:
                    group.add(b)
                    todo.append(b)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        comp |= dict.fromkeys(group, least)
    return [(r[0], fps[i], comp[i]) for i, r in enumerate(rows)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_against_all_pairs(request, source):
    docs = request.getfixturevalue(source)
    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert by_id(got) == by_id(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def dense(n, seed):
    """Fingerprints around a few centres, so that links chain and groups are large."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        fp = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            fp ^= 1 << rng.randrange(64)
        out.add(fp)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(3))
def test_forest_connects_what_links_connect(seed, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 500)
    fps = dense(150, seed)
    close = [(i, j) for i in range(150) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    edges = simhash.forest(fps)
    assert len(edges) < 150
    assert all(int(fps[i] ^ fps[j]).bit_count() <= 3 for i, j in edges)
    assert components(150, edges) == components(150, close)


def test_large_files_are_cut_into_cells(spark):
    fps = dense(120, 9)
    close = [(i, j) for i in range(120) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    edges = [(at[r.u], at[r.v]) for r in simhash.links(table, cell=7).collect()]
    assert components(120, edges) == components(120, close)
