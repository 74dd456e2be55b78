import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ctrkit.llm import merkle as m
from ctrkit.llm.queries import op13_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(nodes):
    """(root, siblings and own place in its run of every leaf, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            paths[k].append((run[:i % 16], run[i % 16 + 1:]))
        nodes, at = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], low)) if bad else leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    if not order:
        return []
    trees = {s: grow([x[2] for x in sorted(by[s])]) for s in order}
    root, above = grow([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (known, doc_id, own, shown), path in zip(sorted(by[s]), trees[s][1]):
            whole, fold = path + up, shown
            for a, b in whole:
                fold = h(*a, fold, *b)
            out.append((doc_id if known else None, own, trees[s][0], root, h(*[x for a, b in whole for x in a + b]), fold, fold == root))
    return out


def same(got, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def query(docs):
    return m.prove(m.build(docs, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                        m.leaf_digest(text=m.lowered("text")))))


def test_addresses_fill_the_block_and_keep_subtrees_together():
    for n in (1, 2, 15, 16, 17, 256, 257, 300, 4095, 4096):
        for rows in range(m.steps(n) + 1, m.LEVELS + 2):
            places = m.layout(n, rows)
            assert sorted(x for p in places for x in p) == list(range(m.nodes_of(n, rows)))
            for level, p in enumerate(places):
                assert [m.address(n, rows, level, i) for i in range(0, len(p), 7)] == p[::7].tolist()
    bottom, parents = m.layout(4096, 4)[:2]
    assert all(list(range(q, q + 17)) == [q, *bottom[16 * i:16 * i + 16]] for i, q in enumerate(parents.tolist()))


def test_documents(spark, docs_small):
    rows = [tuple(r) for r in docs_small.select(*m.FIELDS).collect()]
    same(op13_merkle(spark, "/root/testdata/sf0.001").collect(), rows)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs.select("*", F.expr("case when doc_id < 4 then null when doc_id < 9 then 'b' else 'É' end").alias("source"),
                            F.lit(None).cast("string").alias("lang"), F.lit(7).cast("long").alias("n_chars"),
                            *[F.lit("x").alias(c) for c in ("tree", "pos", "block", "place", "leaf", "claim", "root")])
    same(query(docs).collect(), [tuple(r) for r in docs.select(*m.FIELDS).collect()])


def test_several_layers_and_full_runs(spark, monkeypatch):
    monkeypatch.setattr(m, "LEVELS", 1)
    rows = [(i, ["a", None, "b" * (i % 40)][i % 3 if i < 900 else 0], None, i, f"Text {i}") for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = m.build(docs)
    assert len(made.sources) >= 3 and len(made.top) >= 2
    same(query(docs).collect(), rows)


def test_one_document_and_none(spark, no_docs):
    assert query(no_docs).collect() == []
    one = spark.createDataFrame([(4, None, None, None, None)], no_docs.schema)
    r = query(one.select(*m.FIELDS)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf((4, None, None, None, None)) and r.verified
    assert r.proof_sha256 == h()


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4096, 4097])
def test_edges_of_runs_and_blocks(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "concat('T', id) as text")
    rows = query(docs)
    assert rows.count() == n
    root, _ = grow([leaf((i, "s", "en", i, f"T{i}")) for i in range(n)])
    assert [r.root for r in rows.select("root").distinct().collect()] == [root]
    assert rows.where("verified").count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(n))
