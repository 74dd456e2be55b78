"""The design matrix and its dictionary name the same columns."""

from ctrkit.operators import encode as E
from ctrkit.plans.q_encode import DICT_TOKENS, NUMERIC_COLS, OHE_COLS, design_rows, matrix_input
from tests.conftest import SF001


def test_every_value_stands_where_the_dictionary_says(spark):
    rows, dictionary = design_rows(spark, SF001)
    at = {(r.feature, r.val): r.col_index for r in dictionary.collect()}
    assert sorted(set(at.values())) == list(range(max(at.values()) + 1))
    source = {(r.uid, r.aid): r for r in matrix_input(spark, SF001).collect()}
    n = 0
    for r in rows.collect():
        raw = source[r.uid, r.aid]
        assert r.features.size == max(at.values()) + 1 and r.label == raw.label
        want = {}
        for c in OHE_COLS:
            if raw[c] is not None:
                want[at[c, raw[c]]] = 1.0
        for c in DICT_TOKENS:
            for t in (raw[c].lower().split(" ") if raw[c] is not None else []):
                want[at[c, t]] = want.get(at[c, t], 0) + 1.0
        for c in NUMERIC_COLS:
            if raw[c]:
                want[at[c, None]] = raw[c]
        assert dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == want
        n += 1
    assert n == len(source)


def test_edge_rows(spark):
    rows = [(1, None, "", None), (2, "b", "x x -1", 0.0), (3, "a", None, 2.5)]
    df = spark.createDataFrame(rows, "id long, c string, t string, n double")
    out, dictionary = E.design_matrix(df, ["id"], ["c"], ["t"], ["n"], keep=[])
    at = {(r.feature, r.val): r.col_index for r in dictionary.collect()}
    assert at == {("c", "a"): 0, ("c", "b"): 1, ("t", ""): 2, ("t", "-1"): 3, ("t", "x"): 4, ("n", None): 5}
    got = {r.id: dict(zip(r.features.indices.tolist(), r.features.values.tolist())) for r in out.collect()}
    assert got == {1: {2: 1.0}, 2: {1: 1.0, 3: 1.0, 4: 2.0}, 3: {0: 1.0, 5: 2.5}}


def test_texts_of_one_integer_share_a_code(spark):
    df = spark.createDataFrame([("1",), ("01",), ("10",), ("2",)], "c string")
    assert {r.val: r.code for r in E.ordinal_dictionary(df, ["c"]).collect()} == {"1": 0, "01": 0, "2": 1, "10": 2}
    df = spark.createDataFrame([("1",), ("1.0",), ("1e1",)], "c string")
    assert {r.val: r.code for r in E.ordinal_dictionary(df, ["c"]).collect()} == {"1": 0, "1.0": 1, "1e1": 2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_they_lie(spark, monkeypatch):
    written = []
    as_vectors = E.as_vectors
    monkeypatch.setattr(E, "as_vectors", lambda rows, *a: (written.append(rows), as_vectors(rows, *a))[1])
    rows, _ = design_rows(spark, SF001)
    assert "hashpartitioning" not in plan_of(written[0])
    monkeypatch.setattr(E, "SHIPPED_TOKENS", 0)
    joined, _ = design_rows(spark, SF001)
    assert plan_of(written[1]).count("Join") == len(OHE_COLS) + len(DICT_TOKENS)
    key = lambda r: (r.uid, r.aid)
    assert sorted(rows.collect(), key=key) == sorted(joined.collect(), key=key)


def test_files_of_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(E, "VECTOR_ROWS", 500)
    rows, _ = design_rows(spark, SF001)
    assert max(r["count"] for r in rows.select("_metadata.file_path").groupBy("file_path").count().collect()) <= 500


def test_one_hot_rows_are_not_moved(spark):
    cells = E.one_hot_long(matrix_input(spark, SF001), ["uid", "aid"], OHE_COLS)
    assert "hashpartitioning" not in plan_of(cells)


def test_compressed_csv(spark, tmp_path):
    from ctrkit.sources import files
    rows = [(1, "a,b"), (2, None), (3, 'x"y')]
    files.write_csv(spark.createDataFrame(rows, "id long, t string"), str(tmp_path / "c"), header=True, compression="gzip")
    assert {p.suffix for p in (tmp_path / "c").glob("part-*")} == {".gz"}
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "c"), "id long, t string", header=True).collect())) == rows
