import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctrkit.llm import secrets

PARTS = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", '"', "'", " ", "  ", ":", "=", "abc123DEF456",
         "x" * 11, "AKIA", "AKIA" + "A1" * 7, "0123456789abcdef", "ſecret", "é", "\n", "=", "deadbeef" * 3, "K"]


def brute(text):
    """The three patterns as they are told: match by match, failing ones dropped afterwards."""
    out = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, group, least in ((0, assign, 2, 12), (1, re.compile("AKIA[A-Z0-9]+"), 0, 18),
                                        (2, re.compile("[0-9a-f]+"), 0, 16)):
        at = 0
        while m := pattern.search(text, at):
            if len(m[group]) >= least:
                out.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute(text)


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("") == 0
    for weak in ("password", "changeme123", "qwertyuiop", "aaaaaaaaaaaaaaaa", "abcdefghijk", "20240131", "Welcome2024", "xxxxxxxx"):
        assert cost(weak) < secrets.LEAST_COST, weak
    for strong in ("vK3#xQ9!mZ2p", "9f8c2d1a77e0b6", "tr0ub4dor&3ZZq"):
        assert cost(strong) >= secrets.LEAST_COST, strong
    assert cost("qazxsw") < cost("qmzptw")
    assert cost("k9Xk9Xk9X") < cost("k9Xp2Lw7Q")


def brute_cost(value):
    """The same costs by trying every segmentation."""
    parts = {}
    n = len(value)
    per = secrets.log10(max(2, secrets.alphabet_size(value)))
    for i, j, c in secrets.runs(value):
        parts[i, j] = min(parts.get((i, j), 99), c)
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(secrets.WORDS)))}
    for i in range(n):
        for j in range(i + 2, n + 1):
            if value[i:j] in ranks:
                parts[i, j] = min(parts.get((i, j), 99), secrets.log10(1 + ranks[value[i:j]]))
    for m in secrets.REPEAT.finditer(value):
        parts[m.span()] = min(parts.get(m.span(), 99), len(m[1]) * per + secrets.log10((m.end() - m.start()) / len(m[1])))
    for m in secrets.DATE.finditer(value):
        parts[m.span()] = min(parts.get(m.span(), 99), secrets.log10(
            secrets.YEAR_GUESSES if len(m[0]) == 4 else secrets.DATE_GUESSES))

    def least(i):
        if i == n:
            return 0
        return min([per + least(i + 1), *(c + least(j) for (a, j), c in parts.items() if a == i)])
    return least(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["pass", "test", "123", "qwe", "2024", "aa", "x", "7", "#"]), min_size=1, max_size=4).map("".join))
def test_program_finds_the_least(value):
    assert secrets.guess_cost(value) == pytest.approx(brute_cost(value))


@pytest.mark.parametrize("source", ["docs_small", "edge_docs", "no_docs"])
def test_query_rows(request, source):
    docs = request.getfixturevalue(source)
    want = sorted(((r.doc_id, secrets.joined(brute(r.text or ""))) for r in docs.collect()), key=str)
    rows = secrets.scan(docs).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in rows), key=str) == sorted(
        ((d, hashlib.sha256(s.encode()).hexdigest()) for d, s in want), key=str)
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("cred")]
        assert [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, 'say token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and go', 9), (2, "password: changeme", 18),
            (3, None, None), (4, "pwd=vK3#xQ9!mZ2p end", 20)]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [r.text for r in out] == ['say [secret]" and go', "password: changeme", None, "pwd=[secret] end"]
    assert [r.n_chars for r in out] == [20, 18, None, 16]


def test_ordinary_words_after_a_credential_word_stay(spark):
    rows = [(1, "the ingredients of a remarkable breakfast"), (2, "remarkable Ingredients, for breakfast"),
            (3, "secret: ingredients and token: remarkablebreakfast"), (4, "secret: xkqjzwvmpt"),
            (5, "secret: xkqjzwvmpt"), (6, "secret: xkqjzwvmpt")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("cred")] for r in secrets.scan(docs).collect()}
    assert spans == {1: [], 2: [], 3: [], **{i: ["cred:8:18"] for i in (4, 5, 6)}}
    text = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert text[4] == "secret: [secret]" and "secret: ingredients" in text[3]


def plain_cost(value):
    """The least cost over parts found by going through all spans without the module's finders."""
    per = secrets.log10(secrets.alphabet_size(value))
    n = len(value)
    best = [0.0]
    for j in range(1, n + 1):
        options = [best[j - 1] + per]
        for i in range(j):
            part = value[i:j]
            if part in secrets.WORDS and len(part) > 1:
                options.append(best[i] + secrets.log10(2 + secrets.WORDS.index(part)))
            for size in range(1, (j - i) // 2 + 1):
                if (j - i) % size == 0 and part == part[:size] * ((j - i) // size):
                    options.append(best[i] + size * per + secrets.log10((j - i) // size))
            if re.fullmatch(r"(19|20)\d\d", part):
                options.append(best[i] + secrets.log10(secrets.YEAR_GUESSES))
            elif secrets.DATE_FORMS.fullmatch(part):
                options.append(best[i] + secrets.log10(secrets.DATE_GUESSES))
            if len(part) > 2 and {ord(b) - ord(a) for a, b in zip(part, part[1:])} in ({1}, {-1}):
                options.append(best[i] + secrets.log10(30 * len(part)))
            where = [next(((r, row.index(c)) for r, row in enumerate(secrets.ROWS) if c in row), None) for c in part]
            if len(part) > 2 and None not in where:
                steps = [(r - q, y - x) for (q, x), (r, y) in zip(where, where[1:])]
                if all(s != (0, 0) and max(map(abs, s)) <= 1 for s in steps):
                    turns = sum(a != b for a, b in zip(steps, steps[1:]))
                    options.append(best[i] + secrets.log10(47 * len(part)) + turns * secrets.log10(5))
        best.append(min(options))
    return best[-1]


@pytest.mark.parametrize("value", ["20242024", "aa#7aa#7", "k9xp2lw7qzk9xp2lw7qz", "12024", "xaaaaqwertz", "1112024",
                                   "asasasasdfq", "abcdcba20240131", "120240131", "314159265314159265"])
def test_every_span_of_a_kind_is_a_part(value):
    assert secrets.guess_cost(value) == pytest.approx(plain_cost(value))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "aab", "abaab", "xyz", "q", "é"]), min_size=1, max_size=40).map("".join))
def test_repeats_of_long_values_are_those_of_short_ones(value):
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    assert secrets.alike_stretches(codes, direct=0) == secrets.alike_stretches(codes, direct=10 ** 6)


def test_very_long_values_take_seconds(spark):
    rng = np.random.default_rng(3)
    signs = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    key = "".join(rng.choice(signs, 200_000))
    values = [key, key[:50_000] * 4, "x9" * 100_000, "a" * 200_000]
    began = time.time()
    costs = [secrets.guess_cost(v) for v in values]
    assert time.time() - began < 90
    assert costs[0] > 100_000 and costs[1] < costs[0] / 3 and costs[2] < 10 and costs[3] < 10
    docs = spark.createDataFrame([(1, f"token={key} end")], "doc_id long, text string")
    assert f"cred:6:{len(key) + 6}" in secrets.scan(docs).first().spans
