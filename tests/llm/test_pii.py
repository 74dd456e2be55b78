import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctrkit.llm import pii

# The contract's patterns, and the added kinds' in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?a:\b)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?a:\b)",
    "ssn": r"(?a:\b)[0-9]{3}-[0-9]{2}-[0-9]{4}(?a:\b)",
}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "iban":
        plain = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ssn":
        return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
    return True


def near(words, *sides):
    return any(re.search(f"(?ai)(?:^|[^A-Za-z])(?:{words})(?:[^A-Za-z]|$)", s) for s in sides)


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        found = list(re.finditer(pattern, text or ""))
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(text or "")]
        for i, m in enumerate(found):
            if kind == "card" and not 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19:
                continue
            # A card's neighbours are the other chains of 14 to 19 digits.
            chains = [x for x in found if kind != "card" or 14 <= len(re.sub("[^0-9]", "", x[0])) <= 19]
            at = chains.index(m)
            before = text[max([0, *(x.end() for x in chains[:at])]):m.start()][-pii.NEAR:]
            after = text[m.end():min([len(text), *(x.start() for x in chains[at + 1:])])][:pii.NEAR]
            points = pii.POINTS[kind] + 25 * near(pii.WORDS[kind], before, after) - 25 * near(pii.AGAINST, before, after)
            if valid(kind, m[0]) and (kind in pii.BASE or points >= pii.LEAST):
                out.append((m.start(), rank, kind, m.end(), m[0], max(0, min(100, points))))
        assert len(ends) == len(starts)
    return sorted(out)


def row(doc_id, text):
    spans = brute(text)
    show = lambda xs: ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in xs)
    base = [s for s in spans if s[2] in pii.BASE]
    return (doc_id, *[sum(s[2] == k for s in base) for k in pii.BASE], hashlib.sha256(show(base).encode()).hexdigest(),
            show(spans), ",".join(str(s[5]) for s in spans))


def same(df, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted([row(*r) for r in rows], key=key)


CASES = [
    "a@b.c@d.ef x@y.zz%foo@bar.com. .@-.- a@b a@b. u@h..c é@é.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.255.0 1.2.3 00000000000000000000000000.1.1.999999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111 5- 4111111111111111 4111  111111111111 79927398713",
    "4111111111111111 4111111111111111", "card 4111111111111111, order 4111111111111111é",
    "+1 (279) 555-0024 qui +49 30 901820. +1(2 +12345678901234567 ++1 2345678901)",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and GB82WEST12345698765431; example FR1420041010050500013M02606 é",
    "ssn 123-45-6789, 123-45-6789 without, social security: 000-12-3456 ssn 987-65-4321 ssn 219-09-9999x",
    "tel +1 279 555 0024 sample +1 279 555 0025 \U0001f600 mail me: ü.x@y.de\n10.0.0.1:80",
]


def test_cases(spark):
    rows = list(enumerate(CASES))
    same(pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_documents_and_edge_rows(docs_small, edge_docs, no_docs):
    for docs in (docs_small, edge_docs.withColumn("_text", F.lit("x")).withColumn("spans", F.lit(1)), no_docs):
        same(pii.digest(pii.find(docs)), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a@.1 +-4()D9é", max_size=60), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    same(pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_long_runs_and_many_matches(spark):
    n = 30_000
    texts = ["a" * 300_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "1" * 300_000, "1 " * 150_000, "1." * 150_000,
             "+1" + "(" * 300_000, "x@y.zz " * n, "10.0.0.1;" * n, "AB12" * 50_000]
    began = time.time()
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(
        "doc_id", F.size("spans").alias("n"), F.try_element_at("spans", F.lit(-1))["end"].alias("last")).collect()
    assert {r.doc_id: r.n for r in found} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 37_500, 5: 0, 6: n, 7: n, 8: 0}
    assert {r.last for r in found if r.doc_id in (6, 7)} == {7 * n - 1, 9 * n - 1}
    assert time.time() - began < 60


def test_no_python_in_the_plan(docs_small):
    plan = pii.digest(pii.find(docs_small))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("regexp_extract_all") <= 4 * len(pii.KINDS)
