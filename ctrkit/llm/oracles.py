"""DuckDB SQL for the operators that SQL can express, written apart from their Spark code."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, byte by byte and bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _ : {bit})"
    chars = f"list_transform(string_split({text}, ''), lambda x : ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda a, b : {byte}), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees by recursion over their levels; a path's step joins a node with its run of at most 16.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS shown
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up
  WHERE n > 1 GROUP BY tree, level, pos // 16),
subroots AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS rank,
  count(*) OVER () AS n FROM up WHERE up.n = 1),
over AS (SELECT 0 AS level, rank AS pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM over
  WHERE n > 1 GROUP BY level, pos // 16),
top AS (SELECT digest AS root, level AS top_height FROM over WHERE n = 1),
nodes AS (SELECT u.tree, u.level, u.pos, u.digest FROM up u WHERE u.n > 1
  UNION ALL
  SELECT s.tree, s.height + o.level, o.pos, o.digest FROM subroots s JOIN over o ON true),
starts AS (SELECT p.*, s.subroot, s.rank, s.height, t.root, s.height + t.top_height AS steps, row_number() OVER () AS rid
  FROM placed p JOIN subroots s USING (tree), top t),
walk AS (SELECT rid, tree, 0 AS level, CASE WHEN height = 0 THEN rank ELSE pos END AS at, shown AS folded, '' AS proof,
    height, rank, steps FROM starts
  UNION ALL
  SELECT w.rid, any_value(w.tree), any_value(w.level) + 1,
    any_value(CASE WHEN w.level + 1 = w.height THEN w.rank ELSE w.at // 16 END),
    sha256(string_agg(CASE WHEN x.pos = w.at THEN w.folded ELSE x.digest END, '' ORDER BY x.pos)),
    any_value(w.proof) || coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos <> w.at), ''),
    any_value(w.height), any_value(w.rank), any_value(w.steps)
  FROM walk w JOIN nodes x ON x.tree = w.tree AND x.level = w.level AND x.pos // 16 = w.at // 16
  WHERE w.level < w.steps GROUP BY w.rid)
SELECT s.doc_id, s.leaf, s.subroot, s.root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = s.root AS verified
FROM starts s JOIN walk w ON w.rid = s.rid AND w.level = w.steps
"""


def _near(words: str) -> str:
    pattern = f"(?i)(?:^|[^A-Za-z])(?:{words})(?:[^A-Za-z]|$)"
    return f"(regexp_matches(before, '{pattern}') OR regexp_matches(after, '{pattern}'))"


def _luhn(d: str) -> str:
    two = "CASE WHEN (len(z) - i) % 2 = 1 THEN (2 * x) // 10 + (2 * x) % 10 ELSE x END"
    return (f"list_sum(list_transform(list_transform(string_split({d}, ''), lambda y : CAST(y AS INTEGER)), "
            f"lambda x, i : {two.replace('len(z)', f'length({d})')})) % 10 = 0")


def pii() -> str:
    """Personal data with the contract's own patterns; places are running sums over the pieces."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    cut = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g "
        f"FROM docs" for i, (k, p) in enumerate(patterns.items()))
    from ctrkit.llm import pii as op
    points = " ".join(
        f"WHEN '{k}' THEN {op.POINTS[k]} + CASE WHEN {_near(op.WORDS[k])} THEN {op.CONTEXT_POINTS} ELSE 0 END" for k in patterns)
    mod = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(turned, ''), lambda y : ascii(y)::BIGINT)), "
           "lambda a, c : CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({cut}),
hits AS (SELECT rid, rank, kind, i, m[i] AS v, g[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM cut)),
placed AS (SELECT *, sum(length(gap) + length(v)) OVER (PARTITION BY rid, rank ORDER BY i) AS fin,
  regexp_replace(v, '[^0-9]', '', 'g') AS d, replace(v, ' ', '') AS plain, string_split(v, '.') AS parts FROM hits),
proposed AS (SELECT *, coalesce(lag(fin) OVER w, 0) AS last, lead(fin - length(v)) OVER w AS next FROM placed
  WHERE kind <> 'card' OR length(d) BETWEEN 14 AND 19 WINDOW w AS (PARTITION BY rid, rank ORDER BY i)),
tried AS (SELECT p.*, substr(plain, 5) || left(plain, 4) AS turned,
  right(substr(text, CAST(last + 1 AS BIGINT), CAST(fin - length(v) - last AS BIGINT)), {op.NEAR}) AS before,
  left(substr(text, CAST(fin + 1 AS BIGINT), CAST(coalesce(next, length(text)) - fin AS BIGINT)), {op.NEAR}) AS after
  FROM proposed p JOIN docs USING (rid)),
passed AS (SELECT *, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(parts, lambda p : length(ltrim(p, '0')) > 3 OR
      coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND {_luhn('d')}
    WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    WHEN 'iban' THEN {mod}
    ELSE left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000' END AS ok,
  least(100, greatest(0, CASE kind {points} END - CASE WHEN {_near(op.AGAINST)} THEN {op.CONTEXT_POINTS} ELSE 0 END)) AS score
  FROM tried),
kept AS (SELECT rid, rank, kind, fin - length(v) AS start, kind || ':' || CAST(fin - length(v) AS VARCHAR) || ':' ||
  CAST(fin AS VARCHAR) AS span, score FROM passed WHERE ok AND (rank < {len(op.BASE)} OR score >= {op.LEAST})),
per AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in op.BASE)},
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(op.BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
  string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank) AS scores FROM kept GROUP BY rid)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in op.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM docs LEFT JOIN per USING (rid)
"""
