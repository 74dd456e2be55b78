"""Shared DuckDB SQL for the stand-in inputs (the oracle side of ``plans.standin``).

Each oracle query is ``WITH <base CTEs>, <own CTEs> SELECT ...``; the base mirrors the
Spark stand-in definitions independently, in plain SQL.
"""

BASE = """
inst AS (
  SELECT o.o_custkey AS uid, l.l_partkey AS aid,
         max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_r,
         max(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) AS has_a
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey),
train AS (
  SELECT aid, uid, CAST(CASE WHEN has_r = 1 THEN 1 ELSE -1 END AS BIGINT) AS label
  FROM inst WHERE has_r = 1 OR has_a = 1),
test AS (SELECT aid, uid FROM inst WHERE has_r = 0 AND has_a = 0),
multi AS (
  SELECT o.o_custkey AS uid,
         array_to_string(list_sort(list_distinct(list(p.p_size))), ' ') AS kw1,
         array_to_string(list_sort(list_distinct(list(p.p_brand))), ' ') AS interest1,
         array_to_string(list_sort(list_distinct(list(o.o_orderstatus))), ' ') AS os
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY o.o_custkey),
users_raw AS (
  SELECT c.c_custkey AS uid,
         CAST(c.c_nationkey AS VARCHAR) AS lbs,
         CAST(n.n_regionkey AS VARCHAR) AS house,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN '' ELSE c.c_mktsegment END AS carrier,
         CAST(CAST(floor(c.c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS consumptionability,
         coalesce(m.kw1, '') AS kw1, coalesce(m.interest1, '') AS interest1, coalesce(m.os, '') AS os
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN multi m ON c.c_custkey = m.uid),
users AS (
  SELECT uid, nullif(lbs, '') AS lbs, nullif(house, '') AS house, nullif(carrier, '') AS carrier,
         nullif(consumptionability, '') AS consumptionability, nullif(kw1, '') AS kw1,
         nullif(interest1, '') AS interest1, nullif(os, '') AS os
  FROM users_raw),
ads AS (
  SELECT p_partkey AS aid, p_brand AS advertiserid, p_type AS producttype,
         CAST(p_size AS VARCHAR) AS creativesize
  FROM part),
joined_train AS (
  SELECT t.aid, t.uid, t.label, u.lbs, u.house, u.carrier, u.consumptionability, u.kw1, u.interest1, u.os,
         a.advertiserid, a.producttype, a.creativesize
  FROM train t LEFT JOIN users u ON t.uid = u.uid LEFT JOIN ads a ON t.aid = a.aid),
joined_test AS (
  SELECT t.aid, t.uid, u.lbs, u.house, u.carrier, u.consumptionability, u.kw1, u.interest1, u.os,
         a.advertiserid, a.producttype, a.creativesize
  FROM test t LEFT JOIN users u ON t.uid = u.uid LEFT JOIN ads a ON t.aid = a.aid),
data AS (
  SELECT aid, uid, CAST(CASE WHEN label = -1 THEN 0 ELSE label END AS BIGINT) AS label,
         coalesce(lbs, '-1') AS lbs, coalesce(house, '-1') AS house, coalesce(carrier, '-1') AS carrier,
         coalesce(consumptionability, '-1') AS consumptionability, coalesce(kw1, '-1') AS kw1,
         coalesce(interest1, '-1') AS interest1, coalesce(os, '-1') AS os,
         advertiserid, producttype, creativesize
  FROM (SELECT * FROM joined_train
        UNION ALL
        SELECT aid, uid, CAST(NULL AS BIGINT) AS label, lbs, house, carrier, consumptionability, kw1,
               interest1, os, advertiserid, producttype, creativesize FROM joined_test)),
lab AS (SELECT * FROM data WHERE label IS NOT NULL),
docs AS (
  SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_tokens,
         len(list_distinct(string_split(d.text, ' '))) / len(string_split(d.text, ' ')) AS distinct_ratio
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def with_base(*ctes: str, select: str, recursive: bool = False) -> str:
    parts = [BASE.strip()] + [c.strip() for c in ctes]
    recursive = recursive or any(c.startswith("fit(factor_name, it,") for c in parts)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select.strip()


def unpivot_sql(source: str, ids: list[str], factors: list[str], value_expr: str = "{f}") -> str:
    """UNION ALL form of an unpivot: (ids..., factor_name, value)."""
    idl = ", ".join(ids)
    return "\nUNION ALL\n".join(
        f"SELECT {idl}{', ' if ids else ''}'{f}' AS factor_name, CAST({value_expr.format(f=f)} AS VARCHAR) AS value "
        f"FROM {source}" for f in factors)


def digamma_diff_sql(n: str, a: str) -> str:
    """psi(n + a) - psi(a) for integer n >= 0 as the exact finite sum sum_{k<n} 1/(a+k)."""
    return f"coalesce(list_sum(list_transform(range(CAST({n} AS BIGINT)), lambda k: 1.0 / (({a}) + k))), 0.0)"


def fit_steps_ctes(cells: str, steps: int, prefix: str = "p") -> tuple[list[str], str]:
    """Fixed-step Beta-Binomial fit per factor_name over a cells CTE with columns
    (factor_name, clicks, impressions). Returns (ctes, name of the final params CTE)."""
    ctes = [f"{prefix}hist AS (SELECT factor_name, clicks, impressions, count(*) AS n_cells FROM {cells} "
            f"GROUP BY factor_name, clicks, impressions)",
            f"{prefix}0 AS (SELECT DISTINCT factor_name, CAST(1.0 AS DOUBLE) AS alpha, "
            f"CAST(1.0 AS DOUBLE) AS beta FROM {prefix}hist)"]
    for i in range(steps):
        da = digamma_diff_sql("h.clicks", "p.alpha")
        db = digamma_diff_sql("h.impressions - h.clicks", "p.beta")
        dm = digamma_diff_sql("h.impressions", "p.alpha + p.beta")
        ctes.append(
            f"{prefix}{i + 1} AS (SELECT h.factor_name, "
            f"max(p.alpha) * sum(h.n_cells * {da}) / sum(h.n_cells * {dm}) AS alpha, "
            f"max(p.beta) * sum(h.n_cells * {db}) / sum(h.n_cells * {dm}) AS beta "
            f"FROM {prefix}hist h JOIN {prefix}{i} p ON h.factor_name = p.factor_name GROUP BY h.factor_name)")
    return ctes, f"{prefix}{steps}"


def auc_ctes(scored: str, group: str = "factor_name", prefix: str = "auc") -> tuple[list[str], str]:
    """Exact AUC (ties 1/2) per group over a CTE (group, score, label).
    Returns (ctes, final CTE with columns group, auc, n_pos, n_neg)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    ctes = [
        f"{prefix}_h AS (SELECT {g}CAST(score AS DOUBLE) AS score, sum(label) AS pos, sum(1 - label) AS neg "
        f"FROM {scored} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {g}CAST(score AS DOUBLE))",
        f"{prefix}_c AS (SELECT {g}score, pos, neg, coalesce(sum(neg) OVER ({part}ORDER BY score "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {prefix}_h)",
        f"{prefix} AS (SELECT {g}sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc, "
        f"CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM {prefix}_c"
        f"{' GROUP BY ' + group if group else ''})"]
    return ctes, prefix


def fit_converged_ctes(hist: str, max_iter: int = 1000, eps: float = 1e-8) -> tuple[list[str], str]:
    """Reference fit as a recursive CTE over a histogram CTE (factor_name, clicks,
    impressions, n_cells): start (1, 1), stop when both moves are below eps (keeping the
    previous pair) or after max_iter updates. Needs ``with_base(..., recursive=True)``.
    Final CTE: (factor_name, alpha, beta, n_iter, converged)."""
    da = digamma_diff_sql("h.clicks", "f.alpha")
    db = digamma_diff_sql("h.impressions - h.clicks", "f.beta")
    dm = digamma_diff_sql("h.impressions", "f.alpha + f.beta")
    stop = f"abs(na - alpha) < {eps!r} AND abs(nb - beta) < {eps!r}"
    rec = (f"fit(factor_name, it, alpha, beta, done) AS ("
           f"SELECT factor_name, 0, CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), false "
           f"FROM (SELECT DISTINCT factor_name FROM {hist}) "
           f"UNION ALL SELECT factor_name, it + 1, CASE WHEN {stop} THEN alpha ELSE na END, "
           f"CASE WHEN {stop} THEN beta ELSE nb END, {stop} FROM ("
           f"SELECT f.factor_name, f.it, f.alpha, f.beta, "
           f"f.alpha * sum(h.n_cells * {da}) / sum(h.n_cells * {dm}) AS na, "
           f"f.beta * sum(h.n_cells * {db}) / sum(h.n_cells * {dm}) AS nb "
           f"FROM fit f JOIN {hist} h ON f.factor_name = h.factor_name "
           f"WHERE NOT f.done AND f.it < {max_iter} GROUP BY f.factor_name, f.it, f.alpha, f.beta))")
    final = ("fitted AS (SELECT factor_name, arg_max(alpha, it) AS alpha, arg_max(beta, it) AS beta, "
             "CAST(CASE WHEN bool_or(done) THEN max(it) - 1 ELSE max(it) END AS INTEGER) AS n_iter, "
             "bool_or(done) AS converged FROM fit GROUP BY factor_name)")
    return [rec, final], "fitted"


def converged_fit_ctes(cells: str) -> list[str]:
    """Histogram of a cells CTE (factor_name, clicks, impressions) + the reference fit;
    the fitted parameters are in CTE ``fitted``."""
    hist = (f"{cells}_hist AS (SELECT factor_name, clicks, impressions, count(*) AS n_cells FROM {cells} "
            f"GROUP BY factor_name, clicks, impressions)")
    return [hist] + fit_converged_ctes(f"{cells}_hist")[0]
