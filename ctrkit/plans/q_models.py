"""Evaluation (AUC, ROC, best round, feature ranking, cut coverage) with SQL oracles,
and model / search queries (rows-only checks)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ctrkit.operators import encode as E
from ctrkit.operators import evaluate as V
from ctrkit.operators import instances
from ctrkit.operators import linear as L
from ctrkit.operators import models as M
from ctrkit.operators import stats as st
from ctrkit.operators import tokens as T
from ctrkit.operators.ranking import ordered_scan
from ctrkit.operators.smoothing import fit_beta, smoothed_ratio
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import auc_ctes, with_base
from ctrkit.plans.q_stats import CELLS, LAB_LONG, LAB_TOK, r6
from ctrkit.session import scratch_path, shared_root

DOC_FEATURES = ["n_chars", "n_tokens", "distinct_ratio"]


def _docs_long(spark, d):
    return st.long_form(S.documents_labelled(spark, d), DOC_FEATURES, ["doc_id", "label"],
                        name_col="feature", value_col="score").withColumn("score", F.col("score").cast("double"))


_DOCS_LONG_SQL = "dl AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS score, label FROM docs" for f in DOC_FEATURES) + ")"


# ----------------------------------------------------------------------------- M1, M2, A16, M4
@register("auc_exact", with_base(_DOCS_LONG_SQL, *auc_ctes("dl", "feature")[0], select=(
    "SELECT feature, round(auc, 6) AS auc, n_pos, n_neg FROM auc")))
def auc_exact(spark, d):
    """Exact AUC (ties 1/2) of three document scores against the quality label."""
    out = V.auc_exact(_docs_long(spark, d), "score", "label", ["feature"])
    return out.select("feature", r6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@register("roc_points", with_base(
    "h AS (SELECT distinct_ratio AS score, sum(label) AS pos, sum(1 - label) AS neg FROM docs GROUP BY distinct_ratio)",
    "c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM h)",
    select="SELECT round(score, 6) AS threshold, round(fp / (SELECT sum(neg) FROM h), 6) AS fpr, "
           "round(tp / (SELECT sum(pos) FROM h), 6) AS tpr FROM c"))
def roc_points(spark, d):
    pts = V.roc_points(S.documents_labelled(spark, d), "distinct_ratio", "label")
    return pts.select(*[r6(F.col(c)).alias(c) for c in ["threshold", "fpr", "tpr"]])


_FACTOR_AUC_SQL = [LAB_LONG, CELLS,
                   "fs AS (SELECT factor_name, clicks / impressions AS score, clicks AS pos, impressions - clicks AS neg "
                   "FROM cells)",
                   "fh AS (SELECT factor_name, score, sum(pos) AS pos, sum(neg) AS neg FROM fs "
                   "GROUP BY factor_name, score)",
                   "fc AS (SELECT factor_name, pos, neg, coalesce(sum(neg) OVER (PARTITION BY factor_name ORDER BY score "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM fh)",
                   "fa AS (SELECT factor_name, sum(pos * (nb + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) "
                   "AS auc FROM fc GROUP BY factor_name)"]


def _factor_auc(spark, d):
    """AUC of each factor's raw (value, aid) CTR as a score: from the cells directly."""
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS).withColumn(
        "neg", F.col("impressions") - F.col("clicks"))
    return V.auc_from_counts(cells, "ctr", "clicks", "neg", ["factor_name"])


@register("feature_auc_ranking", with_base(*_FACTOR_AUC_SQL, select=(
    "SELECT factor_name, round(auc, 6) AS auc, CAST(row_number() OVER (ORDER BY round(auc, 6) DESC, factor_name) "
    "AS BIGINT) AS rank FROM fa")))
def feature_auc_ranking(spark, d):
    """M4 relational proxy: rank features by the AUC of their CTR statistic."""
    a = _factor_auc(spark, d).select("factor_name", r6(F.col("auc")).alias("auc"))
    return V.rank_by_metric(a, "auc", "factor_name")


_POS = "CASE factor_name " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(S.CROSS_FACTORS)) + " END"


@register("best_round", with_base(*_FACTOR_AUC_SQL, "curve AS (SELECT " + _POS + " AS round, round(auc, 8) AS m FROM fa)",
                                  select="SELECT CAST(min(round) AS INTEGER) AS best_round, round(max(m), 6) AS "
                                         "best_metric FROM curve WHERE m = (SELECT max(m) FROM curve)"))
def best_round(spark, d):
    """A16 on the curve (factor position -> AUC): max and the first position reaching it."""
    pos = None
    for i, f in enumerate(S.CROSS_FACTORS):
        pos = F.when(F.col("factor_name") == f, F.lit(i)) if pos is None else pos.when(F.col("factor_name") == f,
                                                                                       F.lit(i))
    curve = _factor_auc(spark, d).select(pos.alias("round"), F.col("auc").alias("metric"))
    out = V.best_round(curve, "round", "metric")
    return out.select(F.col("best_round").cast("int"), r6(F.col("best_metric")).alias("best_metric"))


# ----------------------------------------------------------------------------- M6 relational part
@register("cut_coverage", with_base(
    LAB_TOK,
    "imp AS (SELECT factor_name, single_value, count(*) AS n FROM lab_tok GROUP BY factor_name, single_value)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY n DESC, single_value) AS rnk FROM imp)",
    select="SELECT factor_name, rnk AS top_n, round(sum(n) OVER (PARTITION BY factor_name ORDER BY rnk) / "
           "sum(n) OVER (PARTITION BY factor_name), 6) AS kept_share FROM rk"))
def cut_coverage(spark, d):
    """Share of labelled token occurrences kept by a top-N cut, for every N up to the vocabulary: the
    running sum of the importances in rank order."""
    imp = T.token_importance(S.data_all(spark, d), S.TOKEN_FACTORS)
    ranked = ordered_scan(imp, [F.col("import_value").desc(), F.col("single_value").asc()], ["factor_name"],
                          sums=["import_value"], index_col="_i")
    totals = imp.groupBy("factor_name").agg(F.sum("import_value").alias("_all"))
    return ranked.join(totals, "factor_name").select(
        "factor_name", (F.col("_i") + 1).alias("top_n"),
        r6((F.col("import_value_before") + F.col("import_value")) / F.col("_all")).alias("kept_share"))


# ----------------------------------------------------------------------------- model table
NUMERIC = ["kw1cnt", "interest1cnt", "lbs_code", "carrier_code", "consumptionability_code", "delivery", "hist_ctr"]
SMOOTH_COLS = [f"{f}_ctr_smooth" for f in S.CROSS_FACTORS]


def model_table(spark, d):
    """Compact numeric features per instance (train / valid / test split by hash), written once as numbers because
    every model and search loop reads it many times.

    Every statistic holds the ad: the rows, without the long token strings, are brought together by it
    once and counted there (``with_shared``). The counts of the train rows are what is stored; the fit takes its cells
    from them and a row's rates follow from them as it is read, so there is neither a table of cells nor a join with one."""
    data = instances.hash_split(S.data_all(spark, d), ["uid", "aid"], 70).withColumn(
        "split", F.when(F.col("label").isNull(), F.lit("test")).otherwise(F.col("split")))
    codes = ["lbs", "carrier", "consumptionability"]
    # Written, the codes have a size by which Spark broadcasts them.
    rows = E.ordinal_encode(st.with_token_counts(data, ["kw1", "interest1"]), codes, st.by_factor(E.ordinal_dictionary(data, codes), "feature"))
    rows = rows.select("uid", "aid", F.col("aid").alias("_ad"), "label", "split", "kw1cnt", "interest1cnt", *[f"{c}_code" for c in codes],
                       *S.CROSS_FACTORS)
    # Statistics of the label come from the train rows alone: validation rows must not see their own.
    learned = F.col("split") == "train"
    sums = {"clicks": F.sum(F.when(learned, F.col("label"))), "rows": F.count(F.when(learned, 1)), "all": F.count(F.lit(1))}
    counted = st.with_shared(rows, rows, "aid", [*S.CROSS_FACTORS, "_ad"], sums, ["uid", "aid"])
    path = scratch_path(spark, "counted")
    # In an order of their own, so that a fit on them draws the same rows each time.
    (counted.drop("_ad", *[f"_{f}_all" for f in S.CROSS_FACTORS]).sortWithinPartitions("aid", "uid").write.parquet(path))
    stored = spark.read.parquet(path)
    fitted = {r["factor_name"]: r for r in fit_beta(_cells(stored), ["factor_name"], n_cells="n_cells").collect()}

    def smoothed(f):
        a, b = (F.lit(fitted[f][x] if f in fitted and fitted[f][x] is not None else 0.0) for x in ("alpha", "beta"))
        # A value that no train row has at this ad has no cell; a row without a user is looked up nowhere.
        return F.when((F.col(f"_{f}_rows") > 0) & F.col("uid").isNotNull(), smoothed_ratio(F.col(f"_{f}_clicks"), F.col(f"_{f}_rows"), a, b))

    rates = {f"{f}_ctr_smooth": F.coalesce(smoothed(f), F.lit(0.0)) for f in S.CROSS_FACTORS}
    t = stored.withColumns({"delivery": F.col("__ad_all"), "hist_ctr": F.coalesce(F.try_divide(
        F.col("__ad_clicks").cast("double"), F.col("__ad_rows")), F.lit(0.0)), **rates})
    if _told_twice(spark, d):
        # An instance told k times meets the rates of each of its rows.
        t = t.drop(*rates).join(t.select("uid", "aid", *rates), ["uid", "aid"], "left").fillna(0.0, subset=SMOOTH_COLS)
    return t.select("uid", "aid", "label", "split", *[F.col(c).cast("double") for c in NUMERIC + SMOOTH_COLS])


def _cells(stored):
    """(factor_name, clicks, impressions, n_cells) of the train rows: a cell of n rows is told by each of them. Rows
    without an ad, which are looked up nowhere, have their cells too."""
    learned = stored.where(F.col("split") == "train")
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("factor_name"), F.col(f"_{f}_clicks").alias("clicks"), F.col(f"_{f}_rows").alias("impressions"))
                               for f in S.CROSS_FACTORS])).alias("_c")
    known = (learned.where(F.col("aid").isNotNull()).select(told).select("_c.*").groupBy("factor_name", "clicks", "impressions")
             .agg((F.count(F.lit(1)) / F.col("impressions")).cast("bigint").alias("n_cells")))
    no_ad = st.ctr_by_value_aid(learned.where(F.col("aid").isNull()), S.CROSS_FACTORS)
    return known.unionByName(no_ad.select("factor_name", "clicks", "impressions", F.lit(1).cast("bigint").alias("n_cells")))


def _told_twice(spark, d) -> bool:
    """Whether a user or an ad has more than one row, and so an instance too."""
    return any(not x.groupBy(*x.columns).count().where("count > 1").isEmpty()
               for x in (S.users(spark, d).select("uid"), S.ad_features(spark, d).select("aid")))


def _assembled(t, cols):
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(t)


def _scored_test(model, test):
    out = M.score(model, test)
    return out.select("aid", "uid", r6(F.col(M.SCORE)).alias("score"))


# ----------------------------------------------------------------------------- T1-T7, E8, S16
ALL_COLS = NUMERIC + SMOOTH_COLS
# Fixed values of the reference's linear models: tolerance and iterations; C is the inverse penalty.
TOL, LR_ITER = 1e-4, 150
# Fixed values of the tree models: least child weight, leaf penalty; of the second one also its rate and rounds.
TREES = {"min_child": 50, "reg_lambda": 1.0}
ALT = {**TREES, "step_size": 0.05, "subsample": 0.7, "feature_subset": "0.7", "rounds": 1500}


def _parts(t):
    """(train, valid, test) rows, the first two labelled."""
    return (t.where(F.col("split") == "train"), t.where(F.col("split") == "valid"), t.where(F.col("split") == "test"))


def _lr(train, c: float, l1_ratio: float = 0.0, max_iter: int = LR_ITER, weight_col: str | None = None):
    """Logistic regression whose penalty is 1 / C over the summed loss: Spark's is per row."""
    return M.logreg(reg_param=1.0 / (c * train.count()), l1_ratio=l1_ratio, max_iter=max_iter, tol=TOL, weight_col=weight_col)


@register("gbt_score")
def gbt_score(spark, d):
    """Depth-5 trees, learning rate 0.02, 70 % row and feature subsampling, at least 50 rows in a leaf,
    leaf penalty 1, stopped when the AUC of the validation rows has not grown for 100 rounds;
    scores the test rows."""
    train, valid, test = _parts(_assembled(model_table(spark, d), ALL_COLS))
    model, *_ = M.boost(train, valid, **TREES)
    return _scored_test(model, test)


@register("gbt_score_alt")
def gbt_score_alt(spark, d):
    """Learning rate 0.05, 70 % of rows and features, at least 50 rows in a leaf, leaf penalty 1, at most
    1500 rounds, early stop."""
    train, valid, test = _parts(_assembled(model_table(spark, d), ALL_COLS))
    model, *_ = M.boost(train, valid, **ALT)
    return _scored_test(model, test)


@register("logreg_score")
def logreg_score(spark, d):
    """L1 logistic regression (C = 1), balanced class weights of the train rows; score and
    hard label."""
    train, _, test = _parts(_assembled(model_table(spark, d), ALL_COLS))
    train = instances.balanced_weights(train)
    out = M.score(M.fit(_lr(train, 1.0, l1_ratio=1.0, weight_col="weight"), train), test)
    return out.select("aid", "uid", r6(F.col(M.SCORE)).alias("score"), F.col("prediction").cast("int").alias("pred"))


@register("logreg_l2")
def logreg_l2(spark, d):
    """L2 logistic regression (C = 0.01) on the assembled one-hot, token and numeric matrix."""
    from ctrkit.plans.q_encode import design_rows
    rows, _ = design_rows(spark, d)
    rows = instances.hash_split(rows, ["uid", "aid"], 70)
    train = rows.where(F.col("label").isNotNull() & (F.col("split") == "train"))
    return _scored_test(M.fit(_lr(train, 0.01), train), rows.where(F.col("label").isNull()))


@register("logreg_elastic")
def logreg_elastic(spark, d):
    """T4: log-loss linear model with elastic-net penalty (alpha 0.001, l1_ratio 0.15)."""
    train, _, test = _parts(_assembled(model_table(spark, d), ALL_COLS))
    return _scored_test(M.fit(M.logreg(reg_param=0.001, l1_ratio=0.15, max_iter=LR_ITER, tol=TOL), train), test)


@register("stacked_score")
def stacked_score(spark, d):
    """T5: an L2 logistic regression (C = 500) over the noisy-or column of every token field becomes
    one more input of the trees."""
    from ctrkit.plans.q_stats import token_noisy_or_filled
    t = model_table(spark, d)
    learned = S.data_all(spark, d).join(t.where(F.col("split") == "train").select("uid", "aid"), ["uid", "aid"], "left_semi")
    wide = (token_noisy_or_filled(spark, d, learned).groupBy("uid", "aid").pivot("factor_name", S.TOKEN_FACTORS)
            .agg(F.first("noisy_or")))
    cols = [f"{f}_noisy_or" for f in S.TOKEN_FACTORS]
    wide = wide.select("uid", "aid", *[F.coalesce(F.col(f), F.lit(0.0)).alias(c) for f, c in zip(S.TOKEN_FACTORS, cols)])
    t = t.join(wide, ["uid", "aid"], "left").fillna(0.0, subset=cols).checkpoint()
    train, _, _ = _parts(t)
    lr = M.fit(_lr(train, 500.0), train, cols)
    stacked = M.score(lr, t, out="lr_score").drop("features", "rawPrediction", "probability", "prediction").checkpoint()
    train, valid, test = _parts(_assembled(stacked, NUMERIC + ["lr_score"]))
    model, *_ = M.boost(train, valid, **TREES)
    out = M.score(model, test)
    return out.select("aid", "uid", r6(F.col("lr_score")).alias("lr_score"), r6(F.col(M.SCORE)).alias("score"))


def leaf_model(spark, d):
    """(model, rows): the early-stopped trees, and the rows with split."""
    t = _assembled(model_table(spark, d), ALL_COLS)
    train, valid, _ = _parts(t)
    model, *_ = M.boost(train, valid, **TREES)
    return model, t


@register("leaf_features")
def leaf_features(spark, d):
    """The leaf one-hot matrix, one cell per tree at column tree * 2^depth + leaf."""
    model, t = leaf_model(spark, d)
    return M.leaf_cells(model, t, ["uid", "aid"])


@register("leaf_logreg")
def leaf_logreg(spark, d):
    """E8 -> T3: L2 logistic regression (C = 0.001) on the leaf one-hot matrix; AUC of each split."""
    model, t = leaf_model(spark, d)
    rows = M.leaf_vectors(model, t, ["uid", "aid", "label", "split"])
    train, valid, _ = _parts(rows)
    model = M.fit(_lr(train, 0.001), train)
    return spark.createDataFrame([(n, M.auc_of(M.score(model, x))) for n, x in (("train", train), ("valid", valid))],
                                 "split string, auc double")


@register("model_roundtrip")
def model_roundtrip(spark, d):
    """Fitted pipeline saved to the shared folder, loaded, applied."""
    from pyspark.ml import PipelineModel
    train, _, test = _parts(model_table(spark, d))
    model = M.fit(_lr(train, 0.01), train, ALL_COLS)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    return _scored_test(PipelineModel.load(path), test)


# ----------------------------------------------------------------------------- M3, M5-M8
FOLDS = 5


@register("cv_auc_curve")
def cv_auc_curve(spark, d):
    """M3: per boosting round the mean and population standard deviation of the held-out AUC over
    five hash folds, up to the patience after the best mean."""
    from ctrkit.functions.hashing import hash_bucket
    t = _assembled(model_table(spark, d), ALL_COLS).where(F.col("label").isNotNull())
    t = t.withColumn("fold", hash_bucket(["uid", "aid"], FOLDS, "fold"))
    out = M.cv_curve(t, "fold", FOLDS, **TREES)
    return out.select("round", r6(F.col("mean_auc")).alias("mean_auc"), r6(F.col("std_auc")).alias("std_auc"))


@register("feature_add_curve")
def feature_add_curve(spark, d):
    """M4 / M5: early-stopped trees refitted with each smoothed-CTR feature alone beside a fixed base, then
    with the features added one after the other; train and valid AUC of each."""
    base = ["kw1cnt", "interest1cnt"]
    train, valid, _ = _parts(_assembled(model_table(spark, d), base + SMOOTH_COLS))
    train, valid = train.select("label", "features").cache(), valid.select("label", "features").cache()
    steps = range(len(SMOOTH_COLS))
    trials = [("alone", i, [0, 1, 2 + i]) for i in steps] + [("cumulative", i, [0, 1, *range(2, 3 + i)]) for i in steps]
    aucs = M.trial_columns(train, valid, [columns for *_, columns in trials], **TREES)
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame([(mode, i, SMOOTH_COLS[i], a, v, n) for (mode, i, _), (a, v, n) in zip(trials, aucs)],
                                 "mode string, step int, feature string, train_auc double, valid_auc double, rounds int")


# Fixed values of the reference's cut search: the N that it starts from, and the rounds of its trees, which see
# all rows and columns.
CUT_FROM = 100
CUT_TREES = {**TREES, "rounds": 300, "subsample": 1.0, "feature_subset": "all"}


def cut_rows(spark, d):
    """(rows for ``cut_trials`` over kw1, the cuts from min(100, vocabulary) down to 1)."""
    t = model_table(spark, d)
    ranked = T.rank_tokens(T.token_importance(S.data_all(spark, d), ["kw1"])).select("single_value", "rank").checkpoint()
    top = min(CUT_FROM, ranked.count())
    # A user's tokens, which all rows of the user share.
    users = S.data_all(spark, d).select("uid", "kw1").distinct()
    counts = T.rank_counts(users.select("kw1").distinct(), "kw1", ranked, top)
    rows = (t.where(F.col("label").isNotNull()).join(users.join(counts, "kw1").withColumnRenamed("uid", "_uid"), F.col("uid").eqNullSafe(F.col("_uid")))
            .select("split", "label", F.array(*SMOOTH_COLS).alias("base"), "counts"))
    path = scratch_path(spark, "cut-rows")
    rows.write.parquet(path)
    return spark.read.parquet(path), list(range(top, 0, -1))


@register("cut_search")
def cut_search(spark, d):
    """M6: for every N from min(100, vocabulary) down to 1, keep the top N tokens of kw1 and count the
    others as one, refit and log (top_n, train_auc, valid_auc). The refit is the linear model, all cuts in shared
    passes; with ``models.boosted_trial`` and ``CUT_TREES`` it is the trees (the README has the times of both)."""
    rows, tops = cut_rows(spark, d)
    train, valid, _ = _parts(rows)
    reg, width = 1.0 / (0.01 * train.count()), len(SMOOTH_COLS) + len(tops) + 1
    features = F.concat("base", F.col("counts").cast("array<double>"))
    # A cut's last column is the sum of the counts behind it, so each of them has its coefficient.
    views = [np.eye(width)[:, :len(SMOOTH_COLS) + n + 1] for n in tops]
    for view in views:
        view[view.shape[1]:, -1] = 1.0
    found = L.fit_many(train, features, [(view, reg, LR_ITER) for view in views], TOL)
    if found is None:
        fits = M.cut_trials(rows, tops, lambda train, _: [M.fit(M.logreg(reg_param=reg, max_iter=LR_ITER, tol=TOL), train).stages[-1]])
        found = [(m.coefficients.toArray(), m.intercept) for _, m in fits]
    models = [(view @ w, b) for view, (w, b) in zip(views, found)]
    return spark.createDataFrame([(n, a, v) for n, a, v in zip(tops, *(M.linear_aucs(x, features, models) for x in (train, valid)))],
                                 "top_n int, train_auc double, valid_auc double")


# Fixed values of the reference's four grids: (name, penalty settings, second settings).
SGD_GRID = [(10.0 ** -k, n) for k in range(1, 7) for n in (2, 5, 10)]
ELASTIC_GRID = [(0.004, r) for r in (0.001, 0.01, 0.05, 0.07)]
LR_GRIDS = {"lr_stacked": [(c, n) for c in (0.0002, 0.0004, 0.0006, 0.0008) for n in (100, 150)],
            "lr": [(c, n) for c in (1.0, 0.1, 0.01, 0.001, 0.0001) for n in (100, 150)]}


@register("grid_search")
def grid_search(spark, d):
    """M7: the four grids of the linear models, train / valid AUC per cell. Penalties are L2 but for
    the elastic-net grid; ``alpha`` is a penalty per row, C an inverse one over the summed loss. Cells of an L2 penalty
    are fitted in shared passes, the others in parallel on one cached table."""
    train, valid, _ = _parts(_assembled(model_table(spark, d), ALL_COLS))
    train, valid = train.cache(), valid.cache()
    rows, features = train.count(), vector_to_array("features")
    # (grid, penalty, setting) -> (penalty per row, L1 share, most iterations, tolerance)
    cells = {("sgd", a, float(n)): (a, 0.0, n, TOL) for a, n in SGD_GRID}
    cells |= {("elastic", a, r): (a, r, 1000, 1e-6) for a, r in ELASTIC_GRID}
    cells |= {(g, c, float(n)): (1.0 / (c * rows), 0.0, n, TOL) for g, grid in LR_GRIDS.items() for c, n in grid}
    ridge = [cell for cell, (_, share, *_) in cells.items() if not share]
    together = L.fit_many(train, features, [(None, cells[cell][0], cells[cell][2]) for cell in ridge], TOL)
    models = dict(zip(ridge, together or []))
    alone = [cell for cell in cells if cell not in models]

    def fitted(cell):
        reg, share, most, tol = cells[cell]
        model = M.fit(M.logreg(reg_param=reg, l1_ratio=share, max_iter=most, tol=tol), train).stages[-1]
        return model.coefficients.toArray(), model.intercept

    models |= zip(alone, M.in_parallel([lambda c=c: fitted(c) for c in alone]))
    aucs = [M.linear_aucs(x, features, [models[cell] for cell in cells]) for x in (train, valid)]
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame([(*cell, a, v) for cell, a, v in zip(cells, *aucs)],
                                 "grid string, penalty double, setting double, train_auc double, valid_auc double")


@register("importance_by_value")
def importance_by_value(spark, d):
    """M8: importances of the early-stopped trees on the one-hot / token-count / numeric matrix, mapped
    to (feature, value) through the column dictionary, which names every column."""
    from ctrkit.plans.q_encode import design_rows
    rows, dictionary = design_rows(spark, d)
    rows = instances.hash_split(rows.where(F.col("label").isNotNull()), ["uid", "aid"], 70)
    model, *_ = M.boost(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "valid"), **TREES)
    imp = model.featureImportances
    pairs = [(int(i), float(v)) for i, v in zip(imp.indices, imp.values)]
    imps = spark.createDataFrame(pairs, "col_index bigint, importance double")
    out = imps.join(dictionary, "col_index", "left")
    return out.select("feature", "val", "col_index", r6(F.col("importance")).alias("importance"))
