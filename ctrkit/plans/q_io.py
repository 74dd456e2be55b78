"""Source / sink round trips. Each query writes its input, derived from the test
tables, into a fresh folder under the session's shared checkpoint directory and
returns the DataFrame read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from ctrkit.operators import stats as st
from ctrkit.operators.clean import normalise_names
from ctrkit.operators.smoothing import fit_and_smooth, fit_beta, smooth
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import converged_fit_ctes, with_base
from ctrkit.plans.q_core import RAW_HEADER_NAMES
from ctrkit.plans.q_stats import CELLS, LAB_LONG, LAB_TOK, TOK_CELLS, r6
from ctrkit.plans.q_encode import _CELLS_SQL, _MATRIX_CTES, design_rows
from ctrkit.session import scratch_path, shared_root
from ctrkit.sources import files
from ctrkit.sources.profile import PROFILE_KEYS, read_profiles, to_profile_lines

DATA_SCHEMA = ("aid bigint, uid bigint, label bigint, lbs string, house string, carrier string, "
               "consumptionability string, kw1 string, interest1 string, os string, advertiserid string, "
               "producttype string, creativesize string")


@register("scan_delimited", with_base(select="SELECT aid, uid, label FROM train"))
def scan_delimited(spark, d):
    path = scratch_path(spark, "train-csv")
    files.write_csv(S.train_instances(spark, d), path, header=False)
    return files.read_delimited(spark, path, "aid bigint, uid bigint, label bigint")


@register("scan_header_csv", with_base(select="SELECT * FROM data"))
def scan_header_csv(spark, d):
    path = scratch_path(spark, "data-csv")
    files.write_csv(S.data_all(spark, d), path, header=True, compression="gzip")
    return files.read_delimited(spark, path, DATA_SCHEMA, header=True)


@register("scan_stat_csv", with_base(LAB_LONG, CELLS, select="SELECT factor_name, value, aid, clicks, impressions "
                                                             "FROM cells"))
def scan_stat_csv(spark, d):
    path = scratch_path(spark, "stat-csv")
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS).drop("ctr")
    files.write_csv(cells, path, header=False)
    return files.read_delimited(spark, path, "factor_name string, value string, aid bigint, clicks bigint, "
                                             "impressions bigint")


@register("parse_profile_records", with_base(select="SELECT * FROM users_raw"))
def parse_profile_records(spark, d):
    """User dimension -> ``key v v|key v`` text lines -> parsed back (names normalised)."""
    path = scratch_path(spark, "profiles")
    to_profile_lines(S.user_profiles(spark, d), RAW_HEADER_NAMES).write.mode("overwrite").text(path)
    parsed = normalise_names(read_profiles(spark, path, PROFILE_KEYS))
    return parsed.select("uid", *S.USER_COLS)


@register("sink_header_csv", with_base(LAB_TOK, TOK_CELLS, select=(
    "SELECT factor_name, single_value, clicks, impressions, round(clicks / impressions, 6) AS ctr FROM tok_cells")))
def sink_header_csv(spark, d):
    path = scratch_path(spark, "token-stats")
    out = st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS).withColumn("ctr", r6(F.col("ctr")))
    files.write_csv(out, path, header=True)
    return files.read_delimited(spark, path, "factor_name string, single_value string, clicks bigint, "
                                             "impressions bigint, ctr double", header=True)


@register("sink_plain_csv", with_base(
    "x AS (SELECT lbs, aid, CAST(sum(label) AS BIGINT) AS clicks, count(*) AS impressions FROM lab GROUP BY lbs, aid)",
    select="SELECT lbs, aid, clicks, impressions FROM x"))
def sink_plain_csv(spark, d):
    path = scratch_path(spark, "lbs-aid")
    out = st.click_stats(S.labelled(spark, d), ["lbs", "aid"], ctr=None)
    files.write_csv(out, path, header=False)
    return files.read_delimited(spark, path, "lbs string, aid bigint, clicks bigint, impressions bigint")


EXPORT_COLS = ["aid", "uid", "lbs", "carrier", "kw1", "advertiserid", "producttype"]


@register("export_select_csv", with_base(select=f"SELECT {', '.join(EXPORT_COLS)} FROM joined_test"))
def export_select_csv(spark, d):
    path = scratch_path(spark, "test-export")
    files.export_select_csv(S.joined_test(spark, d), EXPORT_COLS, path)
    return files.read_delimited(spark, path, "aid bigint, uid bigint, lbs string, carrier string, kw1 string, "
                                             "advertiserid string, producttype string", header=True)


@register("ctas_roundtrip", with_base(select="SELECT * FROM data"))
def ctas_roundtrip(spark, d):
    name = f"ctrkit_data_{uuid.uuid4().hex[:10]}"
    return files.create_table_as_select(spark, S.data_all(spark, d), name, scratch_path(spark, "ctas"))


@register("overwrite_table", with_base(select="SELECT aid, uid, label, lbs FROM data WHERE label IS NULL"))
def overwrite_table(spark, d):
    """A table of the labelled rows, overwritten by the others; what is read is a copy, and the
    table is dropped."""
    data = S.data_all(spark, d).select("aid", "uid", "label", "lbs")
    name = f"ctrkit_over_{uuid.uuid4().hex[:10]}"
    files.create_table_as_select(spark, data.where("label is not null"), name, scratch_path(spark, "overwrite"))
    out = files.overwrite_table(spark, data.where("label is null"), name)
    shared_root(spark)
    out = out.checkpoint()
    spark.sql(f"DROP TABLE {name}")
    return out


@register("partitioned_stats", with_base(LAB_TOK, TOK_CELLS, select=(
    "SELECT factor_name, single_value, clicks, impressions FROM tok_cells")))
def partitioned_stats(spark, d):
    path = scratch_path(spark, "token-part")
    files.write_partitioned(st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS).drop("ctr"), path)
    return spark.read.parquet(path).select("factor_name", "single_value", "clicks", "impressions")


@register("overwrite_partition", with_base(
    LAB_TOK, TOK_CELLS, *converged_fit_ctes("tok_cells"),
    select=f"SELECT factor_name, single_value, round(CAST(clicks AS DOUBLE), 6) AS clicks, "
           f"round(CAST(impressions AS DOUBLE), 6) AS impressions FROM tok_cells WHERE factor_name <> 'kw1' "
           f"UNION ALL SELECT c.factor_name, c.single_value, round(c.clicks + p.alpha, 6), "
           f"round(c.impressions + p.alpha + p.beta, 6) FROM tok_cells c JOIN fitted p "
           f"ON c.factor_name = p.factor_name WHERE c.factor_name = 'kw1'"))
def overwrite_partition(spark, d):
    """Raw token counts for every field, then only the ``kw1`` partition replaced by
    its smoothed counts; the ``interest1`` partition is untouched."""
    path = scratch_path(spark, "token-overwrite")
    counts = st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS).drop("ctr").select(
        "single_value", F.col("clicks").cast("double").alias("clicks"),
        F.col("impressions").cast("double").alias("impressions"), "factor_name")
    files.write_partitioned(counts, path)
    kw1 = counts.where(F.col("factor_name") == "kw1")
    files.overwrite_partitions(fit_and_smooth(kw1, ["factor_name"]).select(
        "single_value", "clicks", "impressions", "factor_name"), path)
    back = spark.read.parquet(path)
    return back.select("factor_name", "single_value", r6(F.col("clicks")).alias("clicks"),
                       r6(F.col("impressions")).alias("impressions"))


@register("read_partition", with_base(LAB_TOK, TOK_CELLS, select=(
    "SELECT single_value, clicks, impressions FROM tok_cells WHERE factor_name = 'interest1'")))
def read_partition(spark, d):
    path = scratch_path(spark, "token-part")
    files.write_partitioned(st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS).drop("ctr"), path)
    return files.read_partition(spark, path, "interest1").select("single_value", "clicks", "impressions")


@register("save_design_matrix", with_base(
    *_MATRIX_CTES, f"cells AS ({_CELLS_SQL})",
    select="SELECT d.aid, d.uid, d.label, count(c.value) AS nnz, round(coalesce(sum(c.value), 0), 6) AS total "
           "FROM data d LEFT JOIN cells c ON d.uid = c.uid AND d.aid = c.aid GROUP BY d.aid, d.uid, d.label"))
def save_design_matrix(spark, d):
    """Design rows with the label in the same row, written as Parquet and read back."""
    rows, _ = design_rows(spark, d)
    path = scratch_path(spark, "design-saved")
    rows.write.mode("overwrite").parquet(path)
    v = unwrap_udt("features")["values"]
    return spark.read.parquet(path).select("aid", "uid", "label", F.size(v).cast("bigint").alias("nnz"), r6(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("submission_format", with_base(
    LAB_LONG, "cells AS (SELECT factor_name, value, aid, CAST(sum(label) AS BIGINT) AS clicks, count(*) AS impressions "
              "FROM lab_long WHERE factor_name = 'lbs' GROUP BY factor_name, value, aid)",
    *converged_fit_ctes("cells"),
    f"sm AS (SELECT c.value, c.aid, (c.clicks + p.alpha) / (c.impressions + p.alpha + p.beta) AS ctr FROM cells c "
    f"JOIN fitted p ON c.factor_name = p.factor_name)",
    select=f"SELECT t.aid, t.uid, printf('%.8f', round(coalesce(s.ctr, (SELECT alpha / (alpha + beta) "
           f"FROM fitted)), 8)) AS score FROM data t LEFT JOIN sm s "
           "ON t.lbs = s.value AND t.aid = s.aid WHERE t.label IS NULL"))
def submission_format(spark, d):
    """Test rows scored by the smoothed (lbs, aid) CTR, written as ``aid,uid,score``;
    a cell never seen in train gets the prior mean alpha / (alpha + beta)."""
    data = S.data_all(spark, d)
    shared_root(spark)
    cells = st.ctr_by_value_aid(data, ["lbs"]).drop("ctr").checkpoint()
    params = fit_beta(cells, ["factor_name"], materialize=True)
    sm = smooth(cells, params, ["factor_name"]).select(F.col("value").alias("lbs"), "aid", "ctr")
    prior = params.select("factor_name", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior"))
    test = (data.where(F.col("label").isNull()).select("aid", "uid", "lbs", F.lit("lbs").alias("factor_name"))
            .join(sm, ["lbs", "aid"], "left").join(prior, "factor_name", "left")
            .withColumn("ctr", F.coalesce(F.col("ctr"), F.col("prior"))))
    path = scratch_path(spark, "submission")
    files.write_csv(files.submission(test, "ctr"), path, header=True)
    return files.read_delimited(spark, path, "aid bigint, uid bigint, score string", header=True)
