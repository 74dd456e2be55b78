"""The model table against its plain form: a table of cells, and lookups joined to the rows."""

import pytest
from pyspark.sql import functions as F

from ctrkit.operators import encode as E
from ctrkit.operators import instances
from ctrkit.operators import stats as st
from ctrkit.operators.smoothing import fit_and_smooth
from ctrkit.plans import q_models as Q
from ctrkit.plans import standin as S


def _rows(repeat):
    """Instances with users and ads that are missing, and with instances told more than once."""
    out = []
    for i in range(400):
        uid, aid = (None if i % 41 == 0 else i % 37), (None if i % 43 == 0 else i % 11)
        label = None if i % 5 == 4 else int(i * 7 % 10 < 4)
        out.append((aid, uid, label, str(i % 37 % 4), str(i % 37 % 2), "c" if i % 3 else "-1", str(i % 37 % 5 - 1), " ".join("123"[:1 + i % 3]),
                    "a b" if i % 2 else "-1", "F O" if i % 37 % 2 else "P", "x", "y", "1"))
    once = {(r[0], r[1]): r for r in out}
    kept = list(once.values())
    # The second row of a pair has other values, so each row of the pair meets the rates of both.
    return kept + [(*r[:3], "9", *r[4:]) for r in kept[::7]] if repeat else kept


def _plain(data):
    data = instances.hash_split(data, ["uid", "aid"], 70).withColumn(
        "split", F.when(F.col("label").isNull(), F.lit("test")).otherwise(F.col("split")))
    learned = data.where("split = 'train'")
    smooth = fit_and_smooth(st.ctr_by_value_aid(learned, S.CROSS_FACTORS).drop("ctr"), ["factor_name"])
    sm = st.attach_long(data, ["uid", "aid"], S.CROSS_FACTORS, smooth, "ctr", ["aid"], suffix="_ctr_smooth")
    base = E.ordinal_encode(st.with_token_counts(data, S.TOKEN_FACTORS), ["lbs", "carrier", "consumptionability"])
    base = base.join(st.delivery_volume(data), "aid", "left").join(st.historic_ctr(learned, "aid").select("aid", "hist_ctr"), "aid", "left")
    return base.join(sm, ["uid", "aid"], "left").fillna(0.0, subset=[*Q.SMOOTH_COLS, "hist_ctr"])


@pytest.mark.parametrize("repeat", [False, True])
@pytest.mark.parametrize("hot", [2_000_000, 20])
def test_model_table_is_its_plain_form(spark, monkeypatch, repeat, hot):
    monkeypatch.setattr(st, "HOT_ROWS", hot)
    data = spark.createDataFrame(_rows(repeat), "aid long, uid long, label long, " + ", ".join(f"{c} string" for c in S.DATA_COLS[3:])).checkpoint()
    keys = {c: data.select(c).where(f"{c} is not null").distinct() for c in ("uid", "aid")}
    monkeypatch.setattr(S, "data_all", lambda *_: data)
    monkeypatch.setattr(S, "users", lambda *_: keys["uid"].unionByName(keys["uid"]) if repeat else keys["uid"])
    monkeypatch.setattr(S, "ad_features", lambda *_: keys["aid"])
    t = Q.model_table(spark, "")
    # Numbers alone are stored, and rows that are told once are not joined to their rates.
    assert not set(S.TOKEN_FACTORS) & set(t.columns)
    assert ("Join" in t._jdf.queryExecution().optimizedPlan().toString()) == repeat

    def told(df):
        return sorted(df.select("uid", "aid", "label", "split", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in Q.ALL_COLS]).collect(), key=str)

    want = told(_plain(data))
    assert told(t) == want and len(want) > data.count() * (1.05 if repeat else 0.99)
