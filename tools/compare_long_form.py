"""Time the long-form statistics job (all factors, one aggregation) against one
aggregation job per factor, on the prepared instance table.

usage: python tools/compare_long_form.py [sf_dir] [repeat]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    repeat = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    from ctrkit.operators import stats as st
    from ctrkit.plans import standin as S
    from ctrkit.session import build_session

    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.ui.showConsoleProgress": "false"})
    lab = S.labelled(spark, sf_dir)

    def long_form():
        st.ctr_by_value_aid(lab, S.CROSS_FACTORS).write.format("noop").mode("overwrite").save()

    def per_factor():
        for f in S.CROSS_FACTORS:
            st.click_stats(lab, [f, "aid"]).write.format("noop").mode("overwrite").save()

    out = {}
    for name, fn in [("long_form_one_job", long_form), ("one_job_per_factor", per_factor)]:
        fn()
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(runs), 3)
    print(json.dumps({"sf_dir": sf_dir, "factors": len(S.CROSS_FACTORS), "median_sec": out}))
    spark.stop()


if __name__ == "__main__":
    main()
