"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3: the median counts, after one
untimed warm-up). Every job runs over the whole tables and its result is consumed in full.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from checks import streams
from checks.registry import cohort, customers, history
from ebbtide.features.build import feature_table
from ebbtide.operators import blend, correlation, metrics
from ebbtide.plans import oof
from ebbtide.runtime import materialize
from ebbtide.session import local_session


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "ebbtide-bench")

    # Input tables of the reference's own shape are prepared once; jobs read them as a run on stored tables would.
    h, c, k = (materialize(f(spark, path)) for f in (history, customers, cohort))
    s = materialize(streams.streams(spark, path).withColumn("d", F.col("cust_id") * 104729 % 997 / F.lit(997.0)))
    m = materialize(
        feature_table(h, c, k, ["rfm"], with_demographics=False, winsorize=False).join(
            k, ["cust_id", "ref_date"]).select("cust_id", "ref_date", "churn", *_FEATURES))
    learner = oof.Learner("gbt", {"maxIter": 5, "maxDepth": 4})
    kw = {"with_demographics": False, "winsorize": False, "relative": False, "sentinel": False}

    jobs = {
        "feature_table": lambda: feature_table(h, c, k),
        "multi_window": lambda: feature_table(h, c, k, ["windows"], **kw),
        "rfm_scores": lambda: feature_table(h, c, k, ["rfm"], **{**kw, "relative": True}),
        "monthly_metrics": lambda: metrics.monthly_metrics(
            correlation.to_long(s, streams.ABC, [*streams.IDS, "y"]), ["model"], None),
        "candidate_search": lambda: blend.best_candidates(s, _STREAMS, blend.simplex_grid(_STREAMS, 20), last_n=6),
        "rank_correlation": lambda: correlation.spearman_pairs(s, streams.ABC, streams.IDS),
        "fold_fit": lambda: oof.train_oof(m, _FEATURES, learner, last_n=1, seeds=(1,)).oof,
    }
    took: dict[str, float] = {}
    for name, job in jobs.items():
        times = []
        for i in range(runs + 1):
            t = time.time()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
            print(f"{name} run {i}: {times[-1]:.2f}s", file=sys.stderr, flush=True)
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


_STREAMS = [*streams.ABC, "d"]  # 1 771 weight vectors in steps of a twentieth
_FEATURES = ["rfm_recency_days", "rfm_frequency_count", "rfm_monetary_value", "rfm_recency_exp_weighted",
             "rfm_frequency_count_3m", "rfm_monetary_value_6m"]

if __name__ == "__main__":
    main()
