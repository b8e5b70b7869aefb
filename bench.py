"""Headline timings. Prints one JSON line; BENCH_SF_DIR, BENCH_CPUS and BENCH_MEMORY choose data, cores and heap."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tempolog.operators import features, gaps  # noqa: E402
from tempolog.queries import QUERIES, read  # noqa: E402
from tempolog.session import build_session, scratch  # noqa: E402
from tempolog.sources.events import as_events  # noqa: E402

HEADLINES = [
    "user_gaps", "otsu_threshold", "elbow_threshold", "session_rollup", "user_robust_stats", "robust_z", "rolling_quartiles",
    "transition_matrix", "lognormal_params", "session_sequences", "group_kfold", "score_events", "category_thresholds",
    "roc_auc", "macro_auc", "detection_delay", "contract_violations", "pseudonymize", "resample_linear", "step_response",
    "detect_order", "detect_token_replay", "inject_time_propagate", "inject_token_replay", "audit_table",
]


def lineitem_features(spark, folder):
    """The whole feature pipeline on the largest table: shipments as events of their supplier."""
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = as_events(read(spark, folder, "lineitem"), "l_suppkey", "l_shipdate", "l_returnflag", tie)
    line = gaps.auto_sessions(rows, tie)
    return features.deltify(line).rows


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    runs = {name: QUERIES[name] for name in HEADLINES} | {"lineitem_features": lineitem_features}
    seconds = {}
    for name, query in runs.items():
        start = time.perf_counter()
        with scratch(spark):
            query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
