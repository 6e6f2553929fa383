"""Headline queries, timed.  Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattline.checks import registered_queries
from wattline.session import build_session

HEADLINE = ["twa_end_5m", "twa_hourly_reweighted", "zone_prices_hourly", "asof_last_click", "asof_last_order", "overlapping_spans", "known_outages", "exact_quantiles", "score_table", "oos_fold_scores",
            "combine_inverse_mae", "adaptive_conformal", "backtest_overfitting", "superior_predictive_ability", "sparse_gram", "cobinding_graph", "node_coefficients", "strategy_statistics", "panel_lag_features"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered_queries()
    spark.read.parquet(f"{root}/region.parquet").count()          # JVM and reader start-up stay out of the timings
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": root.rstrip("/").rsplit("sf", 1)[-1]}))


main()
