"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bars_daily", "bars_brand", "gk_variance", "realized_vol", "perf_summary", "combined_signal", "pair_correlation", "spearman_pairs",
    "hurst_scaling", "leverage_kernel", "clean_panel_ffill", "portfolio_pnl", "exposure_brakes", "asof_regime_join", "cscv_pbo", "hrp_weights",
    "hmm_regimes", "core_book",
)


def main() -> None:
    from quantloom.plans.registry import QUERIES
    from quantloom.session import session

    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{data}/lineitem.parquet").count()  # starts the session's workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
