"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; BENCH_SCRATCH names a folder
for intermediate tables (default: below the warehouse folder).
"""

import json
import os
import sys
import time

from wattline import catalog
from wattline.session import local_session, scratch_run

HEADLINES = (
    "table_contract_months", "table_regional_months", "regional_with_distributors_c02", "contract_features_by_activity_c10",
    "contract_features_future_c11", "billed_power_by_tariff_c20", "group_describe_c25", "asof_latest_month_d07", "upsert_contract_forecast_d18",
    "growth_features_e02", "tariff_band_split_f07", "contract_allocation_by_region_f08", "monthly_correction_f14", "best_model_g03",
    "residual_interval_g06", "weather_regression_g10", "linear_trend_forecast_h12", "mean_reverting_growth_h10", "nearest_contracts_h21",
    "short_term_selection_h30", "gaussian_process_horizon_h18",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), scratch=os.environ.get("BENCH_SCRATCH"))
    queries = catalog.load()[0]
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start-up is not a query
    seconds = {}
    for name in HEADLINES:
        t0 = time.time()
        with scratch_run(spark):
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
