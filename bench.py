"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from chronoweave import catalogue
from chronoweave.session import local_session

HEADLINE = [
    "forecast_slice", "resample_hourly_grid", "linear_interp_grid", "rolling_mean_std_7_14", "rolling_bands", "lag_features", "expanding_stats", "control_chart", "histogram_30",
    "percentile_bands", "hierarchy_rollup", "asof_last_view", "corr_matrix", "decompose_additive", "acf_24", "ses_fixed", "naive_cv", "arima_forecast", "holt_winters", "monte_carlo",
    "keyword_trend", "term_counts_top", "page_links", "knn_embeddings",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8, memory="12g")
    took = {}
    catalogue.QUERIES["distinct_types"](spark, d).collect()  # starts the session
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
