"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from speccurve import SpecCurveJob, spec_curve  # noqa: E402
from workload import estimates, reports  # noqa: E402
from workload.panels import panel  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROLES = dict(firm="firm", ind="ind", time="tm", region="region")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("speccurve-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def default_job() -> SpecCurveJob:
    """12 models under four designs."""
    return SpecCurveJob(
        y="y", x="x", must=("c_tax", ["c_size", "c_sbal"]), test=("c_cbal", ["c_retail", "x2"]),
        designs=("no_absorb_robust", "ab_firm_time_cl_firm", "ab_firm_indtime_cl_firm",
                 "ab_firm_time_cl_firm_time"),
        **ROLES,
    )


def wide_job(designs) -> SpecCurveJob:
    """Eight optional controls, 256 models per design."""
    return SpecCurveJob(
        y="y", x="x",
        test=("c_tax", "c_size", "c_sbal", "c_retail", "c_cbal", "x2", "y2", "z"),
        designs=tuple(designs), **ROLES,
    )


PRODUCTS = {"u1": "c_tax * x2", "u2": "c_cbal * c_tax", "u3": "x2 * x2", "u4": "c_tax * c_tax"}


def widest_job() -> SpecCurveJob:
    """Twelve optional controls, 4,096 models, 16 samples."""
    return SpecCurveJob(
        y="y", x="x",
        test=("c_tax", "c_size", "c_sbal", "c_retail", "c_cbal", "x2", "y2", "z", *PRODUCTS),
        designs=("no_absorb_cl_firm",), **ROLES,
    )


def main() -> None:
    spark = session()
    wide = ("no_absorb_robust", "no_absorb_cl_firm")
    runs = {
        "curve_12_models_4_designs": lambda: spec_curve(panel(spark, SF_DIR), default_job()),
        "curve_256_models_2_designs": lambda: spec_curve(panel(spark, SF_DIR), wide_job(wide)),
        "curve_4096_models": lambda: spec_curve(
            panel(spark, SF_DIR).withColumns({k: F.expr(v) for k, v in PRODUCTS.items()}),
            widest_job(),
        ),
    }
    for name in ("within_firm_cluster", "firm_time_designs", "two_way_clusters_nested",
                 "ind_region_time_designs", "singleton_removal", "median_split_by_none",
                 "subgroup_curves"):
        runs[name] = lambda q=estimates.QUERIES[name]: q(spark, SF_DIR)
    for name in ("significance_table", "curve_by_coef", "run_lengths", "best_model",
                 "obs_statistics", "model_detail"):
        runs[name] = lambda q=reports.QUERIES[name]: q(spark, SF_DIR)
    only = sys.argv[1:]
    runs = {name: run for name, run in runs.items() if not only or name in only}
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, run in runs.items():
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
