"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores. Each query is run once
untimed and then BENCH_RUNS times (3 by default); the best time counts, and all times are listed.
"""

from __future__ import annotations

import json
import os
import time

from tieout.operators import checks as C
from tieout.plans.suite import Check, run_suite
from tieout.queries import QUERIES
from tieout.queries.registry import STAR, Tables
from tieout.session import build_session

HEADLINE = [
    "compare_month_grain", "compare_row_grain", "compare_duplicate_keys", "compare_dates_as_text", "compare_text_cells",
    "drill_matrix_by_status", "check_duplicates", "check_orphans", "check_value_set_difference", "suite_runs",
    "star_group", "star_group_bucket", "multi_measure_matrix", "iterator_sumx", "filtered_scalar", "ytd", "yoy", "rolling_days",
    "rolling_months", "moving_avg", "measure_suite", "churn", "cumulative_distinct", "dense_rank", "pct_of_total", "top_n_members",
    "histogram", "top_values", "type_inference", "profile_columns", "foreign_keys", "control_totals_verified", "fuzzy_values",
    "impact_closure",
]


def full_suite(spark, folder) -> list[Check]:
    """47 checks of the kinds a proposed suite has, each table against a second read of itself."""
    a, b = Tables(spark, folder).star(), Tables(spark, folder).star()
    made: list[tuple[str, object, tuple, tuple]] = []
    for table in STAR:
        made.append((table, C.row_count, (), ("row_count",)))
        for column in a[table].columns:
            made.append((table, C.distinct_values, (column,), ("distinct_values",)))
    made.append(("lineitem", C.duplicate_keys, (["l_orderkey", "l_linenumber"],), ("duplicate_keys", "extra_rows")))
    made.append(("orders", C.date_coverage, ("o_orderdate",), ("first_date", "last_date", "days")))
    checks = [
        Check(f"c{i}", f"{t} {f.__name__} {args}", f(a[t], *args), f(b[t], *args), values=values, table=t)
        for i, (t, f, args, values) in enumerate(made)
    ]
    return checks[-47:]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    best, every = {}, {}
    for name in names:
        times = []
        for attempt in range(runs + 1):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(round(time.perf_counter() - begun, 3))
        best[name], every[name] = min(times), times
    begun = time.perf_counter()
    outcomes = run_suite(spark, full_suite(spark, folder), parallel=int(cpus)).collect()
    suite = round(time.perf_counter() - begun, 3)
    assert len(outcomes) == 47 and all(r["status"] == "pass" for r in outcomes)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "runs": every,
                "suite_of_47_checks": suite,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
