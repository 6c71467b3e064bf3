"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each, and their sum.

Each query runs once to warm up and then three times; the median counts. Results are written to the noop sink, so every row
is made. The last figures compare with published throughput: rows a second under rules and through a model, and what
provenance and monitoring add to the bare query.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "flagship_guarded_group", "guard_bare_result", "guard_after_limit", "scan_guard_join", "sql_groupby", "sql_join_inner", "sql_window_rank", "sql_topk", "datalog_var_join",
    "datalog_range_join", "predict_value", "predict_class", "model_udf_inline", "prov_poly_merge", "explain_stats", "transe_score",
)


def timed(run, times: int = 3) -> float:
    run()
    out = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        out.append(time.perf_counter() - t)
    return statistics.median(out)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera import queries
    from tessera.hitl.monitor import Monitor
    from tessera.operators import provenance

    sink = lambda frame: frame.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        frame = queries.QUERIES[name](spark, sf_dir)
        seconds[name] = round(timed(lambda f=frame: sink(f)), 4)
    lines = queries.table(spark, sf_dir, "lineitem")
    n = lines.count()
    s = queries.session(spark, sf_dir, ("l_discount > 0.05 AND l_quantity > 25 AND l_returnflag = 'R'",))
    guarded = s.sql("SELECT * FROM lineitem").frame
    bare = timed(lambda: sink(lines))
    traced = timed(lambda: sink(provenance.attach(lines)))
    watched = timed(lambda: sink(Monitor(("l_discount",)).attach(lines)[0]))
    both = timed(lambda: sink(Monitor(("l_discount",)).attach(provenance.attach(lines))[0]))
    file_model = timed(lambda f=queries.onnx_predict(spark, sf_dir): sink(f))
    whole = timed(lambda: sink(queries.QUERIES["guard_bare_result"](spark, sf_dir)))
    extra = {
        "rule_filter_rows_per_sec": round(n / timed(lambda: sink(guarded))),
        "model_rows_per_sec": round(n / seconds["predict_value"]),
        "bare_scan_sec": round(bare, 4),
        "provenance_scan_sec": round(traced, 4),
        "monitor_scan_sec": round(watched, 4),
        "provenance_and_monitor_scan_sec": round(both, 4),
        "monitor_rows_per_sec": round(n / watched),
        "model_file_rows_per_sec": round(n / file_model),
        "guard_with_session_and_planning_sec": round(whole, 4),
    }
    print(json.dumps({"metric": "headline queries, median seconds summed", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "extra": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
