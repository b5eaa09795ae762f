"""Registry of the queries the package answers: name -> (spark job, oracle SQL).

Every job takes ``(spark, sf_dir)`` and returns a DataFrame built from the
data directory's tables; nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotline.plans import (
    diff,
    files,
    ingest,
    lotperf,
    nested,
    oracle_diff,
    oracle_files,
    oracle_lotperf,
    oracle_nested,
    oracle_readback,
    oracle_requests,
    oracle_testtime,
    oracle_textjobs,
    oracle_units,
    readback,
    requests,
    testtime,
    textjobs,
    units,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "unit_results_extract": units.q_unit_results_extract,
        "bin_pareto": units.q_bin_pareto,
        "unit_exceptions": units.q_unit_exceptions,
        "run_summary": units.q_run_summary,
        "lot_performance": lotperf.q_lot_performance,
        "lot_performance_lots": lotperf.q_lot_performance_lots,
        "lab_report": lotperf.q_lab_report,
        "product_targets": lotperf.q_product_targets,
        "target_compare": lotperf.q_target_compare,
        "parse_durations": testtime.q_parse_durations,
        "common_bin": testtime.q_common_bin,
        "avg_test_times": testtime.q_avg_test_times,
        "lot_ttg": testtime.q_lot_ttg,
        "lot_ttg_global": testtime.q_lot_ttg_global,
        "program_delta": testtime.q_program_delta,
        "top_delta": testtime.q_top_delta,
        "snapshot_added": diff.q_snapshot_added,
        "snapshot_removed": diff.q_snapshot_removed,
        "change_log": diff.q_change_log,
        "diff_counts": diff.q_diff_counts,
        "diff_counts_dropna": diff.q_diff_counts_dropna,
        "flatten_limits": nested.q_flatten_limits,
        "leak_class_limits": nested.q_leak_class_limits,
        "flatten_modes": nested.q_flatten_modes,
        "mode_counts": nested.q_mode_counts,
        "program_lines": textjobs.q_program_lines,
        "extract_instances": textjobs.q_extract_instances,
        "extract_instances_lite": textjobs.q_extract_instances_lite,
        "instance_counts": textjobs.q_instance_counts,
        "instance_crosstab": textjobs.q_instance_crosstab,
        "extract_limits": textjobs.q_extract_limits,
        "limits_long": textjobs.q_limits_long,
        "pin_groups": textjobs.q_pin_groups,
        "pins_per_group": textjobs.q_pins_per_group,
        "pin_group_match": textjobs.q_pin_group_match,
        "group_match_counts": textjobs.q_group_match_counts,
        "resources": textjobs.q_resources,
        "page_ids": textjobs.q_page_ids,
        "limits_join": textjobs.q_limits_join,
        "match_rate": textjobs.q_match_rate,
        "request_order": requests.q_request_order,
        "request_spans": requests.q_request_spans,
        "request_ids": requests.q_request_ids,
        "request_fill": requests.q_request_fill,
        "request_status": requests.q_request_status,
        "lot_list": requests.q_lot_list,
        "lot_batches": requests.q_lot_batches,
        **ingest.QUERIES,
        **files.QUERIES,
        **readback.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(oracle_units.SQL)
    out.update(oracle_lotperf.SQL)
    out.update(oracle_testtime.SQL)
    out.update(oracle_diff.SQL)
    out.update(oracle_nested.SQL)
    out.update(oracle_textjobs.SQL)
    out.update(oracle_requests.SQL)
    out.update(oracle_files.SQL)
    out.update(oracle_readback.SQL)
    return out
