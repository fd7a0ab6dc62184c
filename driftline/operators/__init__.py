from driftline.operators.chunks import (
    chunk_assign_greedy,
    chunk_assign_offset,
    chunk_stats,
    running_total,
    write_chunks,
)
from driftline.operators.keyed import keyed_merge, latest_per_key, salted_lookup
from driftline.operators.ledger import (
    commit_once,
    committed_chunks,
    ledger_check,
    publish,
    read_committed,
    step_check,
)
from driftline.operators.logs import log_fields, log_lines, log_query
from driftline.operators.reports import (
    dataset_totals,
    inactive_runs,
    lag_report,
    newest_run_duration,
    recent_runs,
    run_details,
    run_details_nested,
    run_status,
    run_summary,
    superseded_runs,
)

__all__ = [
    "chunk_assign_greedy",
    "chunk_assign_offset",
    "chunk_stats",
    "commit_once",
    "committed_chunks",
    "dataset_totals",
    "inactive_runs",
    "keyed_merge",
    "lag_report",
    "latest_per_key",
    "ledger_check",
    "log_fields",
    "log_lines",
    "log_query",
    "newest_run_duration",
    "publish",
    "read_committed",
    "recent_runs",
    "run_details",
    "run_details_nested",
    "run_status",
    "run_summary",
    "running_total",
    "salted_lookup",
    "step_check",
    "superseded_runs",
    "write_chunks",
]
