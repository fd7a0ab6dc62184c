from driftline.sources.catalog import (
    extraction_mode,
    key_check,
    schema_changed,
    schema_manifest,
    table_profile,
)
from driftline.sources.changes import (
    change_order,
    change_project,
    change_scan,
    commit_time,
    event_dedup,
    label_changes,
    lsn_high,
    lsn_low,
    lsn_range,
    op_counts,
    retention_purge,
)
from driftline.sources.server import map_changes, server_changes, server_positions
from driftline.sources.tables import jdbc_scan, snapshot_scan, snapshot_window_scan

__all__ = [
    "change_order",
    "change_project",
    "change_scan",
    "commit_time",
    "event_dedup",
    "extraction_mode",
    "jdbc_scan",
    "key_check",
    "label_changes",
    "lsn_high",
    "lsn_low",
    "lsn_range",
    "map_changes",
    "op_counts",
    "retention_purge",
    "schema_changed",
    "schema_manifest",
    "server_changes",
    "server_positions",
    "snapshot_scan",
    "snapshot_window_scan",
    "table_profile",
]
