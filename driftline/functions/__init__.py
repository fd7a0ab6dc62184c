from driftline.functions.labels import duration_text, level_rank, op_label
from driftline.functions.lsn import (
    ZERO_LSN,
    is_lsn,
    lsn_format,
    lsn_increment,
    lsn_parse,
    lsn_text,
)
from driftline.functions.text import csv_field, csv_rows, header_line, row_size, value_text
from driftline.functions.times import local_time, millis_between

__all__ = [
    "ZERO_LSN",
    "csv_field",
    "csv_rows",
    "duration_text",
    "header_line",
    "is_lsn",
    "level_rank",
    "local_time",
    "lsn_format",
    "lsn_increment",
    "lsn_parse",
    "lsn_text",
    "millis_between",
    "op_label",
    "row_size",
    "value_text",
]
