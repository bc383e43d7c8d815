"""Conservative cleaning and profiling of messy tables on Spark."""

from sieveframe.operators.profile import column_stats, invalid_dates, missing_report, mixed_type_columns, profile
from sieveframe.operators.rows import drop_empty, duplicate_count, exact_dedup
from sieveframe.plans.clean import OPERATIONS, CleanResult, clean, reconcile
from sieveframe.session import build_session, scratch_folder
from sieveframe.sinks.layout import write_in_order, write_result_in_order
from sieveframe.sinks.parts import assign_parts, part_files, write_parts, write_result
from sieveframe.sinks.report import write_report
from sieveframe.sources.tables import SourceTable, as_table, read_table

__all__ = [
    "OPERATIONS", "CleanResult", "SourceTable", "as_table", "assign_parts", "build_session", "clean",
    "column_stats", "drop_empty", "duplicate_count", "exact_dedup", "invalid_dates", "missing_report",
    "mixed_type_columns", "part_files", "profile", "read_table", "reconcile", "scratch_folder", "write_in_order",
    "write_parts", "write_report", "write_result", "write_result_in_order",
]
