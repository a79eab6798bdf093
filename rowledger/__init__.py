"""Compare, review and merge versions of keyed tables on Spark."""

from rowledger.plans.run import compare, export_tables, generate_change_log, integrate, integrate_changes

__all__ = ["compare", "export_tables", "generate_change_log", "integrate", "integrate_changes"]
