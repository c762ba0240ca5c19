"""Writers."""

from .tables import params_table, results_table, results_text, write_counts, write_history, write_params, write_results

__all__ = [
    "params_table", "results_table", "results_text", "write_counts", "write_history", "write_params", "write_results",
]
