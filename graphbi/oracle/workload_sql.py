"""DuckDB oracle texts of the graph that is loaded and refreshed from the workload's folders."""

from __future__ import annotations

from graphbi.oracle.chain_sql import chain_sql
from graphbi.plans.workload_queries import BATCHES, STATIC_ROWS


def _static() -> str:
    parts = []
    for n, columns in STATIC_ROWS.items():
        cells = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in columns)
        parts.append(f" union all select '{n}', concat_ws('|', {cells}) from {n}")
    return "".join(parts)


WORKLOAD_SQL = {
    "load_workload_folders": chain_sql([]) + _static(),
    "refresh_batch_files": chain_sql(BATCHES),
}
