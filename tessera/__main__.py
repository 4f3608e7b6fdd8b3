"""Command line: ``python -m tessera --data-dir DIR --query SQL``."""

from __future__ import annotations

import argparse

from .api import Engine
from .session import DEFAULT_BUDGET


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Run one query over a directory of Parquet files.")
    parser.add_argument("--data-dir", required=True, help="folder; each NAME.parquet becomes table NAME")
    parser.add_argument("--query", required=True, help="one SELECT")
    parser.add_argument("--target-partitions", type=int, default=None, help="shuffle partitions (default: cores)")
    parser.add_argument("--memory-budget", type=int, default=DEFAULT_BUDGET, help="bytes for a scan batch (default: 2 GiB)")
    parser.add_argument("--rows", type=int, default=50, help="rows to print")
    parser.add_argument("--explain", action="store_true", help="print the plan and the memory model instead of rows")
    given = parser.parse_args(args)
    engine = Engine(given.data_dir, target_partitions=given.target_partitions, memory_budget=given.memory_budget)
    if given.explain:
        found = engine.execute_instrumented(given.query)
        print(found.plan)
        print(f"bytes for each scan row: peak {int(found.estimate.peak)}, cost {found.estimate.cost}; batch rows: {found.estimate.batch_rows(given.memory_budget)}")
        for n in found.nodes:
            print(f"{'  ' * n.depth}{n.name}: rows {n.rows}")
    else:
        engine.sql(given.query).show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
