"""Command line: ``python -m salespanel <command> ...``.

  run       --raw-dir DIR (three CSVs) | --sf-dir DIR (driver tables) [--artifacts ROOT] [--run-id ID]
            [--impute-fit all|train] [--unknown-bool null|true] [--csv PATH]
            [--num-trees N] [--max-depth N] [--max-bins N]
  runs      --artifacts ROOT                      list runs, newest first
  validate  --data PATH --contract PATH           PASS/FAIL of a clean table against a contract
  forecast  --run-dir DIR                         hold-out forecast per date of a finished run

The session comes from spark-submit / the environment (``--master`` is only
for local use); run artifacts go under ``spark.checkpoint.dir`` unless
``--artifacts`` names another shared folder.
"""

from __future__ import annotations

import argparse
import json
import sys

from salespanel.operators.model import FOREST_MAX_BINS, FOREST_MAX_DEPTH, FOREST_TREES
from salespanel.session import build_session


def _print_all(df) -> None:
    """Every row, tab-separated, under a line of column names; partitions come one at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="salespanel")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw-dir")
    src.add_argument("--sf-dir")
    r.add_argument("--artifacts")
    r.add_argument("--run-id")
    r.add_argument("--impute-fit", choices=("all", "train"), default="all")
    r.add_argument("--unknown-bool", choices=("null", "true"), default="null")
    r.add_argument("--csv", help="also export the clean table as CSV here")
    r.add_argument("--num-trees", type=int, default=FOREST_TREES)
    r.add_argument("--max-depth", type=int, default=FOREST_MAX_DEPTH)
    r.add_argument("--max-bins", type=int, default=FOREST_MAX_BINS)
    ls = sub.add_parser("runs")
    ls.add_argument("--artifacts", required=True)
    v = sub.add_parser("validate")
    v.add_argument("--data", required=True)
    v.add_argument("--contract", required=True)
    f = sub.add_parser("forecast")
    f.add_argument("--run-dir", required=True)
    a = ap.parse_args(argv)

    spark = build_session(a.master)
    if a.cmd == "run":
        from salespanel.plans.pipeline import run_pipeline
        sources = None
        if a.sf_dir:
            from salespanel.plans.panel import written_sources
            sources = written_sources(spark, a.sf_dir)
        st = run_pipeline(spark, raw_dir=a.raw_dir, sources=sources, artifacts_root=a.artifacts,
                          run_id=a.run_id, impute_fit=a.impute_fit, unknown_bool=a.unknown_bool,
                          csv_path=a.csv, num_trees=a.num_trees, max_depth=a.max_depth, max_bins=a.max_bins)
        print(json.dumps({**st.metadata(), "stage_seconds": st.extra.get("stage_seconds")}, default=str))
        return 0 if st.status == "COMPLETED" else 1
    if a.cmd == "runs":
        from salespanel.plans.runs import list_runs, run_history
        _print_all(run_history(list_runs(spark, a.artifacts)))
        return 0
    if a.cmd == "validate":
        from salespanel.plans.pipeline import validate_paths
        res = validate_paths(spark, a.data, a.contract)
        print(json.dumps(res.as_dict()))
        return 0 if res.status == "PASS" else 1
    if a.cmd == "forecast":
        from salespanel.plans.pipeline import forecast
        _print_all(forecast(spark, a.run_dir).orderBy("Date", "Series"))
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
