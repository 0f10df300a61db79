"""Command line: run a package, look into one, run a folder tree, find the job of a scheduled step.

Exit codes: 0 if all went well, 1 if single packages of a tree failed, 2 for errors that end the command.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from .errors import FlowError, PackageError
from .plans.control import plan_tree, read_manifest, run_package, run_tree, step_job, step_package
from .sources import Tables
from .sources.dtsx import read_package


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sluice")
    p.add_argument("-v", "--verbose", action="count", default=0)
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="run a package and the packages it calls")
    tree = commands.add_parser("run-tree", help="run all packages under a folder")
    look = commands.add_parser("inspect", help="list flows, variables and calls of a package as JSON")
    step = commands.add_parser("resolve-step", help="the job of a scheduled step's command")
    for c in (one, look):
        c.add_argument("package", type=Path)
    tree.add_argument("folder", type=Path)
    tree.add_argument("--no-orchestrator", action="store_true", help="run packages one by one, without jobs that call them")
    tree.add_argument("--manifest", type=Path, help="write the jobs here, as JSON")
    tree.add_argument("--plan-only", action="store_true", help="make jobs, run none")
    for c in (one, tree):
        c.add_argument("--tables", help="folder of Parquet tables; without it the catalog")
        c.add_argument("--compat", choices=("reference", "ssis"), default="reference")
        c.add_argument("--qualify", action="store_true", help="look tables up under the database of their connection")
    step.add_argument("manifest", type=Path)
    step.add_argument("text")
    return p


def _inspect(path: Path) -> int:
    p = read_package(path)
    flows = {f.name: [{"name": n.name, "kind": n.kind, "inputs": [x for _, x in n.inputs]} for n in f.order()] for f in p.flows}
    hidden = {f"{a}::{b}": None if (a, b) in p.sensitive else v for (a, b), (v, _) in p.variables.items()}
    print(json.dumps({"package": p.name, "flows": flows, "variables": hidden, "connections": sorted([*p.connections, *p.project_connections]), "calls": p.calls}, indent=1))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; ``spark`` is for callers that have a session."""
    args = _parser().parse_args(argv)
    logging.basicConfig(level={0: "WARNING", 1: "INFO"}.get(args.verbose, "DEBUG"))
    try:
        if args.command == "inspect":
            return _inspect(args.package)
        if args.command == "resolve-step":
            path, reason = step_package(args.text)
            job, near = step_job(read_manifest(args.manifest.read_text()), path) if path else (None, [])
            print(job or f"none: {reason or ('ambiguous: ' + ', '.join(near) if near else 'unknown package')}")
            return 0 if job else 1
        tree = plan_tree(args.folder, not args.no_orchestrator) if args.command == "run-tree" else None
        package = read_package(args.package) if args.command == "run" else None
        if tree and args.manifest:
            args.manifest.write_text(tree.manifest())
        if not (tree and args.plan_only):
            from pyspark.sql import SparkSession

            spark = spark or SparkSession.builder.appName("sluice").getOrCreate()
            tables = Tables(spark, args.tables, qualify=args.qualify)
            if package:
                run_package(spark, package, tables, args.package.parent, compat=args.compat)
            else:
                run_tree(spark, tree, tables, compat=args.compat)
        for name, why in (tree.failed if tree else {}).items():
            print(f"sluice: {name}: {why}", file=sys.stderr)
        return 1 if tree and tree.failed else 0
    except (FlowError, PackageError, OSError) as e:
        print(f"sluice: error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
