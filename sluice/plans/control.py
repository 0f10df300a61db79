"""Control flow: the order of packages that a package calls, jobs of package folders, and the steps of scheduled jobs.

A folder tree becomes jobs, one for each package, and for each folder one that calls them:

* a ``main`` package without flows of its own that calls packages is that job itself;
* one that also has flows gets a second job, ``<name>_orchestrator``, for its calls;
* without a ``main`` package, ``main`` of the folder calls all of its jobs by name.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..errors import FlowError
from .flow import Package
from .run import Result, context, run


def call_order(package: Package, warnings: list[str]) -> list[str]:
    """Tasks that call packages, after those they wait for; failure paths and edges to other tasks do not order."""
    tasks = list(package.calls)
    waits: dict[str, set[str]] = {t: set() for t in tasks}
    for before, after, when in package.precedence:
        if when == "failure" or before not in waits or after not in waits:
            warnings.append(f"{package.name}: the path from {before} to {after} does not order packages")
        else:
            waits[after].add(before)
    out: list[str] = []
    while len(out) < len(tasks):
        ready = next((t for t in tasks if t not in out and waits[t] <= set(out)), None)
        if ready is None:
            raise FlowError(f"{package.name}: packages wait for each other")
        out.append(ready)
    return out


def _ordered(package: Package, warnings: list[str]) -> list[str]:
    """``call_order``, or the order of declaration if packages wait for each other."""
    try:
        return call_order(package, warnings)
    except FlowError as e:
        warnings.append(f"{e}; they run as declared")
        return list(package.calls)


def run_package(spark: SparkSession, package: Package, tables, folder: Path | None = None, **options: Any) -> list[Result]:
    """Run the flows of a package in document order, then the packages it calls, in their order.

    In ssis mode its SQL statements run before the flows; in reference mode they are recorded only.
    """
    from ..sources.dtsx import child_file, read_package

    ctx = context(spark, tables, package, **options)
    if ctx.compat == "ssis":
        for statement in package.statements:
            try:
                tables.execute(statement)
            except Exception as e:
                if ctx.strict:
                    raise
                ctx.warn(f"{package.name}: a statement failed: {e}")
    results = [run(flow, ctx) for flow in package.flows]
    for task in _ordered(package, ctx.warnings):
        path = child_file(folder, package.calls[task]) if folder else None
        if path is None:
            ctx.warn(f"{package.name}: no package file {package.calls[task]!r}")
        else:
            results += run_package(spark, read_package(path), tables, folder, **options)
    return results


def job_name(parts: list[str]) -> str:
    """Lower case, other characters than letters and digits as single underscores."""
    return "_".join(x for x in (re.sub(r"[^a-z0-9]+", "_", p.lower()).strip("_") for p in parts) if x)


def distinct_names(stems: list[str]) -> dict[str, str]:
    """Job names of the packages of a folder; where several have one name, the second gets _2 and so on, by original name."""
    same: dict[str, list[str]] = defaultdict(list)
    for s in sorted(stems):
        same[job_name([s])].append(s)
    return {s: name if not k else f"{name}_{k + 1}" for name, group in same.items() for k, s in enumerate(group)}


@dataclass
class Tree:
    """``jobs``: name to the jobs that it calls, in order; ``packages``: job to package file; files that cannot be read are in ``failed``."""

    root: Path
    jobs: dict[str, list[str]] = field(default_factory=dict)
    packages: dict[str, Path] = field(default_factory=dict)
    entries: list[str] = field(default_factory=list)  # the job to start for each folder
    failed: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def manifest(self) -> str:
        """The jobs and their files as JSON."""
        files = [{"package": p.relative_to(self.root).as_posix(), "job": job, "calls": self.jobs[job]} for job, p in sorted(self.packages.items())]
        made = [{"job": job, "calls": calls} for job, calls in sorted(self.jobs.items()) if job not in self.packages]
        return json.dumps({"version": 1, "input_root": str(self.root), "entries": files, "orchestrators": made, "failed": self.failed}, indent=1)


def plan_tree(root: str | Path, orchestrate: bool = True) -> Tree:
    """The jobs of all packages under ``root``, folder by folder; folders named bin and obj are build output and left out."""
    from ..errors import PackageError
    from ..sources.dtsx import child_file, read_package

    tree = Tree(Path(root))
    if not tree.root.is_dir():
        raise PackageError(f"{root}: not a folder")
    files = [p for p in sorted(tree.root.rglob("*")) if p.suffix.lower() == ".dtsx" and not {"bin", "obj"} & {x.lower() for x in p.relative_to(tree.root).parts[:-1]}]
    for folder in dict.fromkeys(p.parent for p in files):
        here, path = [p for p in files if p.parent == folder], list(folder.relative_to(tree.root).parts)
        stems = {unquote(p.stem): p for p in here}
        jobs = {stem: job_name([*path, name]) for stem, name in distinct_names(list(stems)).items()}
        packages = {}
        for stem, p in stems.items():
            try:
                packages[stem] = read_package(p)
            except PackageError as e:
                tree.failed[p.relative_to(tree.root).as_posix()] = str(e)
                continue
            tree.jobs[jobs[stem]], tree.packages[jobs[stem]] = [], p
        if not orchestrate:
            continue
        main = next((s for s in packages if s.lower() == "main"), None)
        if main is None:
            if packages:
                name = job_name([*path, "main"])
                tree.warnings.append(f"{folder}: no main package; {name} calls all packages by name")
                tree.jobs[name] = sorted(jobs[s] for s in packages)
                tree.entries.append(name)
            continue
        calls = []
        for task in _ordered(packages[main], tree.warnings):
            found = child_file(folder, packages[main].calls[task])
            stem = unquote(found.stem) if found else None
            if stem in packages:
                calls.append(jobs[stem])
            else:
                tree.warnings.append(f"{folder}: main calls {packages[main].calls[task]!r}, which is not there")
        if not calls or not packages[main].flows:
            tree.jobs[jobs[main]] = calls
            tree.entries.append(jobs[main])
        else:
            tree.jobs[f"{jobs[main]}_orchestrator"] = calls
            tree.entries += [jobs[main], f"{jobs[main]}_orchestrator"]
    return tree


def run_tree(spark: SparkSession, tree: Tree, tables, **options: Any) -> dict[str, list[Result]]:
    """Run the jobs of each folder from its entries; a package runs once even if several jobs call it.  A job that fails is in ``tree.failed``."""
    from ..sources.dtsx import read_package

    done: dict[str, list[Result]] = {}

    def start(job: str) -> None:
        if job in done:
            return
        done[job] = []
        if job in tree.packages:
            package = read_package(tree.packages[job])
            package.calls = {}
            try:
                done[job] = run_package(spark, package, tables, tree.packages[job].parent, **options)
            except Exception as e:
                tree.failed[job] = str(e)
        for other in tree.jobs.get(job, []):
            start(other)

    for job in [*tree.entries, *([] if tree.entries else tree.jobs)]:
        start(job)
    return done


# The flags of a job step's command that name a package, in the order of their precedence.
STEP_FLAGS = (r"F(?:ILE)?", "ISSERVER", "SQL?")


def step_package(command: str) -> tuple[str | None, str]:
    """The package that a job step's command runs, with forward slashes and an extension, or None and the reason.

    Commands with environment variables or configuration files are refused: what they run is not known here.
    """
    if "%" in command:
        return None, "environment variable"
    if re.search(r"/configfile\b", command, re.I):
        return None, "configuration file"
    for flag in STEP_FLAGS:
        found = re.search(rf'(?:^|\s)/{flag}\s+("[^"]+"|\S+)', command, re.I)
        if found:
            path = found[1].strip('"').replace("\\", "/")
            return path if path.lower().endswith(".dtsx") else f"{path}.dtsx", ""
    return None, "no package"


def step_job(manifest: dict, path: str) -> tuple[str | None, list[str]]:
    """The job of a step's package: by the end of its path, else by a file name that is there once.  Otherwise None and the candidates."""
    entries = [(e["package"], e["job"]) for e in manifest["entries"]]
    for package, job in entries:
        if path == package or path.endswith(f"/{package}"):
            return job, [job]
    last = path.rpartition("/")[2].lower()
    near = [job for package, job in entries if package.rpartition("/")[2].lower() == last]
    return (near[0] if len(near) == 1 else None), near


def read_manifest(text: str) -> dict:
    """The manifest of a tree; raises if it is not one of version 1 or names files outside of its folder."""
    from ..errors import PackageError

    try:
        found = json.loads(text)
    except ValueError as e:
        raise PackageError(f"manifest: {e}") from e
    if not isinstance(found, dict) or not isinstance(found.get("entries"), list):
        raise PackageError("manifest: no entries")
    if found.get("version") != 1:
        raise PackageError(f"manifest: unknown version {found.get('version')!r}")
    for e in found["entries"]:
        if not isinstance(e, dict) or not all(isinstance(e.get(k), str) and e[k] for k in ("package", "job")):
            raise PackageError("manifest: an entry needs a package and a job")
        if e["package"].startswith(("/", "\\")) or ".." in e["package"]:
            raise PackageError(f"manifest: {e['package']!r} is outside of the folder")
    return found
