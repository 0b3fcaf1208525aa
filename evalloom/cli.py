"""Command line: validate, run, transpile, report.

python -m evalloom.cli run FOLDER --out RUN [--input k=v] [-M KEY=VALUE] [--parallel N] [--reuse RUN] [--from NODE]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from .engine import run as engine
from .project import folder as projects
from .publish import reports
from .script.surface import ScriptError
from .session import local_session


def pairs(items: list[str] | None) -> dict[str, str]:
    out = {}
    for item in items or []:
        key, eq, value = item.partition("=")
        if not eq:
            raise ScriptError(f"{item} is not KEY=VALUE")
        out[key] = value
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evalloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "run", "transpile", "graph"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("--recipe")
        p.add_argument("-M", "--macro", action="append")
        if name in ("run", "transpile"):
            p.add_argument("--out")
        if name == "run":
            p.add_argument("--input", action="append")
            p.add_argument("--parallel", type=int, default=0)
            p.add_argument("--reuse")
            p.add_argument("--policy", default="auto", choices=("auto", "from_node", "force_recompute_all"))
            p.add_argument("--from", dest="node")
            p.add_argument("--wait", type=float, default=0.0)
            p.add_argument("--cpus", type=int)
    p = sub.add_parser("report")
    p.add_argument("folder")
    p.add_argument("--format", default="md", choices=("md", "html"))
    args = parser.parse_args(argv)
    try:
        return _run(args)
    except (ScriptError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace) -> int:
    if args.command == "report":
        print(reports.render(f"{args.folder}/reports", args.format))
        return 0
    project = projects.load(args.folder, args.recipe)
    macros = pairs(args.macro)
    statements, steps = engine.validate(project.recipe, project.registry, macros)
    if args.command == "validate":
        print(f"valid: {len(statements)} statements, {len(steps)} steps")
        return 0
    if args.command == "graph":
        from .plans.graph import recipe_graph

        print(json.dumps(recipe_graph(statements), indent=1))
        return 0
    spark = local_session(cpus=getattr(args, "cpus", None))
    if args.command == "transpile":
        out = engine.transpile(spark, project.recipe, project.registry, macros=macros)
        print(json.dumps(out, indent=1))
        return 0
    place = args.out or f"{args.folder}/runs/{int(time.time())}"
    os.makedirs(place, exist_ok=True)
    inputs = {**project.inputs, **pairs(args.input)}
    settings = engine.Settings(
        place, inputs, macros, parallel=args.parallel or int(project.settings.get("max_parallel_stages", 1)), reuse_from=args.reuse,
        policy="from_node" if args.node and args.policy == "auto" else args.policy, from_node=args.node, wait_seconds=args.wait, datasets=f"{place}/datasets",
    )
    result = engine.run(spark, project.recipe, settings, project.registry)
    text = reports.render(f"{place}/reports", "md", list(project.secrets.values()))
    with open(f"{place}/report.md", "w") as f:
        f.write(text)
    print(f"{result.status}: {len(result.tables)} tables, {len(result.reused)} reused, in {place}")
    for name, why in result.failed.items():
        print(f"failed {name}: {reports.redact(why[:300], list(project.secrets.values()))}", file=sys.stderr)
    return {"completed": 0, "waiting": 3}.get(result.status, 1)


if __name__ == "__main__":
    sys.exit(main())
