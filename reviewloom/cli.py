"""Command line: ``python -m reviewloom.cli run|report|demo ...``; JSON on standard output, exit 1 on a failed check."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from reviewloom.pipeline import Lakehouse
from reviewloom.session import build_session


def _report(house: Lakehouse) -> tuple[dict, bool]:
    checks = house.quality_checks()
    daily = {}
    for name in ("product_health_daily", "aspect_health_daily"):
        if house.store.exists(name):
            daily[name] = [r.asDict() for r in house.table(name).orderBy("event_date", "product_id").collect()]
    return {"counts": house.counts(), "checks": checks, **daily}, all(checks.values())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="reviewloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "report", "demo"):
        p = sub.add_parser(name)
        p.add_argument("--database", default="build/lakehouse")
        if name == "run":
            p.add_argument("source")
            p.add_argument("--watermark-hours", type=int, default=24)
        if name == "demo":
            p.add_argument("--source", required=True)
    args = parser.parse_args(argv)
    if getattr(args, "watermark_hours", 1) < 1:
        parser.error("--watermark-hours must be at least 1")
    if args.command == "demo":
        shutil.rmtree(args.database, ignore_errors=True)
    house = Lakehouse(build_session("reviewloom-cli"), str(Path(args.database).resolve()))
    if args.command == "run":
        out = house.run(args.source, args.watermark_hours)
        out["checks"] = house.quality_checks()
        ok = all(out["checks"].values())
    elif args.command == "demo":
        first, second = house.run(args.source), house.run(args.source)
        report, ok = _report(house)
        out = {"first": first, "second": second, "report": report}
    else:
        out, ok = _report(house)
    print(json.dumps(out, default=str, indent=2))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
