"""python -m ledgerloom.cli: build, marts, gate, checks, recon, maintain and run over a lake folder. Exit 0: done, 1: refused arguments, 2: a check failed."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("--lake", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    date = dt.date.fromisoformat
    b = sub.add_parser("build")
    b.add_argument("--table", choices=("dim", "facts", "dwd_order_detail", "dwd_order_sku_detail", "dwd_order_lifecycle"), required=True)
    b.add_argument("--mode", choices=("incremental", "rebuild", "append", "dry"), default="incremental")
    b.add_argument("--start", type=date)
    b.add_argument("--end", type=date)
    b.add_argument("--lookback", type=int, default=3)
    b.add_argument("--strict-closure", action="store_true")
    m = sub.add_parser("marts")
    kind = m.add_mutually_exclusive_group()
    kind.add_argument("--range", nargs=2, type=date, metavar=("FIRST", "LAST"))
    kind.add_argument("--truncate", action="store_true")
    m.add_argument("--lookback", type=int, default=3)
    m.add_argument("--dry-run", action="store_true")
    g = sub.add_parser("gate")
    g.add_argument("--day", type=date, required=True)
    sub.add_parser("checks")
    r = sub.add_parser("recon")
    r.add_argument("--range", nargs=2, type=date, metavar=("FIRST", "LAST"))
    r.add_argument("--fast", action="store_true")
    r.add_argument("--strict", action="store_true")
    r.add_argument("--allow-lag", type=int, default=0)
    r.add_argument("--baseline", type=json.loads, help="JSON object: orders, detail, dws, ads to rows")
    r.add_argument("--json", action="store_true")
    k = sub.add_parser("maintain")
    k.add_argument("--expire", action="store_true")
    k.add_argument("--keep", type=int, default=5)
    k.add_argument("--tables", type=lambda s: s.split(","))
    d = sub.add_parser("run")
    d.add_argument("--day", type=date, required=True)
    d.add_argument("--until", type=date)
    d.add_argument("--ledger")
    d.add_argument("--lock")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    from ledgerloom.operators.incremental import Failed, Refused, dry_run, explicit_range
    from ledgerloom.operators.recon import summary
    from ledgerloom.plans.pipeline import backfill
    from ledgerloom.plans.scratch import clean
    from ledgerloom.plans.session import session
    from ledgerloom.plans.warehouse import FACTS, Warehouse

    w = Warehouse(session(), a.lake)
    w.warnings = []
    try:
        if a.command == "build" and a.mode == "dry":
            first, last = w._bounds("ods_product" if a.table == "dim" else "ods_order")
            source, column = ("ods_product", "snapshot_date") if a.table == "dim" else ("ods_order", "dt")
            print(dry_run(w.read(source), *explicit_range(a.start or first, a.end or last), column))
        elif a.command == "build" and a.table == "dim":
            print(w.build_dims(full=a.mode == "rebuild"))
        elif a.command == "build":
            first, last = w._bounds("ods_order")
            whole = a.mode == "rebuild"
            names = FACTS if a.table == "facts" else (a.table,)
            print(w.build_facts(a.lookback, a.start or (first if whole else None), a.end or (last if whole else None), names, a.mode == "append", a.strict_closure))
        elif a.command == "marts" and a.dry_run:
            due = explicit_range(*a.range) if a.range else w.mart_range(a.lookback)
            print(dry_run(w.read("dwd_order_detail"), *due) if due else "nothing to do")
        elif a.command == "marts":
            print(w.build_marts(a.lookback, *(a.range or (None, None)), truncate=a.truncate))
        elif a.command == "gate":
            try:
                w.gate(a.day)
            finally:
                print(getattr(w, "gate_line", ""))
        elif a.command == "checks":
            found = w.violations()
            for name, n in found:
                print(f"{name}|{n}")
            return 2 if found else 0
        elif a.command == "maintain":
            print(json.dumps(w.maintain(a.expire, a.keep, a.tables)))
        elif a.command == "recon":
            found = w.recon(a.strict, *(explicit_range(*a.range) if a.range else (None, None)), a.fast, a.allow_lag, a.baseline)
            for c in found:
                print(json.dumps(asdict(c)) if a.json else f"RECON|{'OK' if c.ok else 'BAD'}|{c.name}|{c.expected}|{c.actual}")
            print(summary(found))
            return 0 if all(c.ok for c in found) else 2
        else:
            days = backfill(a.day, a.until or a.day, w.steps(), ledger=a.ledger, lock=a.lock)
            for d, o in days.items():
                print(d, o.states, o.errors)
            return 0 if all(o.ok for o in days.values()) else 2
    except Failed as e:
        print(e, file=sys.stderr)
        return 2
    except (Refused, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        for x in w.warnings:
            print(f"WARN|{x}", file=sys.stderr)
        clean(w.spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
