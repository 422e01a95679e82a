"""Command line: synth-data, regenerate, verify, sweep."""

from __future__ import annotations

import argparse
import json
import sys

from . import config
from .plans import study
from .session import session
from .sources import artefacts, retail, synthetic


def main(argv: list[str] | None = None) -> int:
    """0: done or equal; 1: a difference; 2: wrong use."""
    parser = argparse.ArgumentParser(prog="lullcast")
    sub = parser.add_subparsers(dest="what", required=True)
    for name in ("synth-data", "regenerate", "verify", "sweep"):
        p = sub.add_parser(name)
        p.add_argument("--out", required=True)
        p.add_argument("--master")
        p.add_argument("--config")
        p.add_argument("--data")
        p.add_argument("--scratch")
        p.add_argument("--cells")
        p.add_argument("--expect", help="checksums (JSON, by path below --data) that the input files must have")
        p.add_argument("--series", type=int, default=150)
        p.add_argument("--days", type=int, default=900)
        p.add_argument("--resume", action="store_true", help="keep the tables that an earlier run with the same inputs and settings has committed")
    args = parser.parse_args(argv)
    spark = session(args.master)
    cfg = config.load(args.config)
    if args.what == "synth-data":
        synthetic.synthetic_panel(spark, args.series, args.days, seed=cfg.sample.seed).write.mode("overwrite").parquet(args.out)
        return 0
    if not args.data:
        parser.error("--data is needed")
    if args.expect:
        try:
            artefacts.gate(artefacts.stored_checksums(spark, args.expect), artefacts.checksums(spark, args.data))
        except artefacts.Changed as e:
            print(e, file=sys.stderr)
            return 1
    panel = retail.normalise(spark.read.parquet(args.data)) if not args.data.endswith((".csv", ".csv.gz")) else retail.read_long(spark, args.data)
    if args.what == "regenerate":
        study.regenerate(spark, panel, cfg, args.out, resume=args.resume)
        return 0
    if args.what == "verify":
        found = study.verify(spark, panel, cfg, args.out, args.scratch or f"{args.out.rstrip('/')}-verify")
        print(json.dumps(found, sort_keys=True))
        return int(bool(found["changed"] or found["missing"]))
    with open(args.cells) as f:
        study.sweep(spark, panel, config.cells(cfg, json.load(f))).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
