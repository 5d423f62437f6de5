"""Command line: ``python -m loomfuse.cli -s [TYPE=]PATH … [-c CONFIG] [-o OUT | --lines FOLDER] [--no-validate] [--canonical] [--keywords TEXT] [-q]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomfuse.operators.ranking import rank
from loomfuse.plans.config import OutputConfig
from loomfuse.plans.pipeline import Source, run, write_outputs
from loomfuse.sources.readers import READERS


def parse_source(token: str) -> Source:
    """``TYPE=PATH`` for known types, else a path."""
    kind, eq, path = token.partition("=")
    return Source(path, kind) if eq and kind in READERS else Source(token)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomfuse", description="Merge person records of several sources into one profile each.")
    parser.add_argument("-s", "--source", action="append", default=[], metavar="[TYPE=]PATH")
    parser.add_argument("-c", "--config")
    parser.add_argument("-o", "--out")
    parser.add_argument("--lines", metavar="FOLDER", help="write JSON lines by Spark instead of one document")
    parser.add_argument("--no-validate", action="store_true")
    parser.add_argument("-q", "--quiet", action="store_true")
    parser.add_argument("--canonical", action="store_true", help="wrap the output with full profiles and warnings")
    parser.add_argument("--keywords", help="order by relevance to these terms")
    args = parser.parse_args(argv)
    if not args.source:
        parser.print_usage(sys.stderr)
        return 2
    config = OutputConfig.load(args.config) if args.config else None
    spark = SparkSession.builder.getOrCreate()
    done = run(spark, [parse_source(t) for t in args.source], config, not args.no_validate)
    outputs = done.outputs
    if args.keywords:
        order = rank(done.profiles, args.keywords).select("cluster", "match_fraction", "overall_confidence")
        outputs = outputs.join(order, "cluster").orderBy(F.desc("match_fraction"), F.coalesce("overall_confidence", F.lit(0.0)).desc(), "candidate_id", "cluster")
    if args.lines:
        write_outputs(outputs, args.lines)
        return 0
    rows = [json.loads(r["json"]) for r in outputs.select("json").toLocalIterator()]
    warnings = [f"{r['source']}: {r['message']}" for r in done.warnings.toLocalIterator()]
    body = {"candidates": rows, "_canonical": [r.asDict(True) for r in done.profiles.drop("cluster").toLocalIterator()], "warnings": warnings} if args.canonical else rows
    text = json.dumps(body, indent=2, ensure_ascii=False)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    if not args.quiet:
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
