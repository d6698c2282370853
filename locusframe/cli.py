"""Command line: sort, compress, build-index, query-index, inspect-index."""

from __future__ import annotations

import argparse
import dataclasses
import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from .errors import InputError, LocusError
from .functions.matching import MODES
from .operators.compress import compress_file, sort_and_compress
from .operators.sort import input_errors, sort_file, sorted_lines
from .plans.index import build_index, inspect_index, open_index
from .sources.coordinate_index import discover
from .sources.formats import BED, source_format


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusframe", description="Search annotation files on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("sort")
    c.add_argument("input")
    c.add_argument("--disk-sort", "--ds", action="store_true")
    c.add_argument("--compress", action="store_true")
    c.add_argument("--output")
    c.add_argument("--coordinate-index")
    c = sub.add_parser("compress")
    c.add_argument("input")
    c.add_argument("--output", required=True)
    c.add_argument("--coordinate-index")
    c = sub.add_parser("build-index", aliases=["build"])
    c.add_argument("input")
    c.add_argument("--attribute", action="append", default=[])
    c.add_argument("--coordinate-index")
    c.add_argument("--output", help="default: INPUT.index")
    c.add_argument("--case-sensitive", action="store_true")
    c.add_argument("--memory-budget", type=int, default=64 << 20)
    c.add_argument("--compression-threads", type=int)
    c.add_argument("--bgzf-threads", type=int)
    c = sub.add_parser("query-index", aliases=["query"])
    c.add_argument("input")
    c.add_argument("term")
    c.add_argument("--coordinate-index")
    c.add_argument("--index", help="default: INPUT.index")
    c.add_argument("--match", choices=MODES, default="exact")
    c.add_argument("--contig", action="append")
    c = sub.add_parser("inspect-index", aliases=["inspect"])
    c.add_argument("index")
    return p


def beside(path: str) -> str | None:
    """The coordinate index that lies beside a file, if there is one; two are an error."""
    return discover(path) if os.path.exists(f"{path}.tbi") or os.path.exists(f"{path}.csi") else None


def run(spark: SparkSession, args: argparse.Namespace, out=None) -> None:
    out = out or sys.stdout
    if args.command == "sort":
        if args.compress:
            if args.output:
                sort_and_compress(spark, args.input, args.output, args.coordinate_index)
            else:
                if not args.coordinate_index:
                    raise InputError("--compress needs --output, or --coordinate-index to write to standard output")
                with tempfile.TemporaryDirectory() as folder:
                    path = os.path.join(folder, os.path.basename(args.input) + ".gz")
                    sort_and_compress(spark, args.input, path, args.coordinate_index)
                    with open(path, "rb") as f:
                        shutil.copyfileobj(f, getattr(out, "buffer", out))
        elif args.output:
            sort_file(spark, args.input, args.output, args.disk_sort)
        else:
            for r in input_errors(lambda: sorted_lines(spark, args.input).toLocalIterator()):
                out.write(r["raw_line"] + "\n")
    elif args.command == "compress":
        compress_file(args.input, args.output, args.coordinate_index)
    elif args.command in ("build-index", "build"):
        if args.attribute and source_format(args.input) == BED:
            print("locusframe: --attribute is ignored for BED", file=sys.stderr)
            args.attribute = []
        stats = build_index(
            spark, args.input, args.output or f"{args.input}.index", args.attribute, coordinate_index=args.coordinate_index or beside(args.input), case_sensitive=args.case_sensitive,
            memory_budget=args.memory_budget, compression_threads=args.compression_threads, bgzf_threads=args.bgzf_threads,
        )
        for k, v in dataclasses.asdict(stats).items():
            out.write(f"{k}: {v}\n")
    elif args.command in ("query-index", "query"):
        for r in open_index(spark, args.input, args.index or f"{args.input}.index", args.coordinate_index or beside(args.input)).query(args.term, match=args.match, contigs=args.contig).toLocalIterator():
            out.write(r["raw_line"] + "\n")
    else:
        for k, v in dataclasses.asdict(inspect_index(spark, args.index)).items():
            out.write(f"{k}: {v}\n")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("locusframe").getOrCreate()
    try:
        run(spark, args)
    except LocusError as e:
        print(f"locusframe: {e}", file=sys.stderr)
        return 1
    return 0


__all__ = ["discover", "main", "parser", "run"]

if __name__ == "__main__":
    sys.exit(main())
