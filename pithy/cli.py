"""python -m pithy.cli [input] [--preset P] [--target R] [--model M] [--security] [--json] [--stats]: one text in, its compressed form out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pithy.config import PRESETS, CompressionConfig
from pithy.plans.compress import compress, compress_json, compress_scan, summary
from pithy.sources.documents import from_files, from_stdin


def settings(args: argparse.Namespace) -> CompressionConfig:
    config = PRESETS[args.preset]()
    if args.target is not None:
        config.target_ratio = args.target
    if args.model:
        config.model, config.token_backend = args.model, "auto"
    return config


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pithy", description="Shrinks a text for a language model.")
    parser.add_argument("input", nargs="?", default="-", help="file, or - for standard input")
    parser.add_argument("--preset", choices=sorted(PRESETS), default="default")
    parser.add_argument("--target", type=float, help="part of the tokens that may remain")
    parser.add_argument("--model", default="", help="count tokens as this model does, where its files are at hand")
    parser.add_argument("--security", action="store_true", help="brief of scanner output")
    parser.add_argument("--json", action="store_true", help="reshape JSON first")
    parser.add_argument("--stats", action="store_true", help="metrics on standard error")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("pithy").config("spark.ui.enabled", "false").getOrCreate()
    docs = from_stdin(spark) if args.input == "-" else from_files(spark, args.input)
    if args.security:
        text = compress_scan(docs).first()["compressed"]
    else:
        done = (compress_json if args.json else compress)(docs, "text", settings(args))
        row = done.select("compressed", "stats", summary().alias("line")).first()
        text = row["compressed"]
        if args.stats:
            print(row["line"], file=sys.stderr)
            for s in row["stats"]["stages"]:
                print(f"  {s['name']}: -{s['chars_removed']} chars {s['details']}", file=sys.stderr)
    sys.stdout.write(text if text.endswith("\n") else text + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
