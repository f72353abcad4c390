"""Command line: python -m tabulore.cli INPUT [OUTPUT] [options]; OUTPUT - is standard output."""

from __future__ import annotations

import argparse
import posixpath
import sys

from tabulore.plans.dictionary import profile_path
from tabulore.plans.render import EXTENSIONS, output_format, render
from tabulore.sources.registry import codec_of


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Write a data dictionary of a file.")
    out.add_argument("input_path")
    out.add_argument("output_path", nargs="?")
    out.add_argument("--samples", type=int, default=3, help="samples of each column")
    out.add_argument("--nrows", type=int, help="rows or records to read")
    out.add_argument("--format", help="the input's format, where its extension doesn't say")
    out.add_argument("--delimiter", help="of csv and tsv")
    out.add_argument("--widths", type=lambda s: [int(x) for x in s.split(",")], help="of fixed-width columns, as 10,5,20")
    out.add_argument("--output-format", default="md", help="md, json or json-schema")
    return out


def default_output(path: str, output: str) -> str:
    logical = codec_of(path)[1]
    stem, _, extension = logical.rpartition(".")
    return f"{stem if stem and '/' not in extension else logical}.{EXTENSIONS[output]}"


def main(args: list[str] | None = None, spark=None) -> int:
    a = arguments().parse_args(args)
    try:
        output = output_format(a.output_format)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tabulore").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        tables, fmt = profile_path(spark, a.input_path, a.samples, fmt=a.format, nrows=a.nrows, delimiter=a.delimiter, widths=a.widths)
        text = render(posixpath.basename(a.input_path), fmt, tables, output)
        said = f"{len(tables)} tables, {sum(map(len, tables.values()))} columns -> "
        if a.output_path == "-":
            sys.stdout.write(text)
            print(said + "(stdout)", file=sys.stderr)
        else:
            to = a.output_path or default_output(a.input_path, output)
            with open(to, "w", encoding="utf-8") as f:
                f.write(text)
            print(said + to, file=sys.stderr)
    except Exception as e:  # a plain message and status 1, whatever went wrong
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
