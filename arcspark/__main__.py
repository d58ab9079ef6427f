"""``python -m arcspark dump PATH [--item] [--rows N] [--where SQL]``: what an archive holds, as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def dump(spark, path: str, item: bool = False, rows: int = 20, where: str | None = None) -> list[str]:
    """The first ``rows`` records, bytes as lengths; with a filter those that pass."""
    from arcspark.sources.arc import read_arc

    found = read_arc(spark, path, records="item" if item else "raw")
    found = found.where(where) if where else found
    body = "content" if item else "value"
    return [r[0] for r in found.withColumn(body, F.octet_length(body)).limit(rows).select(F.to_json(F.struct("*"))).collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arcspark")
    parser.add_argument("command", choices=["dump"])
    parser.add_argument("path")
    parser.add_argument("--item", action="store_true", help="records as items, headers parsed")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--where", help="a filter in Spark SQL")
    parser.add_argument("--master", help="Spark master, if no spark-submit sets one")
    args = parser.parse_args(argv)
    from arcspark.session import session

    for line in dump(session("arcspark dump", args.master), args.path, args.item, args.rows, args.where):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
