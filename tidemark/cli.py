"""python -m tidemark.cli [--root FOLDER] [--data FOLDER_OF_PARQUET] [SQL]: run statements, or read them from stdin."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .session import Session
from .sources.files import Store
from .sources.tables import TableError
from .sql.diagnostics import Diagnostic


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root")
    p.add_argument("--data")
    p.add_argument("sql", nargs="?")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    s = Session(spark, a.root)
    if a.data:
        s.register_parquet(a.data, *[n.removesuffix(".parquet") for n in Store(spark, a.data).names("") if n.endswith(".parquet")])
    try:
        for df in s.execute(a.sql or sys.stdin.read()):
            df.show(truncate=False)
    except Diagnostic as d:
        print(d.full(), file=sys.stderr)
        return 1
    except TableError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
