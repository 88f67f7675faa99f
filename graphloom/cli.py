"""spark-submit graphloom/cli.py NAME SF_DIR OUT: writes a named query's result as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    for name in ("query", "sf_dir", "out"):
        args.add_argument(name)
    a = args.parse_args()
    from graphloom.queries import QUERIES

    QUERIES[a.query](SparkSession.builder.getOrCreate(), a.sf_dir).write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()
