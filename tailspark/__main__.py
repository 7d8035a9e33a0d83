"""Command line: python -m tailspark NAME FOLDER [OUT] runs a registered query on a folder of tables and shows or writes it."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from tailspark.queries import QUERIES

    parser = argparse.ArgumentParser(prog="tailspark", description=__doc__)
    parser.add_argument("name", choices=sorted(QUERIES))
    parser.add_argument("folder")
    parser.add_argument("out", nargs="?")
    given = parser.parse_args(arguments)
    found = QUERIES[given.name](SparkSession.builder.appName("tailspark").getOrCreate(), given.folder)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(50, truncate=False)


if __name__ == "__main__":
    main()
