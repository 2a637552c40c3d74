"""Runs queries by name: python -m dialoom list | run NAME TABLES [--out PATH] [--format parquet|json|csv] | card TABLES."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from dialoom.plans import registry
from dialoom.sources import sinks


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="dialoom", description=__doc__)
    ap.add_argument("command", choices=("list", "run", "card"))
    ap.add_argument("rest", nargs="*", help="run: name and folder of the tables; card: folder of the tables")
    ap.add_argument("--out", help="where to write the result; without it the rows are shown as Markdown")
    ap.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    a = ap.parse_args(argv)
    if a.command == "list":
        for name, f in registry.QUERIES.items():
            print(f"{name}: {(f.__doc__ or '').strip().splitlines()[0]}")
        return 0
    spark = SparkSession.builder.appName("dialoom").getOrCreate()
    if a.command == "card":
        print(sinks.dataset_card(registry.one_conv(spark, a.rest[0], "status", "regens", "messages"), "Dialogues"))
        return 0
    df = registry.QUERIES[a.rest[0]](spark, a.rest[1])
    if a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        print(sinks.markdown(df))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
