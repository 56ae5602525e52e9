"""Run named queries from the command line.

    python -m churnlab q19_reversal_ticket_churn --data /root/testdata/sf0.01
    python -m churnlab q02_sale_to_ticket_churn --extracts paths.json --rules warehouse --year 2021
    python -m churnlab --list

``--data`` derives the domain tables from the TPC-H-like test parquet;
``--extracts`` is a JSON file mapping the five domain table names to parquet
paths of the original extracts.  Monthly results are small and printed whole; ``--out``
writes results as parquet instead.  Queries with detail rows need ``--out``, or
``--preview N`` to print N rows knowingly.
"""

from __future__ import annotations

import argparse
import json
import sys

from churnlab.config import FIXTURE_RULES, WAREHOUSE_RULES
from churnlab.plans.generic import GENERIC_QUERIES
from churnlab.plans.queries import QUERIES
from churnlab.session import local_session, tune
from churnlab.sources import DomainTables


DETAIL_QUERIES = ("q11_reversal_discount_match", "q12_open_discount_reversal_churn")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="churnlab", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("queries", nargs="*", help="query names (see --list)")
    p.add_argument("--list", action="store_true", help="list query names")
    p.add_argument("--data", help="folder of the test parquet tables")
    p.add_argument("--extracts", help="JSON file: domain table -> parquet path")
    p.add_argument("--warehouse", help="folder of extracts named as the warehouse names them; --table names each")
    p.add_argument("--table", action="append", default=[], help="qualified name of an extract below --warehouse or in the catalog (repeatable)")
    p.add_argument("--date-format", help="pattern of days stored as text in the extracts (default: ISO)")
    p.add_argument("--format", default="parquet", help="reader format of the extracts (parquet, csv, orc, ...)")
    p.add_argument("--option", action="append", default=[], help="reader option key=value (repeatable)")
    p.add_argument("--rules", choices=["fixture", "warehouse"], default=None)
    p.add_argument("--year", type=int, help="year of the new-sale / discount rules")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--out", help="write each result as parquet under this folder")
    p.add_argument(
        "--materialize",
        nargs="?",
        const="",
        help="write the shared anchor sets first (to this shared folder, or spark.checkpoint.dir) "
        "so all queries start from them",
    )
    p.add_argument("--preview", type=int, help="print only this many rows of each result")
    p.add_argument("--input-bytes", type=int, help="bytes of the columns read from the largest table")
    p.add_argument("--shuffle-bytes", type=int, help="bytes a query shuffles (default: a tenth of the input)")
    p.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of running")
    args = p.parse_args(argv)

    if args.list:
        for name, fn in {**QUERIES, **GENERIC_QUERIES}.items():
            print(f"{name:42s} {(fn.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if not args.queries or sum(map(bool, (args.data, args.extracts, args.table))) != 1:
        p.error("give query names and exactly one of --data / --extracts / --table")

    spark = local_session(args.master.removeprefix("local[").removesuffix("]")) if args.master.startswith("local") else None
    if spark is None:
        from pyspark.sql import SparkSession

        spark = tune(SparkSession.builder.master(args.master).appName("churnlab").getOrCreate(), args.input_bytes, args.shuffle_bytes)
    rules = FIXTURE_RULES if (args.rules or ("fixture" if args.data else "warehouse")) == "fixture" else WAREHOUSE_RULES
    if args.year:
        rules = rules.with_year(args.year)
    reading = {"format": args.format, "options": dict(o.split("=", 1) for o in args.option), "date_format": args.date_format}
    if args.data:
        tables = DomainTables.from_testdata(spark, args.data)
    elif args.table:
        tables = DomainTables.from_warehouse(spark, args.table, args.warehouse, **reading)
    else:
        with open(args.extracts) as fh:
            tables = DomainTables.from_extracts(spark, json.load(fh), **reading)

    if args.materialize is not None:
        from churnlab.plans.queries import materialize_anchors

        materialize_anchors(tables, rules, spark, args.materialize or None)

    for name in args.queries:
        if name in QUERIES:
            df = QUERIES[name](tables, rules)
        elif name in GENERIC_QUERIES and args.data:
            df = GENERIC_QUERIES[name](spark, args.data)
        else:
            p.error(f"unknown query {name!r} (or a raw_* query without --data)")
        if name in DETAIL_QUERIES and not (args.out or args.preview or args.explain):
            p.error(f"{name} returns detail rows: give --out, or --preview N")
        print(f"== {name}")
        if args.explain:
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        else:
            df.show(args.preview or max(1, df.count()), truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
