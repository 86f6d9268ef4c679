"""Jobs for spark-submit: ``python -m caselake <job> --store <folder> ...``.

Loads print the row count they wrote, reports print their rows."""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from .functions import strict_date
from .operators.routing import route_messages
from .plans import global_daily, portal, province, timeline, vaccination
from .session import build_session
from .sources import delimited, html, landing
from .sources.store import TableStore


def _now():
    return F.lit(datetime.now(timezone.utc)).cast("timestamp")


def extract_global(spark, store, args):
    path = delimited.first_existing(spark, args.input)
    dated = delimited.read_columns_csv(spark, path, order="id").withColumn("date", strict_date(F.col("date")))
    delivered = landing.land_daily(dated, path.rsplit("/", 1)[-1], _now())
    print(global_daily.extract(store, delivered, args.days))


def transform_global(spark, store, args):
    print(global_daily.transform_load(store, _now()).count())


def refresh_serving(spark, store, args):
    global_daily.refresh_serving(store, _now())


def load_province(spark, store, args):
    print(province.load(store, delimited.read_tsv(spark, delimited.first_existing(spark, args.input)), _now()).count())


def load_vaccination(spark, store, args):
    """``--input``: Parquet pages (page_id, html), or a CSV snapshot."""
    path = delimited.first_existing(spark, args.input)
    if path.endswith(".csv"):
        text = delimited.read_columns_csv(spark, path, [
            "province_name", "population", "doses_distributed", "doses_administered", "doses_per_100"])
    else:
        text = html.locality_rows(spark.read.parquet(path)).drop("page_id")
    snapshot = date.fromisoformat(args.snapshot) if args.snapshot else date.today()
    print(vaccination.load(store, text, snapshot, args.source_url, _now()).count())


def load_timeline(spark, store, args):
    pages = spark.read.parquet(delimited.first_existing(spark, args.input))
    print(timeline.load(store, timeline.page_timeline_text(pages), args.source_url, _now(),
                        timeline.page_province_text(pages)).count())


def report(spark, store, args):
    """All rows to ``--output`` (Parquet, or CSV if the path ends so); without it, the rows of a report
    that has a limit of its own."""
    rows = portal.run(store, args.name, args.n)
    if args.output:
        (rows.write.option("header", True).csv if args.output.endswith(".csv") else rows.write.parquet)(args.output)
        return
    most = portal.most_rows(args.name, args.n)
    if most is None:
        raise SystemExit(f"{args.name} may have any number of rows: give --output")
    rows.show(most, truncate=False)


def reply(spark, store, args):
    messages = spark.range(1).select(F.lit(args.message).alias("text"))
    print(route_messages(messages).first()["reply"])


JOBS = [extract_global, transform_global, refresh_serving, load_province, load_vaccination, load_timeline, report, reply]


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="caselake")
    parser.add_argument("job", choices=[job.__name__ for job in JOBS])
    parser.add_argument("--store", required=True, help="root folder of the tables")
    parser.add_argument("--input", nargs="+", default=[], help="candidate paths, the first that exists is read")
    parser.add_argument("--days", type=int, help="keep so many days before the newest one; all without it")
    parser.add_argument("--output", help="folder for a report's rows")
    parser.add_argument("--snapshot", help="snapshot day, yyyy-mm-dd")
    parser.add_argument("--source-url", default="")
    parser.add_argument("--name", help="report name")
    parser.add_argument("--n", type=int, help="number of rows")
    parser.add_argument("--message", default="")
    args = parser.parse_args(argv)
    spark = build_session()
    {job.__name__: job for job in JOBS}[args.job](spark, TableStore(spark, args.store), args)


if __name__ == "__main__":
    main()
