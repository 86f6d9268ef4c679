"""Messy inputs derived from the given tables, whole tables each (see FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed_values import MESSAGE_RULES
from ..functions import NBSP


# Declared, so that opening a table reads no file footers and starts no job.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and region."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """landed daily rows as text, with header echoes, aggregate codes, six ways to write a date,
    bad dates, blanks, negatives, absurd counts and duplicates."""
    return _placed_orders(spark, sf_dir).selectExpr(
        "o_orderkey as id",
        """case when o_orderkey % 29 = 0 then 'iso_code'
                when o_orderkey % 17 = 0 then concat('OWID_', n_name)
                else concat('N', lpad(cast(n_nationkey as string), 2, '0')) end as iso_code""",
        "r_name as continent",
        "n_name as location",
        """case when o_orderkey % 23 = 0 then 'n/a'
                when o_orderkey % 19 = 0 then date_format(o_orderdate, 'dd/MM/yyyy')
                when o_orderkey % 13 = 0 then date_format(o_orderdate, 'd/M/yyyy')
                when o_orderkey % 11 = 0 then date_format(o_orderdate, 'yyyy-M-d')
                when o_orderkey % 9 = 0 then date_format(o_orderdate, 'yyyy-MM-dd 00:00:00')
                when o_orderkey % 8 = 0 then date_format(o_orderdate, "yyyy-MM-dd'T'23:59:59.5'Z'")
                else cast(cast(o_orderdate as date) as string) end as date_raw""",
        """case when o_orderkey % 31 = 0 then '' when o_orderkey % 37 = 0 then '-5'
                else cast(o_custkey % 500 as string) end as new_cases""",
        "cast(o_orderkey % 7 - 1 as string) as new_deaths",
        "cast((o_orderkey * 3) % 1000 as string) as total_cases",
        "cast(o_orderkey % 50 as string) as total_deaths",
        """case when o_orderkey % 5 = 0 then null when o_orderkey % 53 = 0 then '500000000000000'
                else cast(o_custkey as string) end as people_vaccinated""",
        "cast(2000 * (n_nationkey + 1) as string) as population",
    )


def locality_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """human-formatted numbers per locality."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_name as province_name",
        """case when c_custkey % 41 = 0 then '—' when c_custkey % 43 = 0 then null
                else format_number(1000 + c_custkey * 37, 0) end as population""",
        f"""concat(cast(c_custkey * 53 + 10 as string),
                   case when c_custkey % 2 = 0 then '{NBSP}' else '' end) as doses_distributed""",
        """case when c_custkey % 47 = 0 then '-'
                else cast(c_custkey * 29 % 7919 as string) end as doses_administered""",
        """case when c_custkey % 3 = 0 then null when c_custkey % 7 = 0 then 'nan'
                else concat(cast(50 + c_custkey % 200 as string), '.25%') end as doses_per_100""",
    )


def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cumulative text series with month headings, "n.a.", footnotes and corrections.
    The running sum goes over daily counts, at most one row per region and calendar day."""
    daily = _placed_orders(spark, sf_dir).groupBy(
        F.col("r_name").alias("series"), F.to_date("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("series").orderBy("dt"))
    cum = daily.withColumn("cum", running * 9 - F.when(F.dayofmonth("dt") == 17, 40).otherwise(0))
    return cum.selectExpr(
        "series",
        """case when day(dt) = 1 then concat('Month ', cast(month(dt) as string))
                else cast(dt as string) end as date_text""",
        """case when day(dt) = 13 then 'n.a.'
                else concat(replace(format_number(cum, 0), ',', '.'), '[3]') end as total_cases_text""",
        "cast(cum div 40 as string) as total_deaths_text",
    )


def province_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """province rows with dotted thousands that lost trailing zeros."""
    daily = _placed_orders(spark, sf_dir).groupBy(
        F.col("n_name").alias("province_name"), F.to_date("o_orderdate").alias("dt")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey") % 200).alias("x"))
    total = F.sum("x").over(Window.partitionBy("province_name").orderBy("dt"))
    return daily.withColumn("total", total).selectExpr(
        "province_name",
        "date_format(dt, 'MM-dd-yyyy') as date_raw",
        "cast(n as string) as new_cases",
        """case when total >= 1000 then concat(cast(total div 1000 as string), '.',
                  case when total % 1000 = 0 then '0'
                       else rtrim('0', lpad(cast(total % 1000 as string), 3, '0')) end)
                else cast(total as string) end as total_cases""",
        "cast(n % 3 as string) as total_deaths",
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every page of ``pages``, whole, with four tables made of its own first link and number, and
    with tables that must not count: in a comment before them, in a script between them, in a quoted
    attribute. The second and the fourth table leave out end tags, and characters are written as
    references of all three kinds."""
    dotted = "replace(format_number({0}, 0), ',', '.')"
    link = "regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"
    tables = f"""concat(
      '<!-- <table><tr><td>hidden</td></tr></table> -->', '<table class="nav"><tr><td>x</td></tr></table>',
      '<script>document.write("<table><tr><td>written</td></tr></table>")</script>',
      '<table class="wikitable" title="a>b <table><tr><td>quoted</td></tr></table>">\n<tr><th>Name<th>Cases<th>Deaths<th>New\n',
      '<tr><td title="x>y"><a href="/p?a=1>2">T&#x1EC9;nh ', {link}, ' ', cast(page_id as string), '</a><sup>&#91;5&#93;</sup><td>',
      {dotted.format('page_id * 1237 + 10')}, '<td>', cast(page_id % 50 as string), '<td>n.a.\n',
      '<tr class="total"><td>Cả nước&#160;(all)<td>', {dotted.format('page_id * 2000 + 90')},
      '<td>', cast(page_id % 90 as string), '<td>7</table>',
      '<table>\n<tr><th scope="col">Locality</th><th>Population</th><th>Doses\n distributed</th>',
      '<th>Doses administered</th><th>Doses administered per 100 people</th></tr>',
      '<tr><td>Place ', {link}, ' ', cast(page_id as string), ' province</td><td>', format_number(page_id * 1000 + 7, 0),
      '</td><td>', cast(page_id * 13 as string), '</td><td>', format_number(page_id * 11 + 3, 0),
      '</td><td>', case when page_id % 4 = 0 then '&mdash;' else concat(cast(page_id % 150 as string), '.5') end,
      '</td></tr></table>',
      '<table><thead><tr><th>Date<th>a<th>b<th>Cases<th>Deaths<tbody>',
      '<tr><td colspan="5">heading<tr><td colspan="3" title="colspan=9">March<td>1<td>1',
      '<tr><td>2021&#45;03-01<td><td><td>', {dotted.format('page_id * 9 + 100')},
      '<td>', cast(page_id % 11 as string), '</tr>',
      '<tr><td>2021-03-02</td><td></td><td></td><td>', {dotted.format('page_id * 10 + 90')},
      '<sup>&#91;3&#93;</sup></td><td>', cast(page_id % 13 + 2 as string), '</td></tr>',
      '<tr><td>2021-03-03</td><td></td><td></td><td>n.a.</td><td>9</td></tr>',
      '<tr><td>2021-03-04</td><td></td><td></td><td>', {dotted.format('page_id * 12 + 95')},
      '</td><td>', cast(page_id % 13 + 5 as string), '</td></tr></table>')"""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"concat(html, {tables}) as html")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the conversations as they are."""
    return table(spark, sf_dir, "conversations")


def ruled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, whole, each with a keyword of a message rule behind it by its turn; every
    seventh turn has two rules' keywords."""
    words = [rule[1][0] for rule in MESSAGE_RULES]
    some = F.array(*[F.lit(w) for w in words])
    n = F.lit(len(words) + 1)
    first = F.coalesce(F.get(some, F.col("turn") % n), F.lit(""))
    second = F.when(F.col("turn") % 7 == 0, F.get(some, F.col("conv_id") % F.lit(len(words)))).otherwise("")
    return messages(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", first, second))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, nested: a feature per user, a polygon per event type, an outer ring of all its events' points
    and an inner ring that does not count."""
    points = vertices(spark, sf_dir).groupBy("feature_id", "ring_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))
    hole = F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")))
    return points.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "ring"))),
                                                        lambda p: F.array(p["ring"], hole)).alias("polygons"))


MESSAGE_TEST_RULES = [("first", ["tion"], "reply one"), ("second", ["thou"], "reply two")]
MESSAGE_TEST_DEFAULT = ("default", "reply three")

_PLACE_PREFIX = """case n_nationkey % 5 when 0 then 'Đắk ' when 1 then 'Thừa Thiên-' when 2 then 'Hà '
                        when 3 then 'Ho Chi Minh ' else 'Bà Rịa-' end"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accented place names with suffixes and footnotes, and coordinates."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as place_id",
        f"""concat({_PLACE_PREFIX}, n_name,
             case n_nationkey % 4 when 0 then ' province' when 1 then '[12]'
                  when 2 then '{NBSP} City' else '  ' end) as place_name""",
        "100 + n_nationkey * 0.25D as lon", "8 + n_nationkey * 0.5D as lat",
    )


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name a place in their own spelling; some name none that is known, some names
    are longer than 255 characters."""
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        "c_custkey as row_id",
        f"""case when c_custkey % 9 = 0 then concat('Xã ', n_name)
                 when c_custkey % 10 = 0 then concat(repeat('Dài ', 80), n_name, ' ', cast(c_custkey as string))
                 when c_custkey % 2 = 0 then upper(concat({_PLACE_PREFIX}, n_name))
                 else concat({_PLACE_PREFIX}, n_name, ' Province') end as province_name""",
        "c_custkey % 250 as doses_per_100",
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: run log rows."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 as job_id", "event_type as job_name",
        """case when event_type = 'error' then 'failed' when event_id % 97 = 0 then 'running'
                else 'success' end as status""",
        "user_id * 10 as rows_processed", "ts as started_at",
        "case when event_id % 97 = 0 then null else ts + interval '90' second end as finished_at",
        "case when event_type = 'error' then props end as error_message",
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per polygon vertex."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as feature_id", "event_type as ring_id", "event_id as pos",
        "102 + (event_id % 75) / 10.0D as lon", "8.5D + (event_id % 149) / 10.0D as lat",
    )
