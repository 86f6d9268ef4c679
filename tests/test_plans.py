"""Shape of the physical plans that matter at scale."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from caselake.checks import fixtures as fx
from caselake.checks.queries import QUERIES
from caselake.operators.clean import deduplicate, typed_daily
from caselake.plans import serving
from caselake.session import materialize, shared_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def without_subqueries(text: str) -> str:
    return "\n".join(line for line in text.splitlines() if ":  +-" not in line)


def test_dedup_drops_copies_before_the_shuffle(spark, sf_dir):
    lines = plan(deduplicate(typed_daily(fx.raw_daily(spark, sf_dir)))).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(iso_code" in line)
    partial = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    assert partial > exchange  # below it in the tree: runs first


def test_top_lists_are_top_k(spark, sf_dir):
    for name in ("top_countries", "top_provinces", "job_history", "recent_trend", "ranked_list", "top_coverage"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir)), name


def test_column_pruning_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["duplicate_keys"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_summary_from_stored_fact_shuffles_once(spark, sf_dir):
    rows = [(c, 20210100 + d, c * d, d, c + d, d, d, None, None, 2021) for c in range(1, 4) for d in range(1, 20)]
    fact = materialize(spark.createDataFrame(
        rows, "country_id int, date_id int, new_cases bigint, new_deaths bigint, total_cases bigint, "
              "total_deaths bigint, people_vaccinated bigint, vaccination_rate decimal(18,2), "
              "case_fatality_rate decimal(18,2), year int"), "fact")
    names = materialize(spark.createDataFrame(
        [(i, f"N{i}") for i in range(1, 4)], "country_id int, country_name string"), "names")
    text = plan(serving.country_summary(fact, names, F.current_timestamp()))
    assert text.count("Exchange hashpartitioning(country_id") == 1
    assert "SortAggregate" not in text and "BroadcastHashJoin" in text


def test_summary_names_do_not_force_a_sort_of_the_rows(spark, sf_dir):
    """The grouping over all rows is a hash aggregate; only the small second step sorts."""
    text = plan(QUERIES["country_summary"](spark, sf_dir))
    assert "HashAggregate(keys=[iso_code" in text


def test_upsert_moves_each_side_once(spark, sf_dir):
    for name in ("upsert_full", "upsert_partial"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Exchange hashpartitioning(iso_code" in text
        joins = [line for line in text.splitlines() if "Join" in line and "full_date" in line]
        assert joins
        # both inputs come from a ranking over the join keys: no second exchange per side
        assert text.count("Exchange hashpartitioning(iso_code") <= (3 if name == "upsert_full" else 2), name


@pytest.mark.parametrize("name", ["surrogate_key_lookup", "orphan_rows"])
def test_dimension_join_is_broadcast_by_stored_size(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_large_dimension_is_not_broadcast(spark):
    big = materialize(spark.range(200000).select(
        F.concat(F.lit("code-"), F.col("id")).alias("iso_code"), F.col("id").cast("int").alias("country_id")), "big")
    from caselake.operators.keys import lookup_key

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        text = plan(lookup_key(big.select("iso_code"), big, "iso_code", "country_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["rolling_7d_sums", "upsert_full", "country_summary"])
def test_filters_on_typed_dates_compile(spark, sf_dir, name):
    """Without the way back to interpreted stages, code beyond a method's 64 KB would end the run."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, sf_dir).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_shared_folder_has_to_be_named_where_executors_are_apart(master):
    apart = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(apart)
