"""Plans: columns and filters that reach the scan, and shuffles that must not be there."""

import re

import pytest

from geolark.plans.catalogue import QUERIES
from geolark.session import PARTITION_BYTES, settings

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("event_counts", {"user_id", "event_type"}), ("zonal_stats", {"vec_id", "label", "g", "n", "i", "side", "lo"}), ("stability", {"vec_id", "embedding"}), ("layer_list", {"label"}), ("aspect_direction", {"o_orderkey"})])
def test_scans_read_the_columns_they_need(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>)?[^>]*)>", plan(spark, name))
    assert read and all({c.split(":")[0] for c in re.split(r",(?=\w+:)", r)} <= columns for r in read)


@pytest.mark.parametrize(("name", "pushed"), [("least_cloudy_per_window", "EqualTo(event_type,view)"), ("layer_list", "GreaterThan(label,0)"), ("rain_et_balance", "EqualTo(event_type,click)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


@pytest.mark.parametrize("name", ["latlng_to_cell", "cell_centres", "suitability", "biophysical", "parse_coordinates", "place_name"])
def test_projections_do_not_shuffle(spark, name):
    assert "hashpartitioning" not in plan(spark, name) or name == "place_name"


def test_no_python_outside_the_arrow_queries(spark):
    for name in ("sim_scan_expressions", "sim_scan_float", "knn_farms", "suitability", "stability"):
        assert not re.search("Python|Pandas|MapInArrow", plan(spark, name)), name


def test_settings_follow_the_input():
    small, large = settings(1 << 30, 16), settings(100 << 40, 16_000)
    assert small["spark.sql.shuffle.partitions"] == "48" and int(small["spark.sql.files.maxPartitionBytes"]) < PARTITION_BYTES
    assert int(large["spark.sql.shuffle.partitions"]) == (100 << 40) // PARTITION_BYTES and int(large["spark.sql.files.maxPartitionBytes"]) == PARTITION_BYTES
