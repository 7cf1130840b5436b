"""Sides of joins whose size Spark can only guess are not broadcast before they are counted."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import nested
from foliant.operators.review import _cut, unsized
from foliant.plans.catalog import QUERIES


def planned(df):
    """The plan before anything is counted."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_that_few_rows_are_made_into_are_not_broadcast_by_a_guess(spark):
    many = spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("n"))
    for df in (unsized(many), _cut(many)):
        assert df.schema == many.schema and sorted(df.collect()) == sorted(many.collect())
        joined = many.alias("a").join(df.alias("b"), F.expr("a.id = b.id AND a.n = b.n"))
        assert "BroadcastHashJoin" not in planned(df.alias("a").join(df.alias("b"), F.expr("a.id = b.id")))
        assert joined.count() == 3_000


@pytest.mark.parametrize("name", ["structure_json", "clean_scan", "image_inventory"])
def test_objects_of_files_are_not_broadcast_by_a_guess(spark, name):
    assert "BroadcastHashJoin" not in planned(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_rectangles_made_from_keys_are_not_broadcast_by_a_guess(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(nested, "cut", lambda df: (plans.append(planned(df)), _cut(df))[1])
    QUERIES["redact_forms"](spark, "/root/testdata/sf0.001")
    assert len(plans) >= 5 and not any("BroadcastHashJoin" in p for p in plans)
