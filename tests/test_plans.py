"""The plans are the ones meant: pruned scans, limits on ranks before the shuffle, no Python in relational operators."""

from pyspark.sql import functions as F

from weftline.operators import labeling, stages, tables
from weftline.plans.bounded import small_side
from weftline.queries import _frames, _items

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned(spark):
    text = plan(_items(spark, D).select("sku_id", "design_id"))
    schema = next(x for x in text.splitlines() if "ReadSchema" in x).split("ReadSchema:")[1]
    assert "attrs_json" not in schema and "folder" not in schema and "design_id" in schema


def test_rank_limits_run_before_the_shuffle(spark):
    df = labeling.stratified_sample(tables.pairs(spark.read.parquet(f"{D}/manifest_pairs.parquet")), 20, 1, key="pair_id")
    assert "WindowGroupLimit" in plan(df)


def test_broadcast_only_when_small(spark):
    assert "BroadcastHashJoin" in plan(spark.range(10**6).join(small_side(spark.range(10), 100), "id"))
    big = small_side(spark.range(10**6), 100)
    assert "ResolvedHint" not in plan(spark.range(10**6).join(big, "id"))


def test_working_set_has_no_python(spark):
    f = _frames(spark, D).withColumns({c: F.lit(True) for c in ("is_canonical", "label_ok")}).withColumn("is_template", F.lit(False))
    text = plan(stages.working_set(f, _items(spark, D)))
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
